"""Queries on text and label functions (2.B, 2.C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import text as X
from corpusloom.operators.selection import examples
from corpusloom.queries.common import sql_coerced, sql_macro, sql_normalized, sql_strip, sql_tokens, table

W, WS = X.W, X.WS


def _on_text(expr, name: str = "value"):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, "interim_dataset")
        value: Column = expr(F.coalesce("text", F.lit("")))
        return df.select("record_id", value.alias(name))
    return query


def _sql_text(expr: str, name: str = "value") -> str:
    return f"select record_id, {expr.replace('$t', chr(39).join(['coalesce(text, ', '', ')']))} as {name} from interim_dataset"


URLS = rf"regexp_replace($x, '(?i)(?:https?://|www\.|pic\.twitter\.com/)[^{WS}]*', ' ', 'g')"
TOKEN = lambda word, stop, to: (
    f"regexp_replace(regexp_replace($x, '(^|{stop[0]}){word}($|{stop[1]})', '\\1{to}\\2', 'g'), '(^|{stop[0]}){word}($|{stop[1]})', '\\1{to}\\2', 'g')"
)
NOT_W = r"[^\p{L}\p{N}_]"
URL_WORDS = TOKEN("URL", (NOT_W, NOT_W), " ")
HANDLES = r"regexp_replace($x, '@[\p{L}\p{N}_]+', ' <USER> ', 'g')"
USER_WORDS = TOKEN("USER", (r"[^\p{L}\p{N}_<]", r"[^\p{L}\p{N}_>]"), " <USER> ")
HASHES = "replace($x, '#', '')"
VOWELS = rf"regexp_replace($x, '{X.VOWELS}', '', 'g')"
ALEF = "translate($x, 'آأإٱ', 'اااا')"
FINAL = rf"regexp_replace($x, 'ى($|{NOT_W})', 'ي\1', 'g')"
TATWEEL = "regexp_replace($x, 'ـ+', '', 'g')"
LETTERS = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0x621, 0x64B)]]
RUNS = "list_reduce(list_prepend($x, [" + ", ".join(f"'{c}'" for c in LETTERS) + "]), lambda a, b: regexp_replace(a, b || '{3,}', b || b, 'g'))"
SPACES = f"trim(regexp_replace($x, '[{WS}]+', ' ', 'g'))"
STEPS = [URLS, URL_WORDS, HANDLES, USER_WORDS, HASHES, VOWELS, ALEF, FINAL, TATWEEL, RUNS, SPACES]


def chained(steps: list[str]) -> str:
    """SQL of several steps, each over the result of the one before."""
    ctes, last = ["s0 as (select record_id, coalesce(text, '') as x from interim_dataset)"], "s0"
    for i, step in enumerate(steps, 1):
        ctes.append(f"s{i} as (select record_id, {step.replace('$x', 'x')} as x from {last})")
        last = f"s{i}"
    return f"with {', '.join(ctes)} select record_id, x as value from {last}"


def label_map(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every raw label with its normalized and macro label."""
    raw = F.coalesce("raw_label", F.lit(""))
    df = table(spark, folder, "interim_dataset").select(raw.alias("raw_label"), L.normalized(F.col("raw_label")).alias("label"))
    return df.groupBy("raw_label", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("macro_label", L.macro(F.col("label")))


def row_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every row's source columns."""
    df = table(spark, folder, "interim_dataset")
    return df.select("record_id", X.row_fingerprint(*[F.col(c) for c in ("source_id", "text", "raw_label")]).alias("value"))


def coercion(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted labels as stored, coerced, and by position."""
    label = L.coerced(F.col("predicted_label"))
    index = L.label_index(label)
    df = table(spark, folder, "model_predictions")
    return df.select("prediction_id", label.alias("label"), index.alias("label_index"), L.index_label(index).alias("back"))


def processed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """original_text and processed_text in place of text."""
    df = table(spark, folder, "interim_dataset")
    raw = F.coalesce("text", F.lit(""))
    return df.select("record_id", "split_name", raw.alias("original_text"), X.clean(raw).alias("processed_text"))


def support_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Few-shot score parts of every processed text."""
    df = table(spark, folder, "ood_leakage_precheck")
    t = F.coalesce("processed_text", F.lit(""))
    return df.select("record_id", X.support_score(t).cast("long").alias("score"), X.token_count(t).cast("long").alias("n_tokens"), F.length(t).cast("long").alias("n_chars"), X.latin_count(t).cast("long").alias("n_latin"))


def jaccard_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of a row's original and processed text, and its upper bound."""
    df = table(spark, folder, "ood_leakage_precheck")
    a, b = (X.token_set(F.coalesce(c, F.lit(""))) for c in ("original_text", "processed_text"))
    return df.select("record_id", X.jaccard(a, b).alias("jaccard"), X.length_bound(F.size(a), F.size(b)).alias("bound"))


def first_long_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten truncated documents of each language."""
    df = table(spark, folder, "documents").where("text is not null and lang is not null")
    rows = examples(df, ["lang"], [F.col("doc_id")], 10)
    return rows.select("lang", "rank", "doc_id", X.truncated(F.col("text")).alias("shown"))


QUERIES = {
    "C2_C3_urls": _on_text(X.drop_urls),
    "C4_C5_mentions": _on_text(X.mask_mentions),
    "C6_hash_signs": _on_text(X.drop_hash_signs),
    "C7_C10_arabic": _on_text(X.fold_arabic),
    "C11_elongation": _on_text(X.shorten_runs),
    "C12_white_space": _on_text(X.squeeze_ws),
    "C1_C13_clean": _on_text(X.clean),
    "C14_text_fingerprint": _on_text(lambda t: X.fingerprint(X.strip_ws(t))),
    "C15_row_fingerprint": row_fingerprints,
    "C16_strip": _on_text(X.strip_ws),
    "C17_token_count": _on_text(lambda t: X.token_count(t).cast("long")),
    "C18_H7_token_set": _on_text(lambda t: F.size(X.token_set(t)).cast("long")),
    "C20_C21_jaccard": jaccard_versions,
    "C22_support_score": support_scores,
    "C24_B12_coerce_label": coercion,
    "C25_G8_truncate": first_long_texts,
    "B1_B2_D13_label_map": label_map,
    "B6_A27_processed": processed_rows,
}
_T = "coalesce(processed_text, '')"
_N = f"len({sql_tokens(_T)})"
ORACLES = {
    "C2_C3_urls": chained(STEPS[:2]),
    "C4_C5_mentions": chained(STEPS[2:4]),
    "C6_hash_signs": chained(STEPS[4:5]),
    "C7_C10_arabic": chained(STEPS[5:9]),
    "C11_elongation": chained(STEPS[9:10]),
    "C12_white_space": chained(STEPS[10:]),
    "C1_C13_clean": chained(STEPS),
    "C14_text_fingerprint": _sql_text(f"sha1({sql_strip('$t')})"),
    "C15_row_fingerprint": "select record_id, sha1(coalesce(source_id, '') || chr(9) || coalesce(text, '') || chr(9) || coalesce(raw_label, '')) as value from interim_dataset",
    "C16_strip": _sql_text(sql_strip("$t")),
    "C17_token_count": _sql_text(f"len({sql_tokens('$t')})"),
    "C18_H7_token_set": _sql_text(f"len(list_distinct({sql_tokens('$t')}))"),
    "C20_C21_jaccard": f"""with s as (select record_id, list_distinct({sql_tokens("coalesce(original_text, '')")}) as a,
        list_distinct({sql_tokens("coalesce(processed_text, '')")}) as b from ood_leakage_precheck),
      n as (select record_id, len(list_intersect(a, b)) as i, len(a) as x, len(b) as y from s)
      select record_id, case when x + y - i = 0 then 0.0 else cast(i as double) / (x + y - i) end as jaccard,
        case when greatest(x, y) = 0 then 0.0 else cast(least(x, y) as double) / greatest(x, y) end as bound from n""",
    "C22_support_score": f"""select record_id, cast((case when {_N} between 3 and 8 then 8 else 0 end) - abs({_N} - 5)
        + (case when contains({_T}, '<USER>') then 0 else 4 end) + (case when contains({_T}, 'NUM') then 0 else 3 end)
        + (case when regexp_matches({_T}, '[A-Za-z]') then 0 else 3 end) + (case when regexp_matches({_T}, '[_:/\\\\]') then 0 else 2 end)
        + (case when len(regexp_extract_all({_T}, '[\\x{{600}}-\\x{{6ff}}]')) >= greatest(8, length({_T}) // 2) then 2 else 0 end) as bigint) as score,
        cast({_N} as bigint) as n_tokens, cast(length({_T}) as bigint) as n_chars, cast(len(regexp_extract_all({_T}, '[A-Za-z]')) as bigint) as n_latin
      from ood_leakage_precheck""",
    "C24_B12_coerce_label": f"""select prediction_id, l as label, cast(list_position(['Saudi', 'Egyptian', 'Levantine', 'Maghrebi'], l) - 1 as int) as label_index, l as back
      from (select prediction_id, {sql_coerced('predicted_label')} as l from model_predictions)""",
    "C25_G8_truncate": f"""with r as (select lang, doc_id, trim(regexp_replace(text, '[{WS}]+', ' ', 'g')) as t,
        row_number() over (partition by lang order by doc_id) as rank from documents where text is not null and lang is not null)
      select lang, rank, doc_id, case when length(t) <= 160 then t else substr(t, 1, 159) || '…' end as shown from r where rank <= 10""",
    "B1_B2_D13_label_map": f"""select coalesce(raw_label, '') as raw_label, {sql_normalized('raw_label')} as label,
        {sql_macro(sql_normalized('raw_label'))} as macro_label, count(*) as n from interim_dataset group by all""",
    "B6_A27_processed": f"select i.record_id, i.split_name, coalesce(i.text, '') as original_text, c.value as processed_text from interim_dataset i join ({chained(STEPS)}) c using (record_id)",
}
