"""Queries on the small derived values, file names and model inputs (2.A, 2.C, 2.I, 2.L, 2.N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import tiers
from corpusloom.operators import encoder, validate
from corpusloom.queries import evaluation
from corpusloom.queries.common import PREDICTIONS, leakage_rows, sql_strip, sql_tokens, table
from corpusloom.sources.config import EncoderConfig
from corpusloom.sources.registry import group_by_ending

ENDINGS = {"first": ["0001.tsv", "0002.tsv"], "second": ["2.tsv", "3.tsv"], "third": ["pool/batch_0004.tsv"]}
BATCH, ACCUMULATED, WARMUP = 32, 4, 0.1


def file_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Files by the first group whose endings fit, with their base names."""
    files = table(spark, folder, "interim_dataset").select(F.coalesce("source_file", F.lit("")).alias("source_file")).distinct()
    return files.select("source_file", group_by_ending(F.col("source_file"), ENDINGS, "other").alias("file_group"), X.basename(F.col("source_file")).alias("base_name"))


def file_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One flat row per file: sums over its text columns, their names in one cell."""
    rows = table(spark, folder, "ood_leakage_precheck").withColumn("source_file", F.coalesce("split_name", F.lit("")))
    texts = ["original_text", "processed_text"]
    out = validate.profile(rows, "source_file", ["source_id", *texts, "raw_label"], texts)
    return out.withColumn("text_columns", F.array_join(F.array(*[F.lit(t) for t in texts]), ","))


def schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Optimizer steps and warm-up of an epoch over each split."""
    rows = table(spark, folder, "interim_dataset").groupBy("split_name").agg(F.count(F.lit(1)).alias("n"))
    steps = X.steps_per_epoch(F.ceil(F.col("n") / BATCH), F.lit(ACCUMULATED))
    return rows.select("split_name", "n", steps.alias("steps"), X.warmup_steps(steps * 5, F.lit(WARMUP)).alias("warmup_steps"))


def display(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation as shown, and the name of the evaluation view."""
    runs = evaluation.seed_runs(spark, folder).groupBy("model_name").agg(F.avg("accuracy").alias("m"), F.stddev_samp("accuracy").alias("d"), F.count(F.lit(1)).alias("n"))
    shown = tiers.mean_and_deviation(F.col("m"), F.col("d"))
    return runs.select("model_name", shown.alias("shown"), tiers.view_label(F.col("n"), F.lit(5)).alias("five"), tiers.view_label(F.col("n"), F.lit(998)).alias("other"))


def flattened(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers read back from the JSON payload by path."""
    rows = evaluation.payload(spark, folder)
    x = F.from_json("payload", "n_rows long, saudi map<string, long>")
    return rows.select("model_name", x.n_rows.alias("n_rows"), F.element_at(x.saudi, "support").alias("support"))


def word_lengths(text: str) -> list[int]:
    """A stand-in tokenizer: the length of every token."""
    return [len(w) for w in text.split()]


def tokenised(spark: SparkSession, folder: str) -> DataFrame:
    """Model inputs of every row by the stand-in tokenizer, cut to the encoder's max_length."""
    rows = leakage_rows(spark, folder).select("record_id", X.squeeze_ws(F.col("processed_text")).alias("t"), "macro_label")
    out = encoder.tokenised(rows, "record_id", "t", "macro_label", word_lengths, EncoderConfig().max_length)
    as_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("record_id", as_text("input_ids"), as_text("attention_mask"), "labels")


def script_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of every row, and the share of them in Arabic script."""
    t = F.coalesce("text", F.lit(""))
    arabic, letters = F.regexp_count(t, F.lit(r"[\x{620}-\x{64a}]")).cast("long"), F.regexp_count(t, F.lit(r"\p{L}")).cast("long")
    return table(spark, folder, "interim_dataset").select("record_id", letters.alias("n_letters"), X.ratio(arabic, letters).alias("arabic_share"))


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Reply contents with and without fences, read alike."""
    rows = table(spark, folder, "interim_dataset").where("split_name = 'dev_core'").select("record_id", F.coalesce("macro_label", F.lit("")).alias("label"))
    body = F.to_json(F.struct("label"))
    fenced = F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select("record_id", F.get_json_object(X.without_fences(fenced), "$.label").alias("label"))


def raw_pool_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of both post tables in one shape: the pre-check lacks the file and its row, which get their defaults."""
    interim = table(spark, folder, "interim_dataset").select("record_id", "source_file", "source_row_number")
    pool = interim.unionByName(table(spark, folder, "ood_leakage_precheck").select("record_id"), allowMissingColumns=True)
    return pool.fillna({"source_file": "", "source_row_number": 0})


QUERIES = {
    "A6_C36_C37_file_groups": file_groups, "B15_file_summary": file_summary, "C35_schedule": schedule, "C29_C30_display": display, "I4_flattened": flattened,
    "L6_tokenised": tokenised, "N9_script_shares": script_shares, "C23_fences": json_lines, "B14_default_column": raw_pool_defaults,
}
_OT, _PT = (sql_strip(f"coalesce({c}, '')") for c in ("original_text", "processed_text"))
_SUM = lambda test: f"cast(sum({' + '.join(f'(case when {test(t)} then 1 else 0 end)' for t in (_OT, _PT))}) as bigint)"
_ENDS = lambda es: " or ".join(f"ends_with(f, '{e}')" for e in es)
ORACLES = {
    "A6_C36_C37_file_groups": f"""with x as (select distinct coalesce(source_file, '') as f from interim_dataset)
      select f as source_file, case {' '.join(f"when {_ENDS(es)} then '{g}'" for g, es in ENDINGS.items())} else 'other' end as file_group, split_part(f, '/', -1) as base_name from x""",
    "B15_file_summary": f"""select coalesce(split_name, '') as source_file, count(*) as n_rows, count(*) - count(distinct sha1(coalesce(source_id, '') || chr(9) || coalesce(original_text, '')
        || chr(9) || coalesce(processed_text, '') || chr(9) || coalesce(raw_label, ''))) as n_duplicates, {_SUM(lambda t: f"{t} = ''")} as n_empty,
        {_SUM(lambda t: f"len({sql_tokens(t)}) < 3")} as n_short, 'original_text,processed_text' as text_columns from ood_leakage_precheck group by 1""",
    "C35_schedule": f"""with c as (select split_name, count(*) as n from interim_dataset group by 1), s as (select split_name, n, cast(ceil(ceil(n / {BATCH}) / {ACCUMULATED}) as bigint) as steps from c)
      select split_name, n, steps, cast(floor(steps * 5 * {WARMUP}) as bigint) as warmup_steps from s""",
    "C29_C30_display": f"""with {PREDICTIONS}, r as (select model_name, record_id % 5 as seed, avg(cast(coalesce(true_label = predicted_label, false) as int)) as a from pred group by 1, 2)
      select model_name, printf('%.4f +/- %.4f', avg(a), stddev_samp(a)) as shown, case when count(*) = 5 then 'cleaned benchmark-safe dev' else 'original full-dev' end || ' (' || count(*) || ' rows)' as five,
        'original full-dev (' || count(*) || ' rows)' as other from r group by 1""",
    "I4_flattened": f"with {PREDICTIONS} select model_name, count(*) as n_rows, count(case when true_label = 'Saudi' then 1 end) as support from pred group by 1",
    "L6_tokenised": f"""with t as (select record_id, ({sql_tokens("coalesce(processed_text, '')")})[1:128] as w, macro_label from ood_leakage_precheck)
      select record_id, array_to_string([length(x) for x in w], ',') as input_ids, array_to_string([1 for x in w], ',') as attention_mask,
        cast(nullif(list_position(['Saudi', 'Egyptian', 'Levantine', 'Maghrebi'], macro_label), 0) - 1 as int) as labels from t""",
    "N9_script_shares": r"""with c as (select record_id, len(regexp_extract_all(coalesce(text, ''), '[\x{620}-\x{64a}]')) as a, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) as n from interim_dataset)
      select record_id, cast(n as bigint) as n_letters, case when n = 0 then 0.0 else cast(a as double) / n end as arabic_share from c""",
    "C23_fences": "select record_id, coalesce(macro_label, '') as label from interim_dataset where split_name = 'dev_core'",
    "B14_default_column": """select record_id, coalesce(source_file, '') as source_file, coalesce(source_row_number, 0) as source_row_number from interim_dataset
      union all select record_id, '', 0 from ood_leakage_precheck""",
}
