"""Queries on features, models, perturbations and comparisons (2.L, 2.N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS
from corpusloom.operators import features as X
from corpusloom.operators import metrics as M
from corpusloom.operators import perturb
from corpusloom.plans.lineage import cut
from corpusloom.queries.common import PREDICTIONS, leakage_rows, sql_tokens, table
from corpusloom.queries.evaluation import KEY, _rounded, predictions

MIN_DF = 2


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return leakage_rows(spark, folder).select("record_id", "split_name", "processed_text", "macro_label")


def _frequencies(terms):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        counts = X.term_counts(_rows(spark, folder), "record_id", terms(F.col("processed_text")))
        return X.document_frequencies(counts, MIN_DF)
    return query


def _weights(terms):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = _rows(spark, folder)
        counts = X.term_counts(rows, "record_id", terms(F.col("processed_text")))
        return _rounded(X.tfidf(counts, X.document_frequencies(counts, MIN_DF), rows.count(), "record_id"))
    return query


def classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of the TF-IDF classifier for the candidates (fit on labelled reference rows)."""
    rows = _rows(spark, folder).where(F.col("macro_label").isin(LABELS))
    train, dev = rows.where("split_name = 'train_core'"), X.spread(rows.where("split_name <> 'train_core'"), "record_id")
    return X.fit_predict(train, dev, "record_id", "processed_text", "macro_label", max_iter=100)


def _perturbed(family: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        text = F.col("processed_text")
        return _rows(spark, folder).select("record_id", perturb.FAMILIES[family](text, F.col("record_id")).alias("value"))
    return query


def ood_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of every model on the candidates against those on the dev rows."""
    rows = predictions(spark, folder)
    inside = table(spark, folder, "interim_dataset").where("split_name = 'dev_core'").select("record_id")
    def measured(part: DataFrame) -> DataFrame:
        means = M.averages(M.per_class(part, KEY), KEY).select("model_name", "macro_f1", "weighted_f1")
        return M.accuracy(part, KEY).select("model_name", "accuracy").join(means, "model_name")
    outside = measured(rows.join(inside, "record_id", "left_anti"))
    return _rounded(M.deltas(outside, measured(rows.join(inside, "record_id", "left_semi")), KEY, ["accuracy", "macro_f1", "weighted_f1"]))


def robustness(spark: SparkSession, folder: str) -> DataFrame:
    """What the TF-IDF classifier loses on each perturbation family of all labelled candidates.

    A family is excluded if most of its texts are changed too much.
    """
    rows = _rows(spark, folder).where(F.col("macro_label").isin(LABELS))
    train = rows.where("split_name = 'train_core'")
    text, key = F.col("processed_text"), F.col("record_id")
    texts = {"clean": text} | {name: rule(text, key) for name, rule in perturb.FAMILIES.items()}
    versions = F.explode(F.array(*[F.struct(F.lit(name).alias("family"), t.alias("t")) for name, t in texts.items()]))
    dev = X.spread(rows.where("split_name <> 'train_core'"), "record_id").select("macro_label", text.alias("clean"), versions.alias("v"))
    much = F.when(F.col("v.family") != "clean", perturb.too_aggressive(F.col("clean"), F.col("v.t")).cast("int"))
    dev = dev.select(F.struct("v.family", much.alias("much")).alias("version"), "macro_label", F.col("v.t").alias("processed_text"))
    scored = X.fit_predict(train, dev, "version", "processed_text", "macro_label", max_iter=100)
    scored = cut(scored.select("version.*", F.lit("classical_tfidf").alias("model_name"), "true_label", "predicted_label"))
    excluded = scored.where("family <> 'clean'").groupBy("family").agg((F.avg("much") > 0.5).alias("excluded"))
    return _rounded(M.robustness(scored.drop("much"), excluded))


QUERIES = {
    "L1_E30_word_terms": _frequencies(X.word_ngrams), "L2_char_terms": _frequencies(X.char_ngrams),
    "L1_word_tfidf": _weights(X.word_ngrams), "L2_char_tfidf": _weights(X.char_ngrams), "L3_L4_L5_classifier": classifier,
    "N1_ood_delta": ood_delta, "N6_robustness": robustness,
    "N2_typo_noise": _perturbed("typo_noise"), "N3_elongation": _perturbed("elongation"),
    "N4_placeholder_noise": _perturbed("placeholder_noise"), "N5_punctuation_spacing": _perturbed("punctuation_spacing"),
}
_DOCS = "docs as (select record_id, coalesce(processed_text, '') as t from ood_leakage_precheck)"
_WORDS = f"""{_DOCS}, w as (select record_id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+') as a from docs),
  terms as (select record_id, unnest(a) as term from w
    union all select record_id, a[i] || ' ' || a[i + 1] from (select record_id, a, unnest(range(1, len(a))) as i from w))"""
_CHARS = f"""{_DOCS}, tok as (select record_id, ' ' || unnest({sql_tokens('t')}) || ' ' as p from docs),
  terms as ({" union all ".join(f"select record_id, substr(p, i, {n}) as term from (select record_id, p, unnest(range(1, greatest(length(p) - {n}, 0) + 2)) as i from tok"
    + ("" if n == 3 else f" where length(p) >= {n}") + ")" for n in (3, 4, 5))})"""
_DF = "df as (select term, count(distinct record_id) as df from terms group by 1 having count(distinct record_id) >= 2)"
_TFIDF = f"""{_DF}, tf as (select record_id, term, count(*) as tf from terms group by 1, 2),
  raw as (select record_id, term, (1 + ln(tf)) * (ln((1.0 + (select count(*) from docs)) / (1 + df)) + 1) as r from tf join df using (term)),
  nrm as (select record_id, sqrt(sum(r * r)) as n from raw group by 1)
  select record_id, term, round(r / n, 9) as weight from raw join nrm using (record_id)"""
_CHOICE = lambda seed, n: f"cast('0x' || substr(sha1('{seed}:' || cast(record_id as varchar)), 1, 8) as bigint) % {n}"
_MEASURE = """{name}_acc as (select model_name, avg(cast(coalesce(true_label = predicted_label, false) as int)) as accuracy from {name} group by 1),
  {name}_per as (select m.model_name, l.label, (select count(*) from {name} p where p.model_name = m.model_name and true_label = l.label and predicted_label = l.label) as tp,
    (select count(*) from {name} p where p.model_name = m.model_name and true_label = l.label) as s,
    (select count(*) from {name} p where p.model_name = m.model_name and predicted_label = l.label) as q from (select distinct model_name from {name}) m cross join labels l),
  {name}_f as (select model_name, avg(f) as macro_f1, sum(f * s) / sum(s) as weighted_f1 from (select *, case when q + s = 0 then 0.0 else cast(2 * tp as double) / (q + s) end as f from {name}_per) group by 1),
  {name}_m as (select model_name, accuracy, macro_f1, weighted_f1 from {name}_acc join {name}_f using (model_name))"""
_TYPO = lambda i, last: (
    f"e{i + 1} as (select record_id, case when part < 1 then x else substr(x, 1, {i} * part + draw % greatest(part, 1)) || (case when draw % 3 = 0 then substr(x, draw % greatest(len(x), 1) + 1, 1) "
    f"else '' end) || substr(x, {i} * part + draw % greatest(part, 1) + 2) end as x from (select record_id, x, len(x) // 3 as part, "
    f"cast('0x' || substr(sha1('typo:{i}:' || cast(record_id as varchar)), 1, 8) as bigint) as draw from {last}))"
)
_TYPOS = ", ".join(["e0 as (select record_id, t as x from docs)", *[_TYPO(i, f"e{i}") for i in range(3)]])
_DELTA = lambda cs: ", ".join(
    f"round(o.{c}, 9) as {c}, round(i.{c}, 9) as {c}_reference, round(o.{c} - i.{c}, 9) as {c}_delta, round((i.{c} - o.{c}) * 100 / i.{c}, 9) as {c}_drop_percent" for c in cs
)
ORACLES = {
    "L1_E30_word_terms": f"with {_WORDS}, {_DF} select * from df",
    "L2_char_terms": f"with {_CHARS}, {_DF} select * from df",
    "L1_word_tfidf": f"with {_WORDS}, {_TFIDF}",
    "L2_char_tfidf": f"with {_CHARS}, {_TFIDF}",
    "N1_ood_delta": f"""with {PREDICTIONS}, labels(label) as (values {", ".join(f"('{x}')" for x in LABELS)}), dev as (select record_id from interim_dataset where split_name = 'dev_core'),
      outs as (select * from pred where record_id not in (select record_id from dev)), ins as (select * from pred where record_id in (select record_id from dev)),
      {_MEASURE.format(name='outs')}, {_MEASURE.format(name='ins')} select o.model_name, {_DELTA(['accuracy', 'macro_f1', 'weighted_f1'])} from outs_m o join ins_m i using (model_name)""",
    "N2_typo_noise": f"with {_DOCS}, {_TYPOS} select record_id, x as value from e3",
    "N3_elongation": f"""with {_DOCS}, v as (select record_id, t, regexp_extract(t, '[{"".join(perturb.VOWELS)}]') as x from docs)
      select record_id, case when x = '' then t else substr(t, 1, instr(t, x) - 1) || repeat(x, {_CHOICE('elongation', 3)} + 2) || substr(t, instr(t, x) + 1) end as value from v""",
    "N4_placeholder_noise": f"""with {_DOCS} select record_id, (case when {_CHOICE('user', 2)} = 1 then 'USER ' else '' end) || t || (case when {_CHOICE('url', 2)} = 1 then ' URL' else '' end) as value from docs""",
    "N5_punctuation_spacing": f"""with {_DOCS} select record_id, (case when instr(t, ' ') > 0 then substr(t, 1, instr(t, ' ') - 1) || repeat(' ', {_CHOICE('space', 3)} + 2) || substr(t, instr(t, ' ') + 1) else t end)
      || (case {_CHOICE('mark', 3)} when 0 then '!!' when 1 then '...' else '' end) as value from docs""",
}
