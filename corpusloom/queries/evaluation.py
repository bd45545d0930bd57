"""Queries on predictions: metrics, subsets, usage, few-shot and batches (2.D-2.G, 2.I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tiers
from corpusloom.functions.labels import LABELS, TRACKED, coerced
from corpusloom.functions.text import fingerprint
from corpusloom.operators import inference, selection
from corpusloom.operators import metrics as M
from corpusloom.queries.common import LABEL_DIM, MODELS, PREDICTIONS, WS, leakage_rows, sql_tokens, table

KEY = ["model_name"]
PRICES = (3.0, 15.0)
SELECTORS = {"classical_tfidf": "classical", "llm_zero_shot": "zero_shot", "encoder_seed_1": "encoder"}


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The last prediction of every record by every model, label coerced."""
    rows = M.latest(table(spark, folder, "model_predictions"), ["record_id", "model_name"], "prediction_id")
    return rows.withColumn("predicted_label", coerced(F.col("predicted_label")))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Which prediction counts for every record and model."""
    return predictions(spark, folder).select("record_id", "model_name", "prediction_id", "predicted_label")


def error_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the stored error flag agrees with the stored labels."""
    df = table(spark, folder, "model_predictions")
    wrong = F.col("true_label") != F.col("predicted_label")
    return df.groupBy("model_name", "is_error", wrong.cast("string").alias("differs")).agg(F.count(F.lit(1)).alias("n"))


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every (true, predicted) pair by model."""
    return M.confusion(predictions(spark, folder), KEY)


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The confusion matrix of every model."""
    return M.confusion_matrix(predictions(spark, folder), KEY)


def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of every model."""
    return M.accuracy(predictions(spark, folder), KEY)


def per_class(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall, F1 and support by model and label."""
    return M.per_class(predictions(spark, folder), KEY)


def averages(spark: SparkSession, folder: str) -> DataFrame:
    """Macro, weighted and present-label averages by model."""
    return _rounded(M.averages(per_class(spark, folder), KEY))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def report(spark: SparkSession, folder: str) -> DataFrame:
    """The classification report of every model in long form."""
    return _rounded(M.report(predictions(spark, folder), KEY))


def tracked(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the tracked confusions by model."""
    return M.tracked(predictions(spark, folder), KEY)


def tracked_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Tracked confusions, a column per model."""
    return M.tracked_by_model(predictions(spark, folder), MODELS)


def top_confusions(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent confusions of every model."""
    return M.top_confusions(predictions(spark, folder), KEY)


def error_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of every confusion among the errors of its true label."""
    return M.error_shares(predictions(spark, folder), KEY)


def confusion_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten records of every tracked confusion."""
    wrong = M.errors(predictions(spark, folder))
    rows = selection.examples(wrong, ["model_name", "true_label", "predicted_label"], [F.col("record_id")], 10)
    return rows.select("model_name", "true_label", "predicted_label", "rank", "record_id")


def label_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions by label position."""
    rows = M.label_positions(predictions(spark, folder))
    return rows.groupBy("model_name", "true_index", "predicted_index").agg(F.count(F.lit(1)).alias("n"))


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """Requests, tokens (words in and labels out), latency and cost by model."""
    words = F.size(F.split("true_label", "_")).cast("long")
    rows = table(spark, folder, "model_predictions").withColumn("prompt_tokens", words * 10).withColumn("completion_tokens", words)
    out = M.usage(rows.withColumn("latency_ms", F.when(~F.isnan("latency_ms"), F.col("latency_ms"))), KEY, "prompt_tokens", "completion_tokens", "latency_ms", *PRICES)
    return _rounded(out)


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced class weights of the training rows."""
    rows = table(spark, folder, "interim_dataset").where((F.col("split_name") == "train_core") & F.col("macro_label").isin(LABELS))
    return M.class_weights(rows, "macro_label")


def weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean error by model, weighted by the records of each label."""
    rows = predictions(spark, folder).groupBy("model_name", "true_label").agg(F.count(F.lit(1)).alias("n"), F.avg((~F.coalesce(F.col("true_label") == F.col("predicted_label"), F.lit(False))).cast("double")).alias("loss"))
    return _rounded(M.weighted_mean(rows, KEY, "loss", "n"))


def seed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the models as if each were a run with its own seed; five hash parts each."""
    part = (F.col("record_id") % 5).alias("seed")
    right = F.coalesce(F.col("true_label") == F.col("predicted_label"), F.lit(False)).cast("double")
    return predictions(spark, folder).groupBy("model_name", part).agg(F.avg(right).alias("accuracy"))


def stability(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, sample deviation and verdict across runs."""
    out = M.seed_summary(seed_runs(spark, folder), KEY, "accuracy")
    return out.select("model_name", "n_seeds", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"), tiers.stability_tier(F.col("deviation")).alias("tier"))


def early_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Best epoch if the runs of a model were the epochs of one training."""
    history = seed_runs(spark, folder).groupBy("model_name").agg(F.array_sort(F.collect_list(F.struct(F.col("seed").cast("int").alias("epoch"), F.col("accuracy").alias("value")))).alias("h"))
    x = M.early_stop(F.col("h"), 2, 0.001)
    return history.select("model_name", x.alias("x")).select("model_name", "x.best_epoch", "x.last_epoch", "x.stopped")


def hard_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Records that a selector picks for the hard subset, and why."""
    return selection.hard_reasons(predictions(spark, folder), SELECTORS).withColumn("reasons", F.array_join("reasons", ", "))


def selector_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records of every combination of selectors."""
    return selection.combinations(selection.hard_reasons(predictions(spark, folder), SELECTORS))


def by_selector(spark: SparkSession, folder: str) -> DataFrame:
    """Records that each selector picks."""
    return selection.by_selector(selection.hard_reasons(predictions(spark, folder), SELECTORS))


def subset_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of every model on the hard subset."""
    rows = predictions(spark, folder)
    subset = selection.hard_reasons(rows, SELECTORS).select("record_id")
    return M.accuracy(rows.join(subset, "record_id", "left_semi"), KEY)


def model_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the models beside latency, which only some have."""
    means = accuracy(spark, folder).select("model_name", "accuracy")
    spent = predictions(spark, folder).where("latency_ms is not null and not isnan(latency_ms)").groupBy("model_name").agg(F.round(F.avg("latency_ms"), 6).alias("latency_ms"))
    return means.join(spent, "model_name", "full_outer")


def few_shot(spark: SparkSession, folder: str) -> DataFrame:
    """The best three examples of each label."""
    rows = leakage_rows(spark, folder).where("split_name = 'train_core'")
    return selection.few_shot(rows, "processed_text", "macro_label", 3).withColumn("text", fingerprint(F.col("text"))).select("label", "rank", "source_id", "text")


def _batched(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "interim_dataset").where("split_name = 'dev_core'").select("record_id", "text", "macro_label")
    return selection.batches(rows, ["record_id"], 25)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batch and item numbers of the dev rows."""
    return _batched(spark, folder).select("record_id", F.col("batch_id").cast("long").alias("batch_id"), F.col("item_id").cast("long").alias("item_id"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The user prompt of every batch, as its fingerprint."""
    out = inference.prompts(_batched(spark, folder), "text")
    return out.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("n_items").cast("long").alias("n_items"), F.sha1("user_prompt").alias("prompt_hash"))


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Labels read back from replies that hold every item's true label twice, the last right."""
    rows = _batched(spark, folder).where(F.col("macro_label").isin(LABELS))
    item = lambda label: F.struct(F.col("item_id").cast("string").alias("item_id"), label.alias("label"))
    both = rows.groupBy("batch_id").agg(F.collect_list(item(F.lit("Saudi"))).alias("a"), F.collect_list(item(F.upper("macro_label"))).alias("b"))
    content = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat("a", "b").alias("predictions"))), F.lit("\n```"))
    replies = both.select("batch_id", content.alias("content"))
    found = inference.answers(replies)
    return inference.answered(rows, found).select("record_id", "predicted_label")


def payload(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of every model as one JSON document."""
    classes = per_class(spark, folder).where("label = 'Saudi'").select("model_name", "support")
    rows = accuracy(spark, folder).join(classes, "model_name")
    return rows.select("model_name", F.to_json(F.struct("n_rows", F.struct("support").alias("saudi"))).alias("payload"))


QUERIES = {
    "D9_D10_latest_predictions": latest, "B9_B11_error_flags": error_flags, "E18_confusion": confusion, "E17_confusion_matrix": confusion_matrix, "E19_accuracy": accuracy,
    "E20_per_class": per_class, "E21_E22_N7_averages": averages, "E22_report": report, "E23_B10_tracked": tracked, "D16_tracked_by_model": tracked_matrix,
    "G2_F8_top_confusions": top_confusions, "E24_error_shares": error_shares, "G8_confusion_examples": confusion_examples, "B12_label_positions": label_positions,
    "E26_C26_usage": usage, "E28_class_weights": class_weights, "E29_weighted_mean": weighted_mean, "E27_C28_stability": stability, "F7_C31_early_stop": early_stop,
    "D15_hard_reasons": hard_reasons, "E25_selector_combos": selector_counts, "E25_by_selector": by_selector, "B13_D9_subset_accuracy": subset_accuracy,
    "D14_model_merge": model_merge, "F3_F4_few_shot": few_shot, "F6_batches": batches, "I2_prompts": prompts, "I1_C23_parsed_answers": parsed, "I3_I5_payload": payload,
}
_RIGHT = "coalesce(true_label = predicted_label, false)"
_PER = f"""{PREDICTIONS}, {LABEL_DIM}, models as (select distinct model_name from pred),
  per as (select m.model_name, l.label, (select count(*) from pred p where p.model_name = m.model_name and true_label = l.label and predicted_label = l.label) as tp,
    (select count(*) from pred p where p.model_name = m.model_name and true_label = l.label) as support,
    (select count(*) from pred p where p.model_name = m.model_name and predicted_label = l.label) as n_predicted from models m cross join labels l),
  cls as (select model_name, label, case when n_predicted = 0 then 0.0 else cast(tp as double) / n_predicted end as precision,
    case when support = 0 then 0.0 else cast(tp as double) / support end as recall,
    case when n_predicted + support = 0 then 0.0 else cast(tp * 2 as double) / (n_predicted + support) end as f1, support from per)"""
_AVG = """avgs as (select model_name, avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1,
  sum(precision * support) / sum(support) as weighted_precision, sum(recall * support) / sum(support) as weighted_recall, sum(f1 * support) / sum(support) as weighted_f1,
  coalesce(avg(case when support > 0 then f1 end), 0.0) as present_macro_f1, cast(sum(support) as bigint) as support from cls group by 1)"""
_DIRECTIONS = "dirs(true_label, predicted_label) as (values " + ", ".join(f"('{t}', '{p}')" for t, p in TRACKED) + ")"
_REASONS = f"""{PREDICTIONS}, {_DIRECTIONS}, hit as (select distinct record_id, case model_name {' '.join(f"when '{k}' then '{v}'" for k, v in SELECTORS.items())} end as reason
  from pred join dirs using (true_label, predicted_label)), reasons as (select record_id, array_to_string(list_sort(list(reason)), ', ') as reasons from hit where reason is not null group by 1)"""
_RUNS = f"""{PREDICTIONS}, runs as (select model_name, record_id % 5 as seed, avg(cast({_RIGHT} as int)) as accuracy from pred group by 1, 2)"""
_ROUND = lambda cs: ", ".join(f"round({c}, 9) as {c}" for c in cs)
_BATCH = """bat as (select record_id, text, macro_label, (row_number() over (order by record_id) - 1) // 25 as batch_id,
  (row_number() over (order by record_id) - 1) % 25 + 1 as item_id from interim_dataset where split_name = 'dev_core')"""
_T = "processed_text"
_NT = f"len({sql_tokens(_T)})"
_SCORE = f"""((case when {_NT} between 3 and 8 then 8 else 0 end) - abs({_NT} - 5) + (case when contains({_T}, '<USER>') then 0 else 4 end)
  + (case when contains({_T}, 'NUM') then 0 else 3 end) + (case when regexp_matches({_T}, '[A-Za-z]') then 0 else 3 end)
  + (case when regexp_matches({_T}, '[_:/\\\\]') then 0 else 2 end)
  + (case when len(regexp_extract_all({_T}, '[\\x{{600}}-\\x{{6ff}}]')) >= greatest(8, length({_T}) // 2) then 2 else 0 end))"""
_KEYS = f"-({_SCORE}), {_NT}, length({_T}), len(regexp_extract_all({_T}, '[A-Za-z]')), coalesce(source_id, '')"
_BARE = f"regexp_replace({_T}, '^[{WS}]+|[{WS}]+$', '', 'g')"
ORACLES = {
    "F7_C31_early_stop": f"""with recursive {PREDICTIONS}, a as (select model_name, record_id % 5 as seed, avg(cast({_RIGHT} as int)) as value from pred group by 1, 2),
      h as (select model_name, seed, value, row_number() over (partition by model_name order by seed) as i from a),
      st as (select distinct model_name, cast(0 as bigint) as i, cast(null as double) as best, 0 as best_epoch, 0 as bad, 0 as last_epoch, false as stopped from h union all
        select h.model_name, h.i, case when stopped or not up then best else value end, case when stopped or not up then best_epoch else seed end,
          case when stopped then bad when up then 0 else bad + 1 end, case when stopped then last_epoch else seed end, stopped or (not up and bad + 1 >= 2)
        from (select h.model_name, h.i, h.seed, h.value, st.best, st.best_epoch, st.bad, st.last_epoch, st.stopped, st.best is null or h.value > st.best + 0.001 as up
          from st join h on h.model_name = st.model_name and h.i = st.i + 1) as h)
      select model_name, cast(best_epoch as int) as best_epoch, cast(last_epoch as int) as last_epoch, stopped from st qualify row_number() over (partition by model_name order by i desc) = 1""",
    "D9_D10_latest_predictions": f"with {PREDICTIONS} select record_id, model_name, prediction_id, predicted_label from pred",
    "B9_B11_error_flags": "select model_name, is_error, cast(true_label <> predicted_label as varchar) as differs, count(*) as n from model_predictions group by 1, 2, 3",
    "E18_confusion": f"with {PREDICTIONS} select model_name, true_label, predicted_label, count(*) as n from pred group by 1, 2, 3",
    "E17_confusion_matrix": f"""with {PREDICTIONS}, {LABEL_DIM} select m.model_name, l.label as true_label,
      {", ".join(f"count(case when predicted_label = '{x}' then 1 end) as {x}" for x in LABELS)} from (select distinct model_name from pred) m cross join labels l
      left join pred p on p.model_name = m.model_name and p.true_label = l.label group by 1, 2""",
    "E19_accuracy": f"with {PREDICTIONS} select model_name, count(*) as n_rows, avg(cast({_RIGHT} as int)) as accuracy from pred group by 1",
    "E20_per_class": f"with {_PER} select * from cls",
    "E21_E22_N7_averages": f"with {_PER}, {_AVG} select model_name, {_ROUND(['macro_precision', 'macro_recall', 'macro_f1', 'weighted_precision', 'weighted_recall', 'weighted_f1', 'present_macro_f1'])}, support from avgs",
    "E22_report": f"""with {_PER}, {_AVG}, acc as (select model_name, count(*) as n, avg(cast({_RIGHT} as int)) as a from pred group by 1),
      r as (select model_name, label as row, precision, recall, f1, support from cls union all select model_name, 'accuracy', a, a, a, n from acc
        union all select model_name, 'macro avg', macro_precision, macro_recall, macro_f1, support from avgs
        union all select model_name, 'weighted avg', weighted_precision, weighted_recall, weighted_f1, support from avgs)
      select model_name, row, {_ROUND(['precision', 'recall', 'f1'])}, support from r""",
    "E23_B10_tracked": f"""with {PREDICTIONS}, {_DIRECTIONS} select m.model_name, d.true_label, d.predicted_label, count(p.record_id) as n
      from (select distinct model_name from pred) m cross join dirs d left join pred p on p.model_name = m.model_name and p.true_label = d.true_label and p.predicted_label = d.predicted_label group by 1, 2, 3""",
    "D16_tracked_by_model": f"""with {PREDICTIONS}, {_DIRECTIONS} select d.true_label, d.predicted_label, {", ".join(f"count(case when model_name = '{m}' then 1 end) as {m}" for m in MODELS)}
      from dirs d left join pred p on p.true_label = d.true_label and p.predicted_label = d.predicted_label group by 1, 2""",
    "G2_F8_top_confusions": f"""with {PREDICTIONS}, c as (select model_name, true_label, predicted_label, count(*) as n from pred where true_label <> predicted_label group by 1, 2, 3)
      select * from (select *, cast(row_number() over (partition by model_name order by n desc, true_label, predicted_label) as int) as rank from c) where rank <= 10""",
    "E24_error_shares": f"""with {PREDICTIONS}, c as (select model_name, true_label, predicted_label, count(*) as n from pred where true_label <> predicted_label group by 1, 2, 3)
      select *, cast(n as double) / sum(n) over (partition by model_name, true_label) as share from c""",
    "G8_confusion_examples": f"""with {PREDICTIONS} select model_name, true_label, predicted_label, rank, record_id from (select *,
      cast(row_number() over (partition by model_name, true_label, predicted_label order by record_id) as int) as rank from pred where true_label <> predicted_label) where rank <= 10""",
    "B12_label_positions": f"""with {PREDICTIONS}, {LABEL_DIM} select model_name, cast(t.position as int) as true_index, cast(q.position as int) as predicted_index, count(*) as n
      from pred left join labels t on t.label = true_label left join labels q on q.label = predicted_label group by 1, 2, 3""",
    "E26_C26_usage": f"""with r as (select model_name, len(string_split(true_label, '_')) as w, case when isnan(latency_ms) then null else latency_ms end as ms from model_predictions),
      s as (select model_name, count(*) as n_requests, cast(coalesce(sum(w * 10), 0) as bigint) as prompt_tokens, cast(coalesce(sum(w), 0) as bigint) as completion_tokens, coalesce(sum(ms), 0.0) as total from r group by 1)
      select model_name, n_requests, prompt_tokens, completion_tokens, round(total, 9) as total_latency_ms, round(total / n_requests, 9) as latency_per_request_ms,
        round(prompt_tokens / 1e6 * {PRICES[0]} + completion_tokens / 1e6 * {PRICES[1]}, 9) as cost from s""",
    "E28_class_weights": f"""with c as (select macro_label, count(*) as n from interim_dataset where split_name = 'train_core' and macro_label in ({', '.join(repr(x) for x in LABELS)}) group by 1)
      select macro_label, n, cast(sum(n) over () as double) / (count(*) over () * n) as weight from c""",
    "E29_weighted_mean": f"""with {PREDICTIONS}, c as (select model_name, true_label, count(*) as n, avg(cast(not {_RIGHT} as int)) as loss from pred group by 1, 2)
      select model_name, round(sum(loss * n) / sum(n), 9) as mean from c group by 1""",
    "E27_C28_stability": f"""with {_RUNS}, s as (select model_name, count(*) as n_seeds, avg(accuracy) as m, stddev_samp(accuracy) as d from runs group by 1)
      select model_name, n_seeds, round(m, 9) as mean, round(d, 9) as deviation, case when d < 0.005 then '{tiers.STABILITY[0]}' when d <= 0.015 then '{tiers.STABILITY[1]}' else '{tiers.STABILITY[2]}' end as tier from s""",
    "D15_hard_reasons": f"with {_REASONS} select * from reasons",
    "E25_selector_combos": f"with {_REASONS} select reasons as selectors, count(*) as n from reasons group by 1",
    "E25_by_selector": f"with {_REASONS} select reason as selector, count(*) as n from hit where reason is not null group by 1",
    "B13_D9_subset_accuracy": f"with {_REASONS} select model_name, count(*) as n_rows, avg(cast({_RIGHT} as int)) as accuracy from pred where record_id in (select record_id from reasons) group by 1",
    "D14_model_merge": f"""with {PREDICTIONS}, a as (select model_name, avg(cast({_RIGHT} as int)) as accuracy from pred group by 1),
      l as (select model_name, round(avg(latency_ms), 6) as latency_ms from pred where latency_ms is not null and not isnan(latency_ms) group by 1)
      select model_name, accuracy, latency_ms from a full join l using (model_name)""",
    "F3_F4_few_shot": f"""with t as (select coalesce(source_id, '') as source_id, macro_label as label, coalesce(processed_text, '') as processed_text from ood_leakage_precheck
        where split_name = 'train_core' and macro_label in ({', '.join(repr(x) for x in LABELS)})),
      f as (select *, row_number() over (partition by label, {_BARE} order by {_KEYS}, {_T}) as k from t where {_BARE} <> ''),
      g as (select *, cast(row_number() over (partition by label order by {_KEYS}, {_T}) as int) as rank from f where k = 1)
      select label, rank, source_id, sha1(processed_text) as text from g where rank <= 3""",
    "F6_batches": f"with {_BATCH} select record_id, batch_id, item_id from bat",
    "I2_prompts": f"""with {_BATCH} select batch_id, count(*) as n_items, sha1('Classify ' || count(*) || ' Arabic short texts.' || chr(10) || '{inference.FORMAT}' || chr(10) || '{inference.ONCE}' || chr(10)
      || 'Each label must be one of: {", ".join(LABELS)}.' || chr(10) || chr(10) || '{inference.ITEMS_HEADING}' || chr(10)
      || string_agg(item_id || chr(9) || coalesce(text, ''), chr(10) order by item_id)) as prompt_hash from bat group by 1""",
    "I1_C23_parsed_answers": f"select record_id, macro_label as predicted_label from interim_dataset where split_name = 'dev_core' and macro_label in ({', '.join(repr(x) for x in LABELS)})",
    "I3_I5_payload": f"""with {PREDICTIONS} select model_name, '{{"n_rows":' || count(*) || ',"saudi":{{"support":' || count(case when true_label = 'Saudi' then 1 end) || '}}}}' as payload from pred group by 1""",
}
