"""Picking rows: few-shot examples, batches, and the hard subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS, is_tracked
from corpusloom.functions.text import latin_count, strip_ws, support_score, token_count
from corpusloom.plans.lineage import cut


def few_shot(rows: DataFrame, text: str, label: str, per_class: int) -> DataFrame:
    """The best ``per_class`` examples of each target label, distinct in stripped text.

    Repeated texts are reduced by an aggregate (the smallest key of each text)
    before the ranking, so a hot text is one row.
    """
    key = F.struct(
        (-support_score(F.col(text))).alias("s"), token_count(F.col(text)).alias("t"), F.length(text).alias("c"),
        latin_count(F.col(text)).alias("l"), F.coalesce("source_id", F.lit("")).alias("source_id"),
    )
    own = rows.where(F.col(label).isin(LABELS) & (strip_ws(F.col(text)) != ""))
    first = own.groupBy(F.col(label).alias("label"), strip_ws(F.col(text)).alias("bare")).agg(F.min(F.struct(key.alias("k"), F.col(text).alias("text"))).alias("x"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("x.k", "x.text")))
    return ranked.where(F.col("rank") <= per_class).select("label", "rank", F.col("x.k.source_id").alias("source_id"), F.col("x.text").alias("text"))


def require_per_class(chosen: DataFrame, per_class: int) -> DataFrame:
    """``chosen`` if every label has its examples, else an error."""
    held = {r.label: r.n for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    lacking = [x for x in LABELS if held.get(x, 0) < per_class]
    if lacking:
        raise ValueError(f"not enough examples for {', '.join(lacking)}")
    return chosen


def numbered(rows: DataFrame, order: list[str], name: str = "position", parts: int | None = None) -> DataFrame:
    """``rows`` with their position from 0 in the total order of ``order``, nulls first.

    The rows are cut into ranges of all order columns (as many as the session's
    shuffle partitions, or ``parts``), so a hot first value is cut by the next
    column; each range is ordered and kept in the shared folder.  A row's position
    is its place in its range behind the rows of the ranges before, of which there is
    one number each.
    """
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    kept = cut(ranged.sortWithinPartitions(*order))
    placed = kept.withColumn("_place", F.monotonically_increasing_id())
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row for each range
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + place).drop("_part", "_place", "_start")


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with batch_id from 0 and item_id from 1 inside each batch."""
    placed = numbered(rows, order)
    return placed.withColumn("batch_id", F.floor(F.col("position") / size)).withColumn("item_id", F.col("position") % size + 1).drop("position")


def hard_reasons(predictions: DataFrame, names: dict[str, str], key: str = "record_id") -> DataFrame:
    """key and sorted reasons of rows with a tracked confusion.

    ``names`` gives the selector's name for each model_name.
    """
    named = F.lit(None).cast("string")
    for model, name in names.items():
        named = F.when(F.col("model_name") == model, name).otherwise(named)
    hits = predictions.where(is_tracked(F.col("true_label"), F.col("predicted_label"))).select(key, named.alias("reason")).where("reason is not null")
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def hard_subset(rows: DataFrame, reasons: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows with a reason."""
    return rows.join(reasons, key)


def combinations(reasons: DataFrame) -> DataFrame:
    """Rows of every combination of reasons."""
    return reasons.groupBy(F.array_join("reasons", ", ").alias("selectors")).agg(F.count(F.lit(1)).alias("n"))


def by_selector(reasons: DataFrame) -> DataFrame:
    """Rows that each selector picked."""
    return reasons.select(F.explode("reasons").alias("selector")).groupBy("selector").agg(F.count(F.lit(1)).alias("n"))


def subset_predictions(subset: DataFrame, predictions: DataFrame, key: str = "record_id") -> DataFrame:
    """The prediction of every subset row; a row without one is an error."""
    joined = subset.join(predictions, key, "left")
    found = F.col("predicted_label")
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string")))
    return joined.withColumn("predicted_label", F.when(found.isNotNull(), found).otherwise(missing))


def clean_split(dev: DataFrame, train: DataFrame, field: str = "processed_text") -> DataFrame:
    """``dev`` without rows whose ``field`` equals one of ``train``."""
    return dev.join(train.select(field).distinct(), field, "left_anti")


def examples(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of every key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)
