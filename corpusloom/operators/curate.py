"""Leakage-safe splits: one reason for every dropped row.

All facts that a row's fate needs (is its text in the raw training split, in the
kept training or dev rows, labelled inconsistently in the supporting pool) hang
on the text's fingerprint, so they come from a single aggregate by fingerprint,
combined on the map side, and one join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.labels import macro, normalized
from corpusloom.functions.text import fingerprint, strip_ws

TRAIN, DEV, AUG = "train_core", "dev_core", "train_aug_candidates"
OUTPUTS = [TRAIN, DEV, AUG]
# Reasons for dropping a row.
OUT_OF_SCOPE = "out_of_scope_country"
TRAIN_OVERLAP_OF_DEV = "benchmark_exact_overlap_with_train"
CONFLICT = "conflicting_supporting_label"
TRAIN_OVERLAP_OF_AUG = "overlap_with_train_core"
DEV_OVERLAP_OF_AUG = "overlap_with_dev_core"
INTERIM = ["source_dataset", "source_file", "source_id", "source_row_number", "text", "raw_label", "normalized_raw_label", "macro_label"]


def blank(column: str) -> Column:
    """A column of a text table: null reads as ''."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def records(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows with stripped ids and labels, macro label (null: out of scope) and text_hash.

    ``rows`` needs split_name, the source columns, text and raw_label.
    """
    label = normalized(F.col("raw_label"))
    return rows.select(
        *(keep or []), "split_name", blank("source_dataset").alias("source_dataset"), blank("source_file").alias("source_file"),
        strip_ws(blank("source_id")).alias("source_id"), "source_row_number", blank("text").alias("text"),
        strip_ws(blank("raw_label")).alias("raw_label"), label.alias("normalized_raw_label"), macro(label).alias("macro_label"),
        fingerprint(strip_ws(blank("text"))).alias("text_hash"),
    )


def text_facts(rows: DataFrame) -> DataFrame:
    """One row for each text_hash: where it occurs, and whether its labels conflict."""
    split, scoped = F.col("split_name"), F.col("macro_label").isNotNull()
    label = F.when(split == AUG, F.col("normalized_raw_label"))
    facts = rows.groupBy("text_hash").agg(
        F.max(split == TRAIN).alias("in_raw_train"),
        F.max((split == TRAIN) & scoped).alias("in_train"),
        F.max((split == DEV) & scoped).alias("scoped_dev"),
        F.min(label).alias("low"), F.max(label).alias("high"),
    )
    return facts.select(
        "text_hash", "in_raw_train", "in_train",
        (F.col("scoped_dev") & ~F.col("in_raw_train")).alias("in_dev"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("conflict"),
    )


def drop_reason() -> Column:
    """Why a row with its facts is dropped, first reason first; null if it is kept."""
    split, unscoped = F.col("split_name"), F.when(F.col("macro_label").isNull(), OUT_OF_SCOPE)
    dev = F.when(F.col("in_raw_train"), TRAIN_OVERLAP_OF_DEV).otherwise(unscoped)
    aug = (
        F.when(F.col("conflict"), CONFLICT)
        .when(F.col("in_train"), TRAIN_OVERLAP_OF_AUG)
        .when(F.col("in_dev"), DEV_OVERLAP_OF_AUG)
        .otherwise(unscoped)
    )
    return F.when(split == TRAIN, unscoped).when(split == DEV, dev).when(split == AUG, aug)


def curate(rows: DataFrame) -> DataFrame:
    """``rows`` (records) of the three outputs with drop_reason (null: kept)."""
    own = rows.where(F.col("split_name").isin(OUTPUTS))
    return own.join(text_facts(own), "text_hash").withColumn("drop_reason", drop_reason()).drop("in_raw_train", "in_train", "in_dev", "conflict")


def output(curated: DataFrame, split: str) -> DataFrame:
    """Kept rows of one output in the interim schema, original order."""
    kept = curated.where((F.col("split_name") == split) & F.col("drop_reason").isNull())
    return kept.select(*INTERIM[:-1], F.coalesce("macro_label", F.lit("")).alias("macro_label")).orderBy("source_file", "source_row_number")


def statistics(curated: DataFrame) -> DataFrame:
    """(output, dimension, key, n) of kept and dropped rows, and over all outputs.

    ``output`` is '(all)' in the roll-up.  One pass: grouping sets over the three
    dimensions.
    """
    kept = F.col("drop_reason").isNull()
    long = curated.select(
        F.col("split_name").alias("output"),
        F.explode(F.array(
            F.struct(F.lit("kept_by_source").alias("dimension"), F.when(kept, F.col("source_dataset")).alias("key")),
            F.struct(F.lit("kept_by_label").alias("dimension"), F.when(kept, F.col("macro_label")).alias("key")),
            F.struct(F.lit("dropped_by_reason").alias("dimension"), F.col("drop_reason").alias("key")),
        )).alias("x"),
    ).select("output", "x.dimension", "x.key").where("key is not null")
    counted = long.groupingSets([["output", "dimension", "key"], ["dimension", "key"]], "output", "dimension", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.coalesce("output", F.lit("(all)")).alias("output"), "dimension", "key", "n")


def conflicts(rows: DataFrame) -> DataFrame:
    """text_hash, sorted labels and rows of supporting texts with several labels."""
    pool = rows.where(F.col("split_name") == AUG)
    groups = pool.groupBy("text_hash").agg(F.array_sort(F.collect_set("normalized_raw_label")).alias("labels"), F.count(F.lit(1)).alias("n_rows"))
    return groups.where(F.size("labels") > 1)


def conflict_examples(rows: DataFrame, order: list[str], limit: int = 20) -> DataFrame:
    """The first ``limit`` conflicts in the order that their first row occurs."""
    pool = rows.where(F.col("split_name") == AUG)
    low = F.min(F.struct(*order)).alias("first")
    groups = pool.groupBy("text_hash").agg(F.array_sort(F.collect_set("normalized_raw_label")).alias("labels"), low)
    return groups.where(F.size("labels") > 1).orderBy("first").limit(limit).select("text_hash", "labels").orderBy("text_hash")


def overlap_counts(curated: DataFrame) -> DataFrame:
    """Texts and rows removed from each output for each reason."""
    dropped = curated.where("drop_reason is not null")
    return dropped.groupBy("split_name", "drop_reason").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("text_hash").alias("n_texts"))


def processed(rows: DataFrame, clean) -> DataFrame:
    """Rows with original_text and processed_text in place of text."""
    return rows.withColumn("original_text", F.col("text")).withColumn("processed_text", clean(F.col("text"))).drop("text")
