"""Profiles of raw files, and texts that occur in several of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import fingerprint, row_fingerprint, strip_ws, token_count

SHORT = 3
# Groups of files, in report order.
GROUPS = ["benchmark_anchor", "canonical_supporting", "provenance_aux_eval", "unlabeled_id_only", "out_of_scope"]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def profile(rows: DataFrame, file: str, columns: list[str], texts: list[str]) -> DataFrame:
    """Rows, repeated rows, and empty and short texts of every file.

    Repeats are counted by a two-step aggregate on the row's fingerprint, so a
    file may hold any share of the rows.
    """
    empty = lambda t: F.sum((strip_ws(_text(t)) == "").cast("long"))
    short = lambda t: F.sum((token_count(strip_ws(_text(t))) < SHORT).cast("long"))
    parts = [x for t in texts for x in (empty(t).alias(f"e_{t}"), short(t).alias(f"s_{t}"))]
    by_row = rows.groupBy(file, row_fingerprint(*[F.col(c) for c in columns]).alias("fp")).agg(F.count(F.lit(1)).alias("n"), *parts)
    sums = lambda kind: sum((F.sum(f"{kind}_{t}") for t in texts), F.lit(0)).cast("long")
    return by_row.groupBy(file).agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"), sums("e").alias("n_empty"), sums("s").alias("n_short")
    )


def class_counts(rows: DataFrame, file: str, classes: list[str]) -> DataFrame:
    """Rows of every value of every class column of every file; blank reads <EMPTY>."""
    value = lambda c: F.when(strip_ws(_text(c)) == "", "<EMPTY>").otherwise(strip_ws(_text(c)))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in classes])
    return rows.select(file, F.explode(pairs).alias("x")).groupBy(file, "x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def repeated_rows(rows: DataFrame, file: str, columns: list[str], order: list[str], limit: int = 5) -> DataFrame:
    """The first ``limit`` rows of each file that repeat an earlier row of it.

    The first occurrence comes from an aggregate and is joined back, so a row
    that recurs without end isn't sorted in one task.
    """
    marked = rows.withColumn("fp", row_fingerprint(*[F.col(c) for c in columns])).withColumn("at", F.struct(*order))
    firsts = marked.groupBy(file, "fp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = marked.join(firsts, [file, "fp"]).where(F.col("at") > F.col("first")).drop("fp", "at", "first", "n")
    return first_rows(again, [file], order, limit)


def first_rows(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key in the given order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def group_summary(profiles: DataFrame, group: Column) -> DataFrame:
    """Files, rows, and files with repeats, empty or short texts of every group."""
    has = lambda c: F.sum((F.col(c) > 0).cast("long"))
    sums = profiles.groupBy(group.alias("file_group")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), has("n_duplicates").alias("n_files_with_duplicates"),
        has("n_empty").alias("n_files_with_empty"), has("n_short").alias("n_files_with_short"),
    )
    return sums


def with_all_groups(summary: DataFrame, groups: list[str]) -> DataFrame:
    """``summary`` with a row of zeros for each group that has no file."""
    every = summary.sparkSession.createDataFrame([(i, g) for i, g in enumerate(groups)], "position int, file_group string")
    zeros = {c: 0 for c in summary.columns if c.startswith("n_")}
    return every.join(summary, "file_group", "left").fillna(zeros).drop("position")


def occurrences(rows: DataFrame, file: str, label: Column) -> DataFrame:
    """(file, text_hash, label) of every row whose text isn't blank."""
    text = strip_ws(_text("text"))
    return rows.where(text != "").select(F.col(file).alias("file"), fingerprint(text).alias("text_hash"), label.alias("label"))


def texts_in_several_files(found: DataFrame) -> DataFrame:
    """text_hash and number of files of texts that more than one file holds."""
    return found.groupBy("text_hash").agg(F.countDistinct("file").alias("n_files")).where("n_files > 1")


def file_pairs(found: DataFrame) -> DataFrame:
    """(file_a, file_b, n_shared): distinct texts that two files share.

    Distinct (text, file) rows meet on the text, so each gives the pairs that the
    report needs and no row holds a list of files; pairs are counted on the map side.
    """
    held = found.select("text_hash", "file").distinct()
    a, b = held.withColumnRenamed("file", "file_a"), held.withColumnRenamed("file", "file_b")
    return a.join(b, "text_hash").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n_shared"))


def cross_file_conflicts(found: DataFrame) -> DataFrame:
    """Texts in several files with several labels: files, labels, occurrences."""
    groups = found.groupBy("text_hash").agg(
        F.countDistinct("file").alias("n_files"), F.array_sort(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("n_rows")
    )
    return groups.where((F.col("n_files") > 1) & (F.size("labels") > 1))
