"""Overlap, duplicates and similarity between a candidate split and a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.hashing import key128
from corpusloom.functions.labels import LABELS, label_dimension
from corpusloom.functions.text import jaccard, length_bound, percentage, token_set
from corpusloom.plans.lineage import cut


def shared_values(reference: DataFrame, candidate: DataFrame, field: str) -> DataFrame:
    """Distinct values of ``field`` that both sides hold."""
    return candidate.select(field).distinct().join(reference.select(field).distinct(), field, "left_semi")


def shared_ids(reference: DataFrame, candidate: DataFrame, field: str) -> DataFrame:
    """Distinct candidate source_ids whose ``field`` occurs in the reference."""
    return candidate.join(reference.select(field).distinct(), field, "left_semi").select("source_id").distinct()


def representative_pairs(reference: DataFrame, candidate: DataFrame, field: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` (reference_id, candidate_id) pairs of equal ``field``.

    Both sides are first cut to the rows that a pair among the first ones can
    use, per value, so a hot value doesn't multiply.
    """
    few = lambda df, name: (
        df.withColumn("_r", F.row_number().over(W.partitionBy(field).orderBy(*order))).where(F.col("_r") <= limit)
        .select(field, F.col("source_id").alias(f"{name}_id"), F.struct(*order).alias(f"{name}_order"))
    )
    pairs = few(reference, "reference").join(few(candidate, "candidate"), field)
    return pairs.orderBy("candidate_order", "reference_order").limit(limit).select("reference_id", "candidate_id")


def any_shared_ids(reference: DataFrame, candidate: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct candidate source_ids that any of ``fields`` ties to the reference."""
    out = shared_ids(reference, candidate, fields[0])
    for field in fields[1:]:
        out = out.union(shared_ids(reference, candidate, field))
    return out.distinct()


def missing_ids(rows: DataFrame, processed: DataFrame) -> DataFrame:
    """source_ids of ``rows`` that ``processed`` lacks."""
    return rows.select("source_id").distinct().join(processed.select("source_id").distinct(), "source_id", "left_anti")


def reference_index(interim: DataFrame, processed: DataFrame) -> DataFrame:
    """(field, value, source_id): who holds each value of a reference, one row for each.

    Kept as rows, not as lists: a value may be held by any share of the ids.
    """
    pairs = [
        interim.select(F.lit("source_id").alias("field"), F.col("source_id").alias("value"), "source_id"),
        interim.select(F.lit("original_text"), F.col("text"), "source_id"),
        processed.select(F.lit("source_id"), F.col("source_id"), "source_id"),
        processed.select(F.lit("original_text"), F.col("original_text"), "source_id"),
        processed.select(F.lit("processed_text"), F.col("processed_text"), "source_id"),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    return out.distinct()


def duplicate_groups(rows: DataFrame, field: str) -> DataFrame:
    """Values held by several rows, with their number and smallest source_id."""
    groups = rows.groupBy(field).agg(F.count(F.lit(1)).alias("n_rows"), F.min("source_id").alias("first_id"))
    return groups.where("n_rows > 1")


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """Number of groups and of rows beyond the first of each."""
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n_additional_rows"))


#: Tokens that make up at least this part of all are ordered by their exact number
#: (so there are at most this many), the others by the token alone.
FREQUENT = 16384


def _token_set(text: str) -> Column:
    return F.array_sort(token_set(F.coalesce(text, F.lit(""))))


def similar_pairs(reference: DataFrame, candidate: DataFrame, threshold: float, text: str = "processed_text") -> DataFrame:
    """(a1, a2, b1, b2, similarity): keys of distinct token sets whose Jaccard similarity exceeds ``threshold``.

    Exact prefix filter: tokens are put in one order, rare ones first, and two sets
    above the threshold share a token among the first n - ceil(t * n) + 1 of each.
    Only (token, key, size, position) travel; sizes and positions decide in the join
    which pairs are left, and only these fetch their sets.  Equal sets are one row,
    so hot texts cost nothing, and stop words stand behind every prefix.
    """
    keyed = lambda df, side: df.select(F.lit(side).alias("side"), _token_set(text).alias("s")).where(F.size("s") > 0).distinct()
    sets = cut(keyed(reference, 0).union(keyed(candidate, 1)).select("side", *key128(F.col("s")), "s"))
    words = sets.select("side", "k1", "k2", F.explode("s").alias("token"))
    total = sets.agg(F.sum(F.size("s")).alias("t")).first()["t"] or 0
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, -(-total // FREQUENT)))
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")
    ordered = words.join(F.broadcast(counts), "token", "left").groupBy("side", "k1", "k2").agg(F.array_sort(F.collect_list(place)).alias("o"))
    size = F.size("o")
    needed = F.greatest(F.ceil(size * threshold - 1e-9).cast("int"), F.lit(1))
    prefix = ordered.select("side", "k1", "k2", size.alias("n"), F.posexplode(F.slice("o.token", F.lit(1), size - needed + 1)).alias("i", "token"))
    of = lambda side, p: prefix.where(F.col("side") == side).select("token", *[F.col(c).alias(f"{p}{d}") for c, d in (("k1", 1), ("k2", 2), ("n", "n"), ("i", "i"))])
    most = F.least(F.col("an") - F.col("ai"), F.col("bn") - F.col("bi"))
    close = (length_bound(F.col("an"), F.col("bn")) > threshold) & (most / (F.col("an") + F.col("bn") - most) > threshold)
    found = of(0, "a").join(of(1, "b"), "token").where(close).select("a1", "a2", "b1", "b2").distinct()
    held = lambda side, p: sets.where(F.col("side") == side).select(F.col("k1").alias(f"{p}1"), F.col("k2").alias(f"{p}2"), F.col("s").alias(f"{p}s"))
    known = found.join(held(0, "a"), ["a1", "a2"]).join(held(1, "b"), ["b1", "b2"])
    return known.select("a1", "a2", "b1", "b2", jaccard(F.col("as"), F.col("bs")).alias("similarity")).where(F.col("similarity") > threshold)


def similar_rows(reference: DataFrame, candidate: DataFrame, threshold: float, text: str = "processed_text") -> DataFrame:
    """``candidate`` rows with a reference text above the threshold, and n_links: how many reference rows have one.

    Rows of equal token sets are counted before the join.
    """
    copies = reference.groupBy(*key128(_token_set(text), ("a1", "a2"))).agg(F.count(F.lit(1)).alias("n"))
    links = similar_pairs(reference, candidate, threshold, text).join(copies, ["a1", "a2"]).groupBy("b1", "b2").agg(F.sum("n").alias("n_links"))
    rows = candidate.select("*", *key128(_token_set(text), ("b1", "b2")))
    return rows.join(links, ["b1", "b2"]).drop("b1", "b2")


def first_partners(reference: DataFrame, candidate: DataFrame, threshold: float, text: str = "processed_text") -> DataFrame:
    """The smallest reference id above the threshold of each candidate row, with the similarity."""
    pairs = similar_pairs(reference, candidate, threshold, text)
    holders = reference.groupBy(*key128(_token_set(text), ("a1", "a2"))).agg(F.min("record_id").alias("reference_id"))
    best = pairs.join(holders, ["a1", "a2"]).groupBy("b1", "b2").agg(F.min(F.struct("reference_id", "similarity")).alias("x"))
    rows = candidate.select(F.col("record_id").alias("candidate_id"), *key128(_token_set(text), ("b1", "b2")))
    return rows.join(best, ["b1", "b2"]).select("candidate_id", "x.reference_id", "x.similarity")


def label_distribution(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of each target label, 0 where there is none, and their percentage."""
    keys = keys or []
    spark = rows.sparkSession
    dim = F.broadcast(label_dimension(spark))
    counts = rows.where(F.col("macro_label").isin(LABELS)).groupBy(*keys, "macro_label").agg(F.count(F.lit(1)).alias("n"))
    every = rows.select(*keys).distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS]))) if keys else dim.select("label")
    on = [*keys, "label"]
    full = every.join(counts.withColumnRenamed("macro_label", "label"), on, "left").fillna(0, ["n"])
    total = F.sum("n").over(W.partitionBy(*[F.col(k) for k in keys]) if keys else W.partitionBy(F.lit(1)))
    return full.select(*on, "n", percentage(F.col("n"), total).alias("percent"))


def distribution_delta(candidate: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and percentages of two distributions and their differences."""
    b = benchmark.select("label", F.col("n").alias("benchmark_n"), F.col("percent").alias("benchmark_percent"))
    return candidate.join(b, "label").select(
        "label", "n", "percent", "benchmark_n", "benchmark_percent",
        (F.col("n") - F.col("benchmark_n")).alias("delta_n"), F.round(F.col("percent") - F.col("benchmark_percent"), 2).alias("delta_percent"),
    )


def label_inventory(rows: DataFrame) -> DataFrame:
    """Rows of every normalized raw label and whether it is mapped."""
    return rows.groupBy("normalized_raw_label").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("macro_label").isNotNull()).alias("is_mapped"))


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n, status): ``block`` if any hard check counts more than 0."""
    out = None
    for name, found in checks.items():
        row = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = row if out is None else out.union(row)
    worst = F.max("n").over(W.partitionBy(F.lit(1)))
    return out.select("check_name", "n", F.when(worst > 0, "block").otherwise("pass").alias("status"))
