"""Problem 4: near-duplicate records, by an exact prefix-filter join of word sets.

The method named for the problem, Voronoi regions of document pivots under the
Jaccard distance, is in ``voronoi_join``; its windows cover nearly all regions on
short posts (figures in the README), so this join is used instead.

Documents are their word sets; equal sets are one document until the end.  Words
are put in one order for all, rare ones first.  Two documents above the threshold
t share a word among the first n - floor(t * n) of each, so a document is copied to
the regions of just these words.  A copy carries no words, but the size, the
word's position and a signature of 128 parity bits: the bits in which two
signatures differ are at most the words in which the sets differ, so sizes,
positions and signatures decide within the join which pairs are left.  Only these
are made distinct, get their words and are verified.

Regions of more than REGION documents are joined recursively: a pair above the
threshold shares further words among the first ones, so the region's key takes the
next common word, up to DEPTH words; regions that are large even then are cut into
rings of the partner sizes that position and size allow.  Copies of
documents of more than LONG words don't recurse (their further words would be too
many); in large regions they meet the others directly.

Words are ordered by exact counts where they make up at least 1/16384 of all
(at most 16384 words, by counting), and by hash otherwise.

Defined cases: rows without an id and texts without words are in no pair; a similarity of exactly t is
no pair; texts of any length are compared whole; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import key128
from corpusloom.llm.words import word_set
from corpusloom.llm.components import components
from corpusloom.plans.lineage import cut
from corpusloom.plans.shipping import ship

#: Similarity above 7/10, as a fraction.
THRESHOLD = (7, 10)
#: Documents that a region may hold before it is split, and the most words of its key.
REGION, DEPTH = 4096, 3
FREQUENT = 16384
#: Words up to which a document's copies recurse.
LONG = 256


def documents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, k1, k2) of every record with id and words, and one row per word set."""
    rows = df.where("record_id is not null").select("record_id", word_set(F.col("text")).alias("w")).where("size(w) > 0")
    rows = rows.select("record_id", *key128(F.col("w")), "w")
    sets = rows.groupBy("k1", "k2").agg(F.first("w").alias("w"), F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return rows.select("record_id", "k1", "k2"), cut(sets)


def _ordered(sets: DataFrame) -> DataFrame:
    """k1, k2, side and the words of each set of three or more, rare ones first.

    Smaller sets have no partner above 7/10 but their equals.
    """
    if "side" not in sets.columns:
        sets = sets.withColumn("side", F.lit(0))
    total = sets.agg(F.sum(F.size("w")).alias("t")).first()["t"] or 0
    counts = sets.select(F.explode("w").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") >= max(2, -(-total // FREQUENT))).collect()
    by_word = sorted((r.v, r.n) for r in often)
    words, weight = np.array([v for v, _ in by_word], np.int64), np.array([n for _, n in by_word], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            count = np.zeros(len(values), np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, values), len(words) - 1)
                count = np.where(words[at] == values, weight[at], 0)
            sorted_ = values[np.lexsort((values, count, rows))]
            w = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(sorted_))
            bits = np.left_shift(np.uint64(1), (sorted_ & 63).astype(np.uint64))
            half = (sorted_ & 64) > 0
            parity = [np.bitwise_xor.reduceat(np.where(half == h, bits, np.uint64(0)), offsets[:-1] - offsets[0]) if len(rows) else bits for h in (False, True)]
            columns = [batch.column("k1"), batch.column("k2"), batch.column("side"), w, *[pa.array(x.view(np.int64)) for x in parity]]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "side", "w", "s1", "s2"])

    return sets.where("size(w) >= 3").select("k1", "k2", "side", "w").mapInArrow(run, "k1 long, k2 long, side int, w array<long>, s1 long, s2 long")


COPY = ["region", "k1", "k2", "side", "n", "i", "s1", "s2"]


def _windows(rows: DataFrame, depth: int, t: tuple[int, int]) -> DataFrame:
    """Copies of ``rows`` (region, k1, k2, side, w, i, ...) in the regions with one word more."""
    n = F.size("w")
    least_common = F.floor(n * t[0] / t[1]).cast("int") + 1
    grown = rows.select("region", "k1", "k2", "side", "w", "s1", "s2", n.alias("n"), F.explode(F.sequence(F.col("i") + 1, n - least_common + depth - 1)).alias("i"))
    return grown.withColumn("region", F.xxhash64("region", F.element_at("w", F.col("i") + 1)))


def _candidates(a: DataFrame, b: DataFrame, depth: int, t: tuple[int, int], two_sided: bool, also: Column | None = None) -> DataFrame:
    """Pairs of copies of one region that sizes, positions and signatures leave."""
    a, b = a.alias("a"), b.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    order = (F.col("a.k1") < F.col("b.k1")) | ((F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") < F.col("b.k2")))
    if two_sided:
        order = (F.col("a.side") == 0) & (F.col("b.side") == 1)
    enough = lambda o: o * (t[0] + t[1]) > (na + nb) * t[0]
    ahead = F.least(na - F.col("a.i"), nb - F.col("b.i")) + (depth - 1)
    apart = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in ("s1", "s2")), F.lit(0))
    match = (F.col("a.region") == F.col("b.region")) & order & enough(F.least(na, nb)) & enough(ahead)
    match &= apart * (t[0] + t[1]) < (na + nb) * (t[1] - t[0])
    if also is not None:
        match &= also
    return a.join(b, match).select(*[F.col(f"{p}.k{i}").alias(f"{p}{i}") for p in "ab" for i in (1, 2)])


def _ringed(rows: DataFrame, depth: int, t: tuple[int, int]) -> DataFrame:
    """Copies of ``rows`` for each partner size ``m`` that their place in the region allows."""
    left = F.col("n") - F.col("i") + depth - 1
    low = F.floor(F.col("n") * t[0] / t[1]).cast("int") + 1
    high = F.floor((left * (t[0] + t[1]) - 1) / t[0]).cast("int") - F.col("n")
    return rows.where(high >= low).withColumn("m", F.explode(F.sequence(low, F.greatest(low, high))))


def set_pairs(sets: DataFrame, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a1, a2, b1, b2) of different word sets above the threshold, each pair once."""
    ship(sets.sparkSession)
    two_sided = "side" in sets.columns
    every = _ordered(sets)
    rows = every.withColumns({"i": F.lit(-1), "region": F.lit(0).cast("long")})
    found: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        whole = _windows(rows, depth, t)
        copies = whole.select(*COPY)
        held = copies.groupBy("region").agg(F.count(F.lit(1)).alias("n_held")).where("n_held > 1")
        large = cut(held.where(F.col("n_held") > REGION).select("region"))
        small = copies.join(held.where(F.col("n_held") <= REGION).select("region"), "region")
        found.append(_candidates(small, small, depth, t, two_sided))
        if large.isEmpty():
            break
        if depth == 1:
            hot = copies.join(large, "region")
            longer = F.greatest("a.n", "b.n") > LONG
            if not hot.where(F.col("n") > LONG).isEmpty():
                found.append(_candidates(hot.where(F.col("n") > LONG * t[0] / t[1]), hot.where(F.col("n") > LONG * t[0] / t[1]), depth, t, two_sided, longer))
        rows = cut(whole.where(F.col("n") <= LONG).join(large, "region"))
    else:
        ringed = _ringed(rows.select(*COPY), DEPTH, t)
        found.append(_candidates(ringed, ringed, DEPTH, t, two_sided, (F.col("a.n") == F.col("b.m")) & (F.col("a.m") == F.col("b.n"))))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    side = lambda s: F.col("side") == s if two_sided else F.lit(True)
    words = lambda p, s: sets.where(side(s)).select(F.col("k1").alias(f"{p}1"), F.col("k2").alias(f"{p}2"), F.col("w").alias(f"{p}w"))
    known = pairs.join(words("a", 0), ["a1", "a2"]).join(words("b", 1), ["b1", "b2"])
    common = F.size(F.array_intersect("aw", "bw"))
    return known.where(common * (t[0] + t[1]) > (F.size("aw") + F.size("bw")) * t[0]).select("a1", "a2", "b1", "b2")


def similar(df: DataFrame) -> DataFrame:
    """(id_a, id_b) of records above the threshold, equal ones included."""
    ids, sets = documents(df)
    pairs = set_pairs(sets)
    a = ids.select(F.col("record_id").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    b = ids.select(F.col("record_id").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    different = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("x", "y")
    repeated = sets.where("n_copies > 1").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    kept = a.join(repeated, ["a1", "a2"])
    equal = kept.join(kept.withColumnRenamed("x", "y"), ["a1", "a2"]).where("x < y").select("x", "y")
    return different.unionByName(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(df: DataFrame) -> DataFrame:
    """record_id, group_id (smallest id reached) and n_links of every record with words."""
    ids, sets = documents(df)
    key = lambda p: sets.select(F.col("k1").alias(f"{p}1"), F.col("k2").alias(f"{p}2"), F.col("first_id").alias(p), F.col("n_copies").alias(f"n{p}"))
    pairs = cut(set_pairs(sets).join(key("a"), ["a1", "a2"]).join(key("b"), ["b1", "b2"]).select("a", "b", "na", "nb"))
    links = pairs.select(F.col("a").alias("first_id"), F.col("nb").alias("n")).union(pairs.select("b", "na"))
    links = links.groupBy("first_id").agg(F.sum("n").alias("n"))
    label = components(pairs).select(F.col("node").alias("first_id"), "label")
    of = sets.join(label, "first_id", "left").join(links, "first_id", "left").select(
        "k1", "k2", F.coalesce("label", "first_id").alias("group_id"), (F.coalesce("n", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")
    )
    return ids.join(of, ["k1", "k2"]).select("record_id", "group_id", "n_links")
