"""The method named for problem 4: a Jaccard metric-space join over document pivots.

Sampled documents (those of least hash) are the pivots of a region.  A document's
home is the Voronoi region of its nearest pivot by Jaccard distance.  A partner
within the radius r = 1 - t of a document y lies at home only where
d(y, p) < d(y, nearest) + 2 r, by the triangle inequality; y is copied to these
regions, its window.  Regions of more than ``region`` documents are joined again
with pivots of their own, ``depth`` times at most; in the end the documents of a
region are compared by their exact distance.  A pair is written in the region
that is the lesser of both homes, at every level, and there alone.

The result is exact for every choice of the parameters; they decide the work.
``spread`` measures it: on short posts, whose distances are nearly all close to
1, a window holds nearly every region, so nothing is separated (README).
``metric_join`` finds the pairs of the registered queries therefore.

Defined cases: sets are expected without empty ones and without repeats (as
``metric_join.documents`` gives them); a similarity of exactly t is no pair; no
sets give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.metric_join import THRESHOLD
from corpusloom.plans.lineage import cut

#: Above the rounding error of a distance.
SLACK = 1e-9


def distance(a: Column, b: Column) -> Column:
    """Jaccard distance of two sets that aren't both empty."""
    common = F.size(F.array_intersect(a, b))
    return 1.0 - common / (F.size(a) + F.size(b) - common)


def windows(rows: DataFrame, t: tuple[int, int], pivots: int) -> DataFrame:
    """``rows`` (region, k1, k2, w, homes, path) with home and window among their region's pivots."""
    first = W.partitionBy("region").orderBy(F.xxhash64("k1", "region"), "k1", "k2")
    chosen = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= pivots)
    of = chosen.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x.w).alias("ps"))
    far = rows.join(of, "region").withColumn("d", F.transform("ps", lambda p: distance(F.col("w"), p))).drop("ps")
    near = far.withColumn("near", F.array_min("d")).withColumn("home", F.array_position("d", F.col("near")).cast("int") - 1)
    reach = F.col("near") + 2 * (1 - t[0] / t[1]) + SLACK
    return near.withColumn("window", F.filter(F.transform("d", lambda d, i: F.when(d < reach, i)), lambda i: i.isNotNull()))


def _start(sets: DataFrame) -> DataFrame:
    none = F.array().cast("array<int>")
    return sets.select(F.lit(0).cast("long").alias("region"), "k1", "k2", "w", none.alias("homes"), none.alias("path"))


def spread(sets: DataFrame, t: tuple[int, int] = THRESHOLD, pivots: int = 64) -> DataFrame:
    """One row: documents, mean distance to the nearest pivot, mean regions that hold a document."""
    found = windows(_start(sets), t, pivots)
    return found.agg(F.count(F.lit(1)).alias("n_sets"), F.avg("near").alias("mean_nearest"), F.avg(F.size("window")).alias("mean_regions"))


def _pairs(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    common = F.size(F.array_intersect("a.w", "b.w"))
    order = (F.col("a.k1") < F.col("b.k1")) | ((F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") < F.col("b.k2")))
    here = F.zip_with("a.homes", "b.homes", lambda x, y: F.least(x, y)) == F.col("a.path")
    match = (F.col("a.region") == F.col("b.region")) & order & here & (common * (t[0] + t[1]) > (F.size("a.w") + F.size("b.w")) * t[0])
    return a.join(b, match).select(*[F.col(f"{p}.k{i}").alias(f"{p}{i}") for p in "ab" for i in (1, 2)])


def set_pairs(sets: DataFrame, t: tuple[int, int] = THRESHOLD, pivots: int = 16, region: int = 256, depth: int = 2) -> DataFrame:
    """(a1, a2, b1, b2) of different sets above the threshold, each pair once."""
    rows, found = _start(sets), []
    for level in range(depth):
        placed = windows(rows, t, pivots).select("region", "k1", "k2", "w", F.concat("homes", F.array("home")).alias("homes"), "path", F.explode("window").alias("i"))
        copies = cut(placed.select(F.xxhash64("region", "i").alias("region"), "k1", "k2", "w", "homes", F.concat("path", F.array("i")).alias("path")))
        held = copies.groupBy("region").agg(F.count(F.lit(1)).alias("n_held"))
        large = held.where(F.col("n_held") > region).select("region")
        if level == depth - 1 or large.isEmpty():
            found.append(_pairs(copies, t))
            break
        found.append(_pairs(copies.join(large, "region", "left_anti"), t))
        rows = cut(copies.join(large, "region", "left_semi"))
    return reduce(DataFrame.unionByName, found)
