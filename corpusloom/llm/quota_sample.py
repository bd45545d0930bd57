"""Problem 5: samples with given shares of each category, by systematic sampling.

Within a field the rows of a category are put in random order (a hash of the id),
the categories in sorted order.  Every row of category c has the inclusion
probability a(c) / rows of c; a row is drawn where the running sum of
probabilities, from one random start, crosses an integer.  The amounts a(c) are in
proportion to the target shares, but no more than the rows of c; what a category
can't give, the others of the target give in proportion, so the sample keeps its
size.  A row's running sum follows from its category's start and its rank in the
category; the rank is the number of rows in the hash buckets before its own
(prefix sums over a small table of counts) and its place in its bucket, so a
category of any size is ordered bucket by bucket on all executors.

Floors are repaired after that: where fewer rows than min_rows (or all rows, if
there are fewer) were drawn, the first undrawn ranks are added, and as many rows
are taken back, last ranks first, where more were drawn than the shares within
the floors ask for.

Defined cases: rows whose value is null or no category of a target aren't drawn;
a category without rows counts 0 and can't be met (unless it asks for none); a
null share, fraction or min_rows is 0; ids that repeat are separate rows; an
empty table gives no sample.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.hashing import unit
from corpusloom.llm.shares import filled
from corpusloom.llm.tables import fixed_rows

#: Rows of a category that one hash bucket holds on average, at most.
BUCKET_ROWS = 100_000


def _fields(targets: DataFrame, df: DataFrame) -> list[str]:
    """The fields named by ``targets`` (a fixed list) that ``df`` has."""
    return sorted(r.field_name for r in fixed_rows(targets, ["field_name"]) if r.field_name in df.columns)


def stacked(df: DataFrame, targets: DataFrame) -> DataFrame:
    """record_id, field_name and category: a row for each field a target names."""
    pairs = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("category")) for f in _fields(targets, df)]
    if not pairs:
        return df.select("record_id", F.lit("").alias("field_name"), F.lit("").alias("category")).where("false")
    long = df.select("record_id", F.explode(F.array(*pairs)).alias("x")).select("record_id", "x.*")
    wanted = F.broadcast(targets.select("field_name", "category").distinct())
    return long.join(wanted, ["field_name", "category"])


PLAN = (
    "target_name string, field_name string, category string, target_share double, min_rows long, n_rows long, wanted_rows double, "
    "pi double, base double, drawn long, lacking long, taken long, unmet boolean"
)


def _crossings(base: float, amount: float) -> int:
    return math.floor(base + amount) - math.floor(base)


def repaired(drawn: list[int], floors: list[int], wanted: list[float], most: list[int]) -> tuple[list[int], list[int]]:
    """Rows to add to and to take from each category, so that floors hold and the sum stays.

    Taken are first the whole rows above the shares within the floors, then single
    ones where the excess is greatest.
    """
    lacking = [max(0, f - d) for f, d in zip(floors, drawn, strict=True)]
    ideal = filled(wanted, [float(f) for f in floors], [float(m) for m in most], float(sum(drawn)))
    excess = [d - i for d, i in zip(drawn, ideal, strict=True)]
    left, taken = sum(lacking), [0] * len(drawn)
    for i in sorted(range(len(drawn)), key=lambda i: -excess[i]):
        taken[i] = max(0, min(left, math.floor(excess[i]), drawn[i] - floors[i]))
        left -= taken[i]
    for i in sorted(range(len(drawn)), key=lambda i: taken[i] - excess[i]):
        if left and drawn[i] - taken[i] > floors[i]:
            taken[i], left = taken[i] + 1, left - 1
    return lacking, taken


def plan(df: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """Each row of ``targets`` (a fixed list) with its rows, probability, start, repairs and flags.

    The numbers of rows are counted on the executors; what comes to the driver is
    one number for each row of ``targets``.
    """
    n_all = df.count()
    key = ["field_name", "category"]
    counts = {(r.field_name, r.category): r.n for r in stacked(df, targets).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).collect()}
    asked: dict[str, list] = {}
    for r in fixed_rows(targets, ["target_name", *key, "target_share", "min_rows", "sample_fraction"]):
        asked.setdefault(r.target_name, []).append(r)
    out = []
    for name, rows in sorted(asked.items(), key=lambda x: str(x[0])):
        rows.sort(key=lambda r: (str(r.field_name), str(r.category)))
        n = [counts.get((r.field_name, r.category), 0) for r in rows]
        wanted = [(r.target_share or 0.0) * (r.sample_fraction or 0.0) * n_all for r in rows]
        amount = filled(wanted, [0.0] * len(rows), [float(x) for x in n], sum(wanted))
        at = random.Random(f"{seed}/{name}").random()
        bases, drawn = [], []
        for a in amount:
            bases.append(at)
            drawn.append(_crossings(at, a))
            at += a
        floors = [min(r.min_rows or 0, k) for r, k in zip(rows, n, strict=True)]
        lacking, taken = repaired(drawn, floors, wanted, n)
        for i, r in enumerate(rows):
            short = n[i] < (r.min_rows or 0) or n[i] < wanted[i]
            pi = amount[i] / n[i] if n[i] else 0.0
            out.append((name, r.field_name, r.category, r.target_share, r.min_rows, n[i], wanted[i], pi, bases[i], drawn[i], lacking[i], taken[i], short))
    return df.sparkSession.createDataFrame(out, PLAN)


def _crossed(rank: Column) -> Column:
    """Integers that the running sum has crossed after ``rank`` rows of the category.

    After its last row that is the planned number, whatever the rounding of the sums.
    """
    so_far = F.floor(F.col("base") + rank * F.col("pi")) - F.floor("base")
    return F.when(rank >= F.col("n_rows"), F.col("drawn")).otherwise(F.least(so_far, F.col("drawn")))


def unmet(df: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """(target_name, category) that can't be met: the sample falls short of them, and all their rows would."""
    rows = report(df, targets, seed)
    short = (F.col("drawn_rows") < F.coalesce("min_rows", F.lit(0))) | (F.col("drawn_rows") < F.col("wanted_rows"))
    return rows.where(short & F.col("unmet")).select("target_name", "category")


def ranked(df: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """record_id, field_name, category and the random rank in the category from 1."""
    n_buckets = max(1, -(-df.count() // BUCKET_ROWS))
    draw = unit(F.lit(seed), F.col("record_id"))
    rows = stacked(df, targets).withColumn("draw", draw).withColumn("bucket", F.floor(F.col("draw") * n_buckets))
    key = ["field_name", "category"]
    before = W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n")).select(*key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy(*key, "bucket").orderBy("draw", "record_id"))
    return rows.withColumn("place", place).join(starts, [*key, "bucket"]).select("record_id", *key, (F.col("start") + F.col("place")).alias("rank"))


def _drawn(df: DataFrame, steps: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """target_name, field_name, category and record_id of the drawn rows."""
    few = steps.where("n_rows > 0").select("target_name", "field_name", "category", "n_rows", "pi", "base", "drawn", "lacking", "taken")
    rows = ranked(df, targets, seed).join(F.broadcast(few), ["field_name", "category"])
    so_far, earlier = _crossed(F.col("rank")), _crossed(F.col("rank") - 1)
    kept = (so_far > earlier) & (so_far <= F.col("drawn") - F.col("taken"))
    added = (so_far == earlier) & (F.col("rank") - so_far <= F.col("lacking"))
    return rows.where(kept | added).select("target_name", "field_name", "category", "record_id")


def sample(df: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """(target_name, record_id, category) of the drawn rows of every target."""
    return _drawn(df, plan(df, targets, seed), targets, seed).select("target_name", "record_id", "category")


def report(df: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """Wanted and drawn rows and shares of every target and category."""
    steps = plan(df, targets, seed)
    key = ["target_name", "field_name", "category"]
    drawn = _drawn(df, steps, targets, seed).groupBy(*key).agg(F.count(F.lit(1)).alias("drawn_rows"))
    rows = steps.join(drawn, key, "left").withColumn("drawn_rows", F.coalesce("drawn_rows", F.lit(0)))
    whole = F.sum("drawn_rows").over(W.partitionBy("target_name"))
    share = F.when(whole > 0, F.col("drawn_rows") / whole).otherwise(0.0)
    return rows.select("target_name", "category", "target_share", "min_rows", "n_rows", "wanted_rows", "drawn_rows", share.alias("drawn_share"), "unmet")
