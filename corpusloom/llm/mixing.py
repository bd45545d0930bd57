"""Problem 8: mixing sources to target shares of the tokens.

Each listed source gets a rate of copies per document: its share of all tokens over
its own tokens, at most max_repeats.  The shares are the weights where they can be
met; sources at max_repeats are fixed there, and the others take what is left in
proportion to their weights, so the mix has the tokens of all listed sources if
the repeats allow.  A document is repeated the whole part
of its rate; the fractional parts are rounded by pivotal sampling: two documents
exchange token mass, in a random direction of expectation zero, until the copy
probability of one is 0 or 1.  The exchange keeps the tokens of the source as
they are, so the actual share is the wanted one up to a part of one document.

Every partition pairs its own documents and keeps at most one open document per
source; open ones are paired again in groups of 32 partitions, these in groups
of 32, and so on, so no step sees more than 32 rows of a source.

Defined cases: a null weight or max_repeats is 0; documents without an id count
as tokens but can't be copied; null and empty texts count 0 tokens, their fraction is drawn by
itself; a source without documents has 0 tokens and can't be met; documents with
a null or unlisted source take no part; an empty table gives the targets alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.hashing import unit
from corpusloom.llm.shares import filled
from corpusloom.llm.tables import fixed_rows
from corpusloom.plans.lineage import cut
from corpusloom.plans.shipping import ship

FAN_IN = 32
STATE = "doc_id long, source string, n_tokens long, copies long, p double, part long"


RATES = "source string, weight double, max_repeats int, own_tokens long, wanted_tokens double, solved_tokens double, rate double, unmet boolean"


def rates(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets`` (a fixed list) with its tokens, wanted and solved, and its rate."""
    rows = sorted(fixed_rows(targets, ["source", "weight", "max_repeats"]), key=lambda r: str(r.source))
    listed = F.broadcast(targets.select("source").distinct())
    counts = tokens.join(listed, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    own = {r.source: r.n or 0 for r in counts}
    total = sum(own.values())
    wanted = [(r.weight or 0.0) * total for r in rows]
    most = [(r.max_repeats or 0) * own.get(r.source, 0) for r in rows]
    solved = filled(wanted, [0.0] * len(rows), [float(m) for m in most], sum(wanted))
    out = []
    for r, w, m, x in zip(rows, wanted, most, solved, strict=True):
        n = own.get(r.source, 0)
        rate = float(r.max_repeats or 0) if n and x >= m else x / n if n else 0.0
        out.append((r.source, r.weight, r.max_repeats, n, w, x, rate, m < w))
    return tokens.sparkSession.createDataFrame(out, RATES)


def exchange(t: float, p: float, u: float, q: float, draw: float) -> tuple[float, float]:
    """New probabilities of two documents of ``t`` and ``u`` tokens."""
    up, down = min(t * (1 - p), u * q), min(t * p, u * (1 - q))
    if draw * (up + down) < down:
        return (1.0, q - up / u) if up == t * (1 - p) else (p + up / t, 0.0)
    return (0.0, q + down / u) if down == t * p else (p - down / t, 1.0)


def paired(rows: Iterator[tuple], seed: str) -> list[tuple]:
    """Rows (doc_id, source, n_tokens, copies, p, part) with at most one open per source."""
    rng = random.Random(seed)
    open_: dict[str, list] = {}
    out = []
    for row in rows:
        now = list(row)
        while 0.0 < now[4] < 1.0:
            other = open_.pop(now[1], None)
            if other is None:
                open_[now[1]] = now
                now = None
                break
            other[4], now[4] = exchange(other[2], other[4], now[2], now[4], rng.random())
            if 0.0 < other[4] < 1.0:
                other, now = now, other
            out.append(closed(other))
        if now is not None:
            out.append(closed(now))
    return out + [tuple(x) for x in open_.values()]


def closed(row: list) -> tuple:
    """The row with its decided fraction moved into the copies."""
    return (row[0], row[1], row[2], row[3] + int(row[4] >= 1.0), 0.0, row[5])


def copies(tokens: DataFrame, rate: DataFrame, seed: int = 8) -> DataFrame:
    """doc_id, source, n_tokens and copies (perhaps 0) of each listed document."""
    ship(tokens.sparkSession)
    names = STATE.replace(",", "").split()[::2]
    whole = F.floor("rate")
    start = tokens.where("doc_id is not null").join(F.broadcast(rate.select("source", "rate")), "source").select(
        "doc_id", "source", "n_tokens", whole.alias("copies"), (F.col("rate") - whole).alias("p"), F.spark_partition_id().cast("long").alias("part")
    )
    lone = F.col("n_tokens") == 0
    start = start.select(
        "doc_id", "source", "n_tokens",
        (F.col("copies") + F.when(lone & (unit(F.lit(seed), F.col("doc_id")) < F.col("p")), 1).otherwise(0)).alias("copies"),
        F.when(lone, 0.0).otherwise(F.col("p")).alias("p"), "part",
    )

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for n, batch in enumerate(batches):
            if len(batch):
                rows = paired(iter([*held, *batch.itertuples(index=False, name=None)]), f"{seed}/{batch.part.iloc[0]}/{n}")
                held = [r for r in rows if 0.0 < r[4] < 1.0]
                yield pd.DataFrame([r for r in rows if not 0.0 < r[4] < 1.0], columns=names)
        yield pd.DataFrame(held, columns=names).astype({"doc_id": "int64", "n_tokens": "int64", "copies": "int64", "p": "float64", "part": "int64"})

    def again(batch: pd.DataFrame) -> pd.DataFrame:
        ordered = batch.sort_values(["part", "doc_id"])
        rows = paired(ordered.itertuples(index=False, name=None), f"{seed}/{ordered.source.iloc[0]}/{ordered.part.iloc[0]}")
        return pd.DataFrame(rows, columns=names)

    state = cut(start.mapInPandas(first, STATE))
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    done, left = [state.where(~is_open)], state.where(is_open)
    parts = tokens.rdd.getNumPartitions()
    while parts > 1:
        left = left.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("source", "part").applyInPandas(again, STATE)
        parts = -(-parts // FAN_IN)
        if parts > 1:
            left = cut(left)
            done.append(left.where(~is_open))
            left = left.where(is_open)
    last = F.when(unit(F.lit(seed), F.col("source")) < F.col("p"), 1).otherwise(0)
    out = left.withColumn("copies", F.col("copies") + F.when(is_open, last).otherwise(0))
    for d in done:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "n_tokens", "copies")


def shares(mixed: DataFrame, rate: DataFrame) -> DataFrame:
    """Wanted, solved and actual tokens and share of each source in the mix."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    rows = rate.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    all_sources = W.partitionBy(F.lit(1))  # one row for each listed source
    share = lambda c: F.when(F.sum(c).over(all_sources) > 0, F.col(c) / F.sum(c).over(all_sources)).otherwise(0.0)
    return rows.select(
        "source", "weight", "max_repeats", "own_tokens", "wanted_tokens", "solved_tokens", "mixed_tokens",
        share("solved_tokens").alias("solved_share"), share("mixed_tokens").alias("actual_share"), "unmet",
    )


def unmet(mixed: DataFrame, rate: DataFrame) -> DataFrame:
    """Sources whose tokens in the mix fall short of their weight and would with every repeat."""
    return shares(mixed, rate).where((F.col("mixed_tokens") < F.col("wanted_tokens")) & F.col("unmet")).select("source")
