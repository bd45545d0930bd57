"""Problem 3: the surviving record of each group of copies, field by field.

Per group and field the filled values are first reduced to their distinct
values, each with its best record (trust, then recency, then id) and its number
of records; a map-side combine makes a hot group a handful of rows.  The values
of a field come from fixed lists, so a group holds few distinct ones.  Those are
split into tokens, aligned progressively (best-ranked first, each later value
against the profile so far), the tokens of each column vote with the weight of
their value, and the existing value nearest to the consensus survives; the
best-ranked one wins a tie.

With ``weights="records"`` every record votes with the trust of its dataset, so
many records of middling trust outvote one of greater trust, and tokens that most
values share carry values that hold them.  With ``weights="trust"`` the value
ranked i weighs 2**-i, more than all later ones together: the vote is then at its
limit, the order of trust, which ``p3_found`` has to give; ``p3_survivors`` is
the vote of records.

Defined cases: null, blank and unlisted values take no part; a group with no
filled value gives no row for that field; equal trust falls to the later
loaded_at (null last), then the smaller record_id; unlisted datasets rank last;
an empty table gives no row; a dataset without trust in the registry counts as
unlisted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.tables import fixed_rows
from corpusloom.plans.shipping import ship

FIELDS = ["source_dataset", "raw_label", "macro_label"]
TOKEN = re.compile(r"[^\W_]+|[\W_]", re.UNICODE)
GAP = ""


def tokens(value: str) -> list[str]:
    """Words of a value and the signs between them."""
    return TOKEN.findall(value)


def align(profile: list[dict[str, float]], row: list[str], weight: float, total: float) -> list[dict[str, float]]:
    """``profile`` (weight of each token by column) with ``row`` aligned to it."""
    n, m = len(profile), len(row)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                cost[i][j] = float(i + j)
                continue
            miss = 1.0 - profile[i - 1].get(row[j - 1], 0.0) / total
            cost[i][j] = min(cost[i - 1][j - 1] + 2 * miss, cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out: list[dict[str, float]] = []
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + 2 * (1.0 - profile[i - 1].get(row[j - 1], 0.0) / total):
            i, j = i - 1, j - 1
            column = dict(profile[i])
            column[row[j]] = column.get(row[j], 0.0) + weight
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            column = dict(profile[i])
            column[GAP] = column.get(GAP, 0.0) + weight
        else:
            j -= 1
            column = {GAP: total, row[j]: weight}
        out.append(column)
    return out[::-1]


def distance(a: list[str], b: list[str]) -> int:
    """Token edit distance."""
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
    return line[-1]


def consensus(values: list[str], weights: list[float]) -> int:
    """Position of the value nearest to the weighted vote; the first on a tie."""
    split = [tokens(v) for v in values]
    profile, total = [{t: weights[0]} for t in split[0]], weights[0]
    for row, weight in zip(split[1:], weights[1:], strict=True):
        profile = align(profile, row, weight, total)
        total += weight
    order = {t: i for i, t in reversed(list(enumerate([t for row in split for t in row])))}
    voted = [max(c, key=lambda t: (c[t], -order.get(t, len(order)))) for c in profile]
    target = [t for t in voted if t != GAP]
    return min(range(len(values)), key=lambda i: (distance(split[i], target), i))


@F.pandas_udf(T.IntegerType())
def _elect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple, int] = {}
    for values, weights in batches:
        out = []
        for v, w in zip(values, weights, strict=True):
            case = (tuple(v), tuple(w))
            if case not in known:
                if len(known) >= 1 << 16:
                    known.clear()
                known[case] = consensus(list(v), list(w))
            out.append(known[case])
        yield pd.Series(out, dtype="int32")


def prepared(df: DataFrame, registry: DataFrame, label_map: DataFrame, targets: list[str]) -> DataFrame:
    """Members with trust and the filled values of the three fields (null: unfilled).

    ``registry`` and ``label_map`` are fixed tables of 7 and 20 rows.
    """
    trust = {r.source_dataset: int(r.trust) for r in fixed_rows(registry, ["source_dataset", "trust"]) if r.source_dataset is not None and r.trust is not None}
    labels = sorted({r.raw_label for r in fixed_rows(label_map, ["raw_label"]) if r.raw_label is not None})
    of = F.lit(None).cast("long")
    for name, value in sorted(trust.items()):
        of = F.when(F.col("source_dataset") == name, F.lit(value).cast("long")).otherwise(of)
    label = F.regexp_replace("raw_label", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return df.select(
        "record_id", "first_id", "loaded_at", of.alias("trust"),
        F.when(F.col("source_dataset").isin(sorted(trust)), F.col("source_dataset")).alias("source_dataset"),
        F.when(label.isin(labels), label).alias("raw_label"),
        F.when(F.col("macro_label").isin(targets), F.col("macro_label")).alias("macro_label"),
    )


def elected(rows: DataFrame, weights: str = "trust") -> DataFrame:
    """first_id, field_name, value and from_id for every group and filled field."""
    ship(rows.sparkSession)
    rank = F.struct(F.col("trust").alias("t"), F.col("loaded_at").alias("l"), (-F.col("record_id")).alias("id"))
    long = rows.select(
        "first_id", "trust", rank.alias("rank"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("x"),
    ).select("first_id", "trust", "rank", "x.field_name", "x.value").where("value is not null")
    distinct = long.groupBy("first_id", "field_name", "value").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("trust", F.lit(0))).alias("trusted")
    )
    per_field = distinct.groupBy("first_id", "field_name").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n", "trusted")), asc=False).alias("v"))
    weight: Column
    if weights == "trust":
        weight = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.pow(F.lit(2.0), -i.cast("double")))
    else:
        weight = F.transform("v", lambda x: (x.trusted + x.n).cast("double"))
    chosen = F.when(F.size("v") == 1, F.lit(0)).otherwise(_elect(F.col("v.value"), weight))
    single = per_field.where(F.size("v") == 1).select("first_id", "field_name", F.col("v")[0].alias("x"))
    several = per_field.where(F.size("v") > 1).select("first_id", "field_name", F.element_at("v", chosen + 1).alias("x"))
    return single.unionByName(several).select("first_id", "field_name", F.col("x.value").alias("value"), (-F.col("x.rank.id")).alias("from_id"))
