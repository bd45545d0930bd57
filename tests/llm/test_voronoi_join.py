"""The pivot join against all pairs, and what its windows hold."""

import pytest

from corpusloom.llm import metric_join, voronoi_join
from tests.llm.test_metric_join import brute, make


@pytest.mark.parametrize(("pivots", "region", "depth"), [(1, 8, 1), (6, 40, 3), (25, 1000, 2)])
def test_equals_all_pairs(spark, pivots, region, depth):
    data = make(7, 160)
    df = spark.createDataFrame(data, "record_id long, text string")
    ids, sets = metric_join.documents(df)
    key = {r.record_id: (r.k1, r.k2) for r in ids.collect()}
    want = {tuple(sorted((key[a], key[b]))) for a, b in brute(data) if key[a] != key[b]}
    got = [((r.a1, r.a2), (r.b1, r.b2)) for r in voronoi_join.set_pairs(sets, pivots=pivots, region=region, depth=depth).collect()]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


def test_windows_separate_close_sets_only(spark):
    words = lambda c: [f"{c}{i}" for i in range(10)]
    near = [(i, " ".join(words("abcd"[i % 4])[: 10 - i % 2])) for i in range(8)]
    _, sets = metric_join.documents(spark.createDataFrame(near, "record_id long, text string"))
    assert voronoi_join.spread(sets, pivots=100).first().mean_regions < 3
    apart = [(i, " ".join(f"{i}x{j}" for j in range(10))) for i in range(40)]
    _, sets = metric_join.documents(spark.createDataFrame(apart, "record_id long, text string"))
    # only the pivots themselves (distance 0) have a window of one region
    assert voronoi_join.spread(sets, pivots=8).first().mean_regions == (8 * 1 + 32 * 8) / 40
    assert voronoi_join.set_pairs(sets.where("false")).collect() == []
