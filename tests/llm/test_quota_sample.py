"""Problem 5: shares, floors, unmet targets."""

import pytest

from corpusloom.llm import quota_sample as Q

TARGETS = "target_name string, field_name string, category string, target_share double, min_rows long, sample_fraction double"


@pytest.fixture
def posts(spark):
    sizes = {"a": 700, "b": 250, "c": 45, "d": 5, None: 20, "": 10}
    data = [(v, f"{v}2") for v, n in sizes.items() for _ in range(n)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "record_id long, label string, target_name string")


def targets(spark, rows):
    return spark.createDataFrame(rows, TARGETS)


def test_shares_and_floors(spark, rows, posts, monkeypatch):
    monkeypatch.setattr(Q, "BUCKET_ROWS", 100)
    t = targets(spark, [("t", "label", "a", 0.5, 3, 0.2), ("t", "label", "b", 0.45, 3, 0.2), ("t", "label", "c", 0.04, 20, 0.2), ("t", "label", "d", 0.01, 4, 0.2), ("u", "label", "a", 1.0, 1, 0.1)])
    n = {(r.target_name, r.category): r.drawn_rows for r in Q.report(posts, t).collect()}
    # floors take 20 and 4 of 206 rows; the rest keeps the proportion of 50 to 45
    assert abs(n["t", "a"] - 182 * 50 / 95) <= 1 and abs(n["t", "b"] - 182 * 45 / 95) <= 1
    assert n["t", "c"] == 20 and n["t", "d"] == 4 and abs(n["u", "a"] - 103) <= 1
    assert abs(sum(v for k, v in n.items() if k[0] == "t") - 206) <= 1
    ids = [r[:2] for r in rows(Q.sample(posts, t))]
    assert len(ids) == len(set(ids)) == sum(n.values())
    assert rows(Q.sample(posts, t)) == rows(Q.sample(posts, t))


def test_capped_category_leaves_the_rest_in_proportion(spark, posts):
    t = targets(spark, [("t", "label", "a", 0.2, 0, 0.5), ("t", "label", "b", 0.7, 0, 0.5), ("t", "label", "c", 0.02, 0, 0.5), ("t", "label", "d", 0.08, 6, 0.5)])
    n = {r.category: r.drawn_rows for r in Q.report(posts, t).collect()}
    assert n["b"] == 250 and n["d"] == 5 and abs(n["a"] - 10 * n["c"]) <= 20 and abs(sum(n.values()) - 515) <= 1
    assert {tuple(r) for r in Q.unmet(posts, t).collect()} == {("t", "b"), ("t", "d")}


def test_repairs_keep_the_sum():
    lacking, taken = Q.repaired([100, 93, 8, 2], [3, 3, 20, 4], [103, 92.7, 8.2, 2.06], [700, 250, 45, 5])
    assert lacking == [0, 0, 12, 2] and sum(taken) == 14 and taken[2:] == [0, 0]
    assert Q.repaired([3, 0], [3, 2], [5, 0], [3, 9]) == ([0, 2], [0, 0])  # nothing can be taken back


def test_unmet(spark, rows, posts):
    t = targets(spark, [("t", "label", "a", 0.5, 3, 0.2), ("t", "label", "d", 0.5, 1, 0.2), ("t", "label", "c", 0.01, 46, 0.2), ("t", "label", "zz", 0.0, 0, 0.2), ("t", "label", "yy", 0.0, 1, 0.2), ("u", "none", "a", 0.1, 1, 0.2)])
    assert rows(Q.unmet(posts, t)) == [("t", "c"), ("t", "d"), ("t", "yy"), ("u", "a")]
    assert rows(Q.sample(posts.where("false"), t)) == []


def test_every_row_is_equally_likely(spark, rows, posts):
    t = targets(spark, [("t", "label", "b", 1.0, 0, 125 / 1030)])
    seen = {}
    for seed in range(12):
        for r in Q.sample(posts, t, seed).collect():
            seen[r.record_id] = seen.get(r.record_id, 0) + 1
    assert sum(seen.values()) == 12 * 125 and len(seen) >= 245 and max(seen.values()) <= 12
    assert abs(sum(v * v for v in seen.values()) / 250 - (36 + 3)) < 1.5  # mean square of a binomial of 12 halves
