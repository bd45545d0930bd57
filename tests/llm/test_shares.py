"""Amounts between bounds."""

import random

import pytest

from corpusloom.llm.shares import filled
from corpusloom.llm.tables import fixed_rows


def test_filled():
    assert filled([52, 16, 16, 16], [0] * 4, [30, 100, 100, 20], 100) == pytest.approx([30, 25, 25, 20])
    assert filled([1, 1], [0, 0], [5, 5], 20) == [5, 5] and filled([], [], [], 0) == []
    assert filled([50, 50, 0], [0, 70, 3], [100, 100, 100], 100) == pytest.approx([27, 70, 3])
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(1, 6)
        wanted = [rng.choice([0, rng.random()]) for _ in range(n)]
        most = [rng.random() * 2 for _ in range(n)]
        least = [rng.choice([0, rng.random()]) for _ in range(n)]
        total = rng.random() * 3
        got = filled(wanted, least, most, total)
        low = [min(a, b) for a, b in zip(least, most)]
        assert all(a - 1e-9 <= x <= b + 1e-9 for x, a, b in zip(got, low, most))
        top = sum(b if w else a for w, a, b in zip(wanted, low, most))
        assert sum(got) == pytest.approx(min(max(total, sum(low)), top))
        free = [x / w for x, w, a, b in zip(got, wanted, low, most) if w and a + 1e-9 < x < b - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))


def test_fixed_tables_are_never_cut(spark):
    assert len(fixed_rows(spark.range(5).toDF("x"), ["x"], 5)) == 5
    with pytest.raises(ValueError, match="more than 4"):
        fixed_rows(spark.range(5).toDF("x"), ["x"], 4)
