"""Problem 2: the segment join against all pairs, and the banded distance."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import segment_join as J


def side():
    return F.when(F.col("split_name") == "train", True).when(F.col("split_name") == "dev", False)



def make(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 45]))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2 + len(words) // 8)):
            kind = rng.random()
            at = rng.randrange(len(words) + 1)
            if kind < 0.4:
                words.insert(at, f"x{rng.randint(0, 9)}")
            elif words and kind < 0.8:
                words.pop(at - 1)
        out.append((i, rng.choice(["train", "dev", "other", None]), " ".join(words)))
    return [*out, (n, "train", None), (n + 1, "dev", ""), (n + 2, "dev", "?!")]


def brute(data):
    sets = {i: set((t or "").lower().split()) - {"?!"} for i, _, t in data}
    return sorted(
        (e, t) for e, s, _ in data if s == "dev" for t, z, _ in data
        if z == "train" and sets[e] and 5 * len(sets[e] & sets[t]) > 4 * len(sets[e] | sets[t])
    )


@pytest.mark.parametrize(("seed", "hot"), [(1, 1024), (2, 1024), (2, 2), (3, 1)])
def test_equals_all_pairs(spark, rows, monkeypatch, seed, hot):
    monkeypatch.setattr(J, "SALT_ROWS", hot)  # small values salt the segments
    data = make(300, seed)
    df = spark.createDataFrame(data, "record_id long, split_name string, text string").withColumn("e1", F.lit("clash"))
    assert rows(J.similar(df, side())) == sorted(brute(data), key=repr)


def test_threshold_is_exclusive_and_empty_sides(spark, rows):
    data = [(1, "train", "a b c d e"), (2, "dev", "a b c d"), (3, "dev", "a b c d e f"), (4, "dev", "E D c b A")]
    df = spark.createDataFrame(data, "record_id long, split_name string, text string")
    assert rows(J.similar(df, side())) == [(3, 1), (4, 1)]
    assert rows(J.similar(df.where("split_name = 'dev'"), side())) == []
    assert rows(J.similar(df.where("false"), side())) == []


def test_same_source(spark, rows):
    data = [(1, "train", " A1 "), (2, "dev", "a1"), (3, "dev", None), (4, "train", ""), (5, "dev", "  "), (6, "dev", "a2")]
    df = spark.createDataFrame(data, "record_id long, split_name string, source_id string")
    assert rows(J.same_source(df, side())) == [(2, 1)]


def test_banded_distance():
    rng = random.Random(3)
    pairs = [(sorted({rng.randint(0, 30) for _ in range(rng.randint(1, 12))}), sorted({rng.randint(0, 30) for _ in range(rng.randint(1, 12))})) for _ in range(300)]
    pad = lambda xs, fill: np.array([[*x, *[fill] * (12 - len(x))] for x in xs])
    a, b = zip(*pairs, strict=True)
    la, lb = np.array(list(map(len, a))), np.array(list(map(len, b)))
    for k in (0, 1, 3, 6):
        got = J.banded(pad(a, -1), la, pad(b, -2), lb, np.full(len(pairs), k))
        assert list(got) == [len(set(x) ^ set(y)) <= k for x, y in pairs]
    each = np.array([rng.randint(0, 9) for _ in pairs])
    assert list(J.banded(pad(a, -1), la, pad(b, -2), lb, each)) == [len(set(x) ^ set(y)) <= k for (x, y), k in zip(pairs, each, strict=True)]


def test_template_with_many_fillings(spark, rows, monkeypatch):
    monkeypatch.setattr(J, "SALT_ROWS", 32)
    template = " ".join(f"t{i}" for i in range(12))
    data = [(i, "train" if i % 2 else "dev", f"{template} a{i} b{i} c{i} d{i} e{i}") for i in range(400)]
    data += [(900, "dev", f"{template} a1 b1 c1 d1 zz")]
    df = spark.createDataFrame(data, "record_id long, split_name string, text string")
    assert rows(J.similar(df, side())) == [(900, 1)]


def test_long_texts_and_rows_without_id(spark, rows):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(1500)]
    data = [(i, "train" if i % 2 else "dev", " ".join(rng.sample(base, 1500 - 40 * (i % 12)))) for i in range(24)]
    data += [(50, "train", "a b"), (51, "dev", "b a"), (None, "train", "a b"), (None, "dev", " ".join(base))]
    want = brute([d for d in data if d[0] is not None])
    got = rows(J.similar(spark.createDataFrame(data, "record_id long, split_name string, text string"), side()))
    assert len(want) > 20 and got == sorted(want, key=repr)


def test_forty_thousand_words(spark, rows):
    words = [f"w{i}" for i in range(40000)]
    data = [(1, "train", " ".join(words)), (2, "dev", " ".join(words[300:])), (3, "dev", " ".join(words[:33000]))]
    data += [(4, "dev", " ".join(words[:32000])), (5, "dev", " ".join(words[:20000] + [f"x{i}" for i in range(20000)]))]
    df = spark.createDataFrame(data, "record_id long, split_name string, text string")
    assert rows(J.similar(df, side())) == [(2, 1), (3, 1)]


def test_counts_equal_the_pairs(spark, rows):
    rng = random.Random(11)
    ids = ["a", "A ", "b", "", None, "c", "d"]
    data = [(i, s, t, rng.choice(ids)) for i, s, t in make(200, 4)] + [(None, "train", "a b", "a"), (777, None, "a b", "a")]
    df = spark.createDataFrame(data, "record_id long, split_name string, text string, source_id string").withColumn("s", F.lit("clash"))
    pairs = set(rows(J.similar(df, side()))) | set(rows(J.same_source(df, side())))
    want = {}
    for e, _ in pairs:
        want[e] = want.get(e, 0) + 1
    assert dict(rows(J.link_counts(df, side(), True))) == want
    text = {}
    for e, _ in rows(J.similar(df, side())):
        text[e] = text.get(e, 0) + 1
    assert dict(rows(J.link_counts(df, side(), False))) == text
    assert rows(J.link_counts(df.where("false"), side(), True)) == []
