"""Problem 4: pairs against all pairs, groups against a plain traversal."""

import random

import pytest

from corpusloom.llm import metric_join as J


def make(seed, n=260, vocabulary=40):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, vocabulary)}" for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14, 30]))] for _ in range(n // 5)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(words) // 5)):
            if rng.random() < 0.5:
                words.insert(rng.randrange(len(words) + 1), f"w{rng.randint(0, vocabulary)}")
            elif len(words) > 1:
                words.pop(rng.randrange(len(words)))
        rng.shuffle(words)
        out.append((i, rng.choice([" ", ", "]).join(words)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "!")]


def brute(data):
    sets = [(i, set((t or "").replace(",", "").replace("!", "").split())) for i, t in data]
    return sorted((i, j) for i, a in sets for j, b in sets if i < j and a and 10 * len(a & b) > 7 * len(a | b))


@pytest.mark.parametrize(("seed", "region", "depth"), [(1, 4096, 3), (2, 3, 3), (3, 2, 2), (4, 1, 1)])
def test_equals_all_pairs(spark, rows, monkeypatch, seed, region, depth):
    monkeypatch.setattr(J, "REGION", region)  # small regions force the recursion and the rings
    monkeypatch.setattr(J, "DEPTH", depth)
    data = make(seed)
    df = spark.createDataFrame(data, "record_id long, text string")
    assert rows(J.similar(df)) == sorted(brute(data), key=repr)


def test_groups(spark, rows):
    data = make(5, 120)
    pairs = brute(data)
    label = {i: i for i, t in data if t and t != "!"}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    links = {i: sum(i in p for p in pairs) for i in label}
    got = rows(J.groups(spark.createDataFrame(data, "record_id long, text string")))
    assert got == sorted(((i, label[i], links[i]) for i in label), key=repr)


def test_empty_and_bounds(spark, rows):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h i"), (4, "a"), (5, "A.")], "record_id long, text string")
    assert rows(J.similar(df)) == [(1, 3), (2, 3), (4, 5)]
    assert rows(J.similar(df.where("false"))) == []
    assert rows(J.groups(df.where("false"))) == []


def test_long_texts_and_rows_without_id(spark, rows, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(700)]
    data = [(i, " ".join(rng.sample(base, 700 - 12 * i))) for i in range(30)] + [(None, " ".join(base)), (None, "a b c")]
    want = brute([d for d in data if d[0] is not None])
    df = spark.createDataFrame(data, "record_id long, text string")
    assert len(want) > 50 and rows(J.similar(df)) == sorted(want, key=repr)
    monkeypatch.setattr(J, "LONG", 8)
    monkeypatch.setattr(J, "REGION", 3)
    small = make(6)
    assert rows(J.similar(spark.createDataFrame(small, "record_id long, text string"))) == sorted(brute(small), key=repr)
