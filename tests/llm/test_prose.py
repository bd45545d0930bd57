"""Problem 9: statistics and the separation of invented prose from lists, tables and junk."""

import random

import pytest

from corpusloom.llm import prose as P

COMMON = "the of and to in is it that".split()


def sentence(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.45 else "".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def made():
    rng = random.Random(1)
    out = {}
    for i in range(400):
        out[i] = " ".join(sentence(rng, rng.randint(5, 12)) for _ in range(rng.randint(1, 8)))
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(6))
    for i in range(1000, 1020):
        out[i] = "\n".join(f"- {word()} {word()}" for _ in range(12))
    for i in range(2000, 2020):
        out[i] = "\n".join(f"| {word()} | {rng.randint(1, 999)} | {rng.randint(1, 99)}.5 |" for _ in range(10))
    for i in range(3000, 3020):
        out[i] = "".join(rng.choice("!@#$%^&*()_+{}|<>? ") for _ in range(200))
    out[4000] = out[1] + "\n- the end of " + word() + "\n- and to " + word()
    return out


def test_separation(spark, made):
    data = [(i, t, "en" if i % 3 else None, "c") for i, t in made.items()] + [(9001, None, "en", "c"), (9002, "", "en", "c"), (9003, " \n", "en", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, cell string")
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    found = {r.doc_id for r in P.not_prose(df, words).collect()}
    assert {i for i in made if 1000 <= i < 4000} <= found and 4000 not in found
    assert len([i for i in found if i < 1000]) <= 4 and not found & {9001, 9002, 9003}
    stats = P.measured(df, words).collect()
    assert len(stats) == len(made)
    for r in stats[:50]:
        assert r.distance == pytest.approx(sum(r[f"t_{s}"] for s in P.STATISTICS))


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat, of 12!\n- zz\nend of", "xx")], "doc_id long, text string, lang string")
    words = spark.createDataFrame([("en", "the"), ("en", "Of")], "lang string, word string")
    r = P.statistics(df, words).first()
    assert (r.cell, r.n_words, r.length_class) == ("und", 7, 0)
    assert r.common_share == pytest.approx(3 / 7) and r.digit_share == pytest.approx(2 / 20) and r.punctuated_lines == pytest.approx(1 / 3)
    assert r.barren_share == pytest.approx(3 / 20) and r.listed_share == pytest.approx(3 / 20) and r.distinct_share == pytest.approx(6 / 7)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    assert P.not_prose(df, words).collect() == []
    assert P.not_prose(df, words.where("false")).collect() == []
