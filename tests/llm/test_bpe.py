"""Problem 7: the encoder against two public libraries."""

import base64
import random

import pytest

from corpusloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load())


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.load().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(own, public):
    rng = random.Random(1)
    pool = [*map(chr, range(0x250)), *map(chr, range(0x600, 0x700)), "the ", "ing", "<|endoftext|>", "    ", "\n", *map(chr, (0xA0, 0x3000, 0x1F600, 0x200D, 0x85, 0x2028))]
    for i in range(3000):
        text = "".join(rng.choice(pool if i % 3 else "abcdeinrst") for _ in range(rng.randint(0, 60)))
        assert own.encode(text) == public.encode_ordinary(text), ascii(text)


def test_long_pieces(own, public):
    rng = random.Random(2)
    for text in ("a" * 5000, "".join(rng.choice("abcde") for _ in range(4000)), "\u0627\u0644" * 1500, "=" * 3000, chr(0x1F600) * 800):
        assert own.encode(text) == public.encode_ordinary(text)


def test_backtracking_equals_merges(own):
    rng = random.Random(3)
    for _ in range(2000):
        data = bytes(rng.choice(b"abeinst \xd8\xa7\xd9\x84") for _ in range(rng.randint(1, 14)))
        assert list(own.piece(data)) == own.merged(data)


def test_table(spark, own):
    data = [(1, "hello world", "c"), (2, "", "c"), (3, None, "c"), (4, "hello world", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string").withColumn("source", df_source())
    got = {r.doc_id: r.ids for r in bpe.encoded(df).collect()}
    assert got == {1: own.encode("hello world"), 2: [], 3: [], 4: own.encode("hello world")}
    assert {r.doc_id: r.n_tokens for r in bpe.counted(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encoded(df.where("false")).collect() == []


def df_source():
    from pyspark.sql import functions as F

    return F.lit("s")
