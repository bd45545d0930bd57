"""Cleaning against fixed strings and against SQL; other text functions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import text as X
from corpusloom.functions import tiers
from corpusloom.queries.text import STEPS, chained

# Inputs and their cleaned form.
CLEANED = [
    ("USER آلسَّلَام @user ســــلام مرحببببااا URL https://x.com #السعودية coolلل ى NUM 😀", "<USER> السلام <USER> سلام مرحبباا السعودية coolلل ي NUM 😀"),
    ("مرحببببا @user #الرياض https://t.co/x", "مرحببا <USER> الرياض"),
    ("اهلااا #مصر", "اهلاا مصر"),
    ("USER اهلين URL", "<USER> اهلين"),
    ("النصhttps://example.com/path", "النص"),
    ("صورةpic.twitter.com/abc123", "صورة"),
    ("كلمه@handle", "كلمه <USER>"),
    ("راسلني على adminjob@alkhaleej.ae", "راسلني علي adminjob@alkhaleej.ae"),
]


def apply(spark, values, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = df.select("i", *[e(F.col("t")).alias(f"c{k}") for k, e in enumerate(expressions)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(expressions) > 1 else r[1] for r in out]


def test_fixed_strings(spark):
    assert apply(spark, [a for a, _ in CLEANED], X.clean) == [b for _, b in CLEANED]


def test_random_texts(spark):
    rng = random.Random(1)
    parts = ["USER", "<USER>", "URL", "@", "#", "a@b.co", "x.y@mail.org", "http://q", "www.z", " ", "  ", "\t", "ى", "ىِ", "ــ", "ااا", "آ", "aaa", "b_", "7", " ", "pic.twitter.com/k", "م"]
    drawn = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    texts = [t for t in drawn if not ("@" in t and "." in t)]  # SQL has no look-behind for what may be an address
    assert len(texts) > 700
    mails = ["x.y@mail.org", "a@b.co"]
    spaced = [f"{rng.choice(parts[-6:])} {m} {rng.choice(parts[-6:])}" for m in mails for _ in range(20)]
    assert all(m in got.split() for got, m in zip(apply(spark, spaced, X.clean), [m for m in mails for _ in range(20)], strict=True))
    db = duckdb.connect()
    db.execute("create table interim_dataset (record_id int, text varchar)")
    db.executemany("insert into interim_dataset values (?, ?)", list(enumerate(texts)))
    want = [v for _, v in sorted(db.execute(chained(STEPS)).fetchall())]
    for t, got, sql in zip(texts, apply(spark, texts, X.clean), want, strict=True):
        assert got == sql, ascii(t)


def test_nulls_and_white_space(spark):
    assert apply(spark, [None, "", "  a b "], X.clean) == ["", "", "a b"]
    assert apply(spark, ["  a\x1f"], X.strip_ws) == ["a"]
    assert apply(spark, ["a  b c", ""], lambda c: X.token_count(c)) == [3, 0]


def test_fingerprints(spark):
    import hashlib

    assert apply(spark, ["نص"], X.fingerprint) == [hashlib.sha1("نص".encode()).hexdigest()]
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(X.row_fingerprint(F.col("x"), F.col("y"), F.col("z"))).first()[0] == hashlib.sha1(b"a\t\tc").hexdigest()


def test_fences_truncation_ratios(spark):
    assert apply(spark, ["```json\n{}\n```", "```{}```", " {} ", "`x`"], X.without_fences) == ["{}", "{}", "{}", "`x`"]
    assert apply(spark, ["x" * 160, "x" * 161, "a \n b"], X.truncated) == ["x" * 160, "x" * 159 + "…", "a b"]
    one = spark.range(1)
    assert one.select(X.percentage(F.lit(1), F.lit(0)), X.percentage(F.lit(1), F.lit(3))).first()[:] == (0.0, 33.33)
    assert one.select(X.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))).first()[0] == 0.5
    assert one.select(X.cost(F.lit(1e6), F.lit(2e6), F.lit(3.0), F.lit(15.0)), X.cost(F.lit(1), F.lit(2), F.lit(None).cast("double"), F.lit(1.0))).first()[:] == (33.0, None)
    assert one.select(X.warmup_steps(F.lit(105), F.lit(0.1)), X.steps_per_epoch(F.lit(7), F.lit(2)), X.basename(F.lit("a/b.tsv"))).first()[:] == (10, 4, "b.tsv")


def test_labels(spark):
    assert apply(spark, [" UAE ", "United_Arab_Emirates", "egypt", None], L.normalized) == ["UAE", "UAE", "egypt", ""]
    assert apply(spark, ["Egypt", "egypt", "Oman", "Syria"], L.macro) == ["Egyptian", None, None, "Levantine"]
    assert apply(spark, ["Saudi", "SAUDI", " it is Saudi. ", "nothing", None, "egyptian or saudi"], L.coerced) == ["Saudi", "Saudi", "Saudi", None, None, "Saudi"]
    assert apply(spark, ["Saudi", "Maghrebi", "x", None], lambda c: L.index_label(L.label_index(c))) == ["Saudi", "Maghrebi", None, None]


@pytest.mark.parametrize(("count", "percent", "tier", "caveat"), [
    (0, 0.0, tiers.OOD_OK, False), (1, 0.0, tiers.HISTORICAL, False), (1, 0.99, tiers.HISTORICAL, False), (1, 1.0, tiers.HISTORICAL, True),
    (4, 4.0, tiers.HISTORICAL, True), (5, 5.0, tiers.HISTORICAL, True), (6, 5.01, tiers.NOT_YET, True),
])
def test_tiers(spark, count, percent, tier, caveat):
    c, p = F.lit(count), F.lit(percent)
    assert spark.range(1).select(tiers.overlap_tier(c, p), tiers.overlap_caveat(c, p)).first()[:] == (tier, caveat)


def test_display(spark):
    row = spark.range(1).select(
        tiers.stability_tier(F.lit(0.004)), tiers.stability_tier(F.lit(0.015)), tiers.stability_tier(F.lit(0.02)),
        tiers.view_label(F.lit(998), F.lit(998)), tiers.view_label(F.lit(999), F.lit(998)), tiers.mean_and_deviation(F.lit(0.5), F.lit(0.01)),
        tiers.improved(F.lit(None).cast("double"), F.lit(0.1), 0.001), tiers.improved(F.lit(0.1), F.lit(0.1005), 0.001), tiers.improved(F.lit(0.2), F.lit(0.1), 0.001, False),
    ).first()[:]
    assert row == (*tiers.STABILITY, "cleaned benchmark-safe dev (998 rows)", "original full-dev (999 rows)", "0.5000 +/- 0.0100", True, False, True)
