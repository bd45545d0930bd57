"""Problem 6: the forms, and pairs of lines that look the same."""

import random
import unicodedata

from corpusloom.llm import visual_form as V


def c(*parts):
    return "".join(p if isinstance(p, str) else chr(p) for p in parts)


MAN, WOMAN, FIRE = 0x1F468, 0x1F469, 0x1F525


def test_forms():
    same = [
        (c("caf", 0xE9), c("cafe", 0x301)), (c(0xFF21, 0xFF22), "AB"), (c("a", 0x200B, "b"), "ab"), (c("a", 0xA0, "b"), "a b"), (c(0x430, "bc"), "abc"),
        (c(0xFEFB), c(0x644, 0x627)), (c(0x6A9, 0x62A, 0x628), c(0x643, 0x62A, 0x628)), (c(0x628, 0x6CC, 0x62A), c(0x628, 0x64A, 0x62A)),
        (c(0x639, 0x644, 0x6CC), c(0x639, 0x644, 0x649)), (c(0x627, 0x654), c(0x623)), (c(0x628, 0x651, 0x64E), c(0x628, 0x64E, 0x651)),
        (c("x", 0xAD, "y"), "xy"), (c("a", 0x200D, "b"), "ab"), (c(0x6F1), c(0x661)), (c(MAN, 0x200B, 0x200D, WOMAN), c(MAN, 0x200D, WOMAN)),
        (c(0xFEFF, "abc"), "abc"), (c(0x3000, 0x2009), "  "), (c(0x628, 0x6CC, 0x64E, 0x62A), c(0x628, 0x64A, 0x64E, 0x62A)),
    ]
    for a, b in same:
        assert V.visual(a) == V.visual(b), (ascii(a), ascii(b))
    differ = [
        ("a b", "a  b"), ("ab", "AB"), (c(0x627), c(0x623)), (c(0x628), c(0x628, 0x64E)), (c(0x639, 0x644, 0x64A), c(0x639, 0x644, 0x649)),
        (c(0x628, 0x640), c(0x628)), ("1", c(0x661)), (c(0x6F4), c(0x664)), ("a\tb", "a b"), ("a\n", "a"),
        (c(MAN, 0x200D, WOMAN), c(MAN, WOMAN)), (c(0xB2), "2"), (c(0x645, 0x6A9), c(0x645, 0x643)),
    ]
    for a, b in differ:
        assert V.visual(a) != V.visual(b), (ascii(a), ascii(b))


def test_segments_equal_the_whole_and_forms_are_stable():
    rng = random.Random(6)
    points = [0xE9, 0x301, 0x300, 0x327, 0x623, 0x625, 0x627, 0x653, 0x654, 0x655, 0x64B, 0x650, 0x651, 0x644, 0x6A9, 0x6CC, 0x64A, 0x200B, 0x200C, 0x200D]
    points += [0xAD, 0xFF21, 0xFE8E, 0xFEFC, 0x430, 0xA0, 0x2003, MAN, FIRE, 0x1100, 0x1161, 0x212B, 0x457]
    parts = [*"abe  \t\n", *map(chr, points)]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        form = V.visual(text)
        assert form == V._arabic(V.segment(text)), ascii(text)
        assert form == V.visual(form), ascii(text)
        if not V.segments().search(text):
            assert unicodedata.is_normalized("NFC", text)


def test_quick_check_passes_only_stable_texts(spark):
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x600, 0x700), *range(0x2000, 0x2070), 0x212A, 0x2126, 0x3000, 0xFB50, 0xFF21, 0x1F468, 0x200D]]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.where(~df.text.rlike(V.quick_check())).collect():
        assert V.visual(r.text) == r.text, ascii(r.text)
    for r in V.formed(df).collect():
        assert r.form == V.visual(r.text), ascii(r.text)


def test_pairs(spark, rows):
    long = "x" * 40000
    texts = [c("caf", 0xE9, " 1"), "cafe" + chr(0x301) + " 1", c("caf", 0xE9, " 1"), None, "", chr(0x200B), "...", "." + chr(0x200B) + "..", long, chr(0x445) + long[1:]]
    data = [(i, t, 0) for i, t in enumerate(texts, 1)]
    df = spark.createDataFrame([*data, (None, texts[0], 0), (None, texts[1], 0)], "record_id long, text string, k1 int")
    assert rows(V.alike(df)) == [(1, 2), (2, 3), (9, 10)]
    assert rows(V.alike(df.where("false"))) == []
    forms = dict(rows(V.formed(df.where("record_id > 0")).select("record_id", "form")))
    assert forms[4] is None and forms[5] == "" and forms[6] == ""


def test_hot_string_with_a_variant(spark):
    data = [(i, "hello") for i in range(3000)] + [(5000, "hel" + chr(0x200B) + "lo")]
    got = V.alike(spark.createDataFrame(data, "record_id long, text string"))
    assert got.count() == 3000 and got.where("id_b <> 5000").isEmpty()


def test_stable_characters_pass_the_quick_check():
    rng = random.Random(8)
    pool = [c for a, b in V.stable() for c in range(a, b + 1)]
    assert len(V.stable()) < 80 and {0x61, 0x627, 0x64B, 0xE9, 0x1F525} <= set(pool)
    assert not {0x301, 0x653, 0x655, 0x200B, 0xA0, 0x430, 0x6A9, 0x6CC, 0xFF21, 0x212A} & set(pool)
    for _ in range(20000):
        text = chr(rng.choice(pool)) + chr(rng.choice(pool))
        if not V.segments().search(text):
            assert unicodedata.is_normalized("NFC", text) and V.segment(text) == text, ascii(text)
