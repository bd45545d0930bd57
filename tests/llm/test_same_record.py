"""Problem 1 on small tables against a plain restatement, with its odd cases."""

import random

import regex

from corpusloom.llm import same_record as S

FIELDS = ["place", "mood"]
SCHEMA = "record_id long, text string, first_id string, k1 string"


def plain(text):
    squeeze = lambda x: regex.sub(r"[\p{P}\p{White_Space}]+", "", x).lower()
    if text is None or not regex.search(r"[\p{L}\p{N}]", text):
        return None
    pieces = [p for p in regex.split(r"[|;\n]", text) if regex.search(r"\P{White_Space}", p)]
    if len(pieces) >= 2 and all(":" in p and squeeze(p.split(":", 1)[0]) in FIELDS for p in pieces):
        return ("F", *sorted(tuple(squeeze(x) for x in p.split(":", 1)) for p in pieces))
    return ("T", squeeze(text))


def expected(rows):
    groups = {}
    for i, text, *_ in rows:
        if (k := plain(text)) is not None:
            groups.setdefault(k, []).append(i)
    return sorted(((min(g), i) for g in groups.values() for i in g if i != min(g)), key=repr)


def found(spark, data, rows):
    return rows(S.copies(S.keyed(spark.createDataFrame(data, SCHEMA), FIELDS)))


def test_cases(spark, rows):
    texts = [
        "Hello, World", "hello world!", "HELLO　WORLD", "hello​world", None, "", "  ", "?!", "place: x | mood: y", "MOOD : Y; Place: x",
        "mood: y\nplace: x", "place: x mood: y", "place: x | mood: y | other: z", "place: x", "placex", "place: x | mood:", "mood:;place: X.", "x" * 50_000, "X" * 50_000,
    ]
    data = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    assert found(spark, [*data, (None, "Hello, World", "", "")], rows) == expected(data)


def test_random_variants_and_repeated_rows(spark, rows):
    rng = random.Random(1)
    data = []
    for i in range(400):
        words = [rng.choice(["aa", "Bb", "éÉ", "سلام", "7"]) for _ in range(rng.randint(1, 3))]
        text = "".join(w.upper() if rng.random() < 0.3 else w + rng.choice(["", " ", ", ", "\n", "|", ";", ":"]) for w in words)
        data.append((i, text, "", ""))
    data += data[:20]
    assert sorted(set(found(spark, data, rows))) == sorted(set(expected(data)))


def test_empty_table_and_counts(spark, rows):
    assert found(spark, [], rows) == []
    data = [(3, "a b", "", ""), (1, "A-B", "", ""), (2, "c", "", "")]
    groups = S.groups(S.keyed(spark.createDataFrame(data, SCHEMA), FIELDS))
    assert rows(groups.select("first_id", "n_copies")) == [(1, 2), (2, 1)]
    assert S.collisions(S.keyed(spark.createDataFrame(data, SCHEMA), FIELDS)).isEmpty()
