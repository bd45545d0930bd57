"""Problem 3: the election against a sort, and the consensus itself."""

import datetime as dt
import random

from corpusloom.llm import same_record, survivor

LABELS = ["Saudi", "Egyptian"]
TRUST = {"A": 3, "B": 2, "C": 1}
RAW = ["Saudi_Arabia", "Egypt", "Jordan"]


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1 + n)


def test_consensus():
    assert survivor.consensus(["Saudi_Arabia", "Saudi Arabia", "Saudi_Arabiaa"], [2, 1, 1]) == 0
    assert survivor.consensus(["x", "New_York", "New_York_City", "New_York"], [1, 2, 2, 2]) in (1, 3)
    assert survivor.consensus(["low", "high"], [0.5, 0.25]) == 0
    assert survivor.distance(["a", "b"], ["a", "c", "b"]) == 1


def prepared(spark, data):
    df = spark.createDataFrame(data, "record_id long, text string, source_dataset string, raw_label string, macro_label string, loaded_at timestamp_ntz")
    members = same_record.members(same_record.keyed(df, [], extra=["loaded_at", "source_dataset", "raw_label", "macro_label"]))
    registry = spark.createDataFrame(list(TRUST.items()), "source_dataset string, trust int")
    return survivor.prepared(members, registry, spark.createDataFrame([(r,) for r in RAW], "raw_label string"), LABELS)


def test_against_sort(spark, rows):
    rng = random.Random(4)
    data = []
    for i in range(200):
        data.append((
            i, rng.choice(["t1", "T1!", "t2", "t3", "t4", None, ""]), rng.choice(["A", "B", "C", "D", None, ""]),
            rng.choice([*RAW, " Egypt ", "egypt", "?", None]), rng.choice(["Saudi", "Egyptian", "saudi", "", None]), day(rng.choice([None, 1, 1, 2, 3])),
        ))
    groups = {}
    for r in data:
        if r[1]:
            groups.setdefault(r[1].lower().rstrip("!"), []).append(r)
    want = []
    for g in groups.values():
        if len(g) < 2:
            continue
        for c, name in ((2, "source_dataset"), (3, "raw_label"), (4, "macro_label")):
            fine = {2: lambda v: v in TRUST, 3: lambda v: (v or "").strip() in RAW, 4: lambda v: v in LABELS}[c]
            filled = [r for r in g if fine(r[c])]
            if filled:
                best = min(filled, key=lambda r: (-TRUST.get(r[2], -1), -(r[5] or dt.datetime(1970, 1, 1)).timestamp(), r[0]))
                want.append((min(r[0] for r in g), name, best[0]))
    got = survivor.elected(prepared(spark, data)).select("first_id", "field_name", "from_id")
    assert rows(got) == sorted(want, key=repr)


def test_no_rows_without_groups(spark, rows):
    assert rows(survivor.elected(prepared(spark, [(1, "a", "A", "Egypt", "Saudi", day(1))]))) == []
    assert rows(survivor.elected(prepared(spark, []))) == []


def test_votes_of_records(spark, rows):
    data = [(1, "a", "A", "Egypt", None, day(1)), *[(i, "a", "B", "Jordan", None, day(1)) for i in range(2, 6)]]
    chosen = {r[1]: r[2] for r in rows(survivor.elected(prepared(spark, data), weights="records").select("first_id", "field_name", "value"))}
    assert chosen["raw_label"] == "Jordan"


def test_the_vote_and_its_limit_differ(spark, rows):
    data = [(1, "a", "A", "Egypt", None, day(3)), *[(i, "a", "C", "Saudi_Arabia", None, day(1)) for i in range(2, 7)], (9, "b", "A", "Egypt", None, day(1)), (10, "b", "C", "Jordan", None, day(1))]
    frame = prepared(spark, data)
    pick = lambda w: {(r[0], r[1]): r[2] for r in rows(survivor.elected(frame, weights=w).select("first_id", "field_name", "value"))}
    ranked, voted = pick("trust"), pick("records")
    assert ranked[1, "raw_label"] == "Egypt" and voted[1, "raw_label"] == "Saudi_Arabia"
    assert ranked[9, "raw_label"] == voted[9, "raw_label"] == "Egypt"
