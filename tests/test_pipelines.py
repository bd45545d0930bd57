"""Runs over small raw files with known results."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.operators import curate, leakage
from corpusloom.plans import pipelines, reports
from corpusloom.sources import readers, sinks
from corpusloom.sources.registry import file_group, match

S1 = "nadi2023/NADI2023_Release_Train/Subtask1"
H23, H20, H21 = "#1_id\t#2_content\t#3_label", "#1 tweet_ID\t#2 tweet_content\t#3 country_label\t#4 province_label", "#1_tweetid\t#2_tweet\t#3_country_label\t#4_province_label"


def tree(root, files):
    for path, (head, rows) in files.items():
        p = Path(root, path)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join([head, *["\t".join(r) for r in rows]]) + "\n", encoding="utf-8")
    return root


@pytest.fixture
def raw(tmp_path):
    return tree(tmp_path / "raw", {
        f"{S1}/NADI2023_Subtask1_TRAIN.tsv": (H23, [("t1", "نص تدريب", "Saudi_Arabia"), ("t2", "نص خارج النطاق", "Iraq")]),
        f"{S1}/NADI2023_Subtask1_DEV.tsv": (H23, [("d1", "نص تدريب", "Egypt"), ("d2", "نص تطوير", "Syria")]),
        f"{S1}/NADI2020-TWT.tsv": (H20, [("a1", "نص تدريب", "Egypt", "eg_Cairo"), ("a2", "نص متعارض", "Jordan", "jo"), ("a3", "نص موحد", "UAE", "ae"), ("a4", "نص صالح", "Saudi_Arabia", "sa")]),
        f"{S1}/NADI2021-TWT.tsv": (H21, [("b1", "نص متعارض", "Lebanon", "lb"), ("b2", "نص موحد", "United_Arab_Emirates", "ae"), ("b3", "نص صالح 2", "Egypt", "eg"), ("b4", "نص تطوير", "Syria", "sy")]),
    })


def test_curation(spark, raw, tmp_path):
    out = cli.run(cli.parser().parse_args(["curate", "--data-root", str(raw), "--output-dir", str(tmp_path / "interim"), "--report-dir", str(tmp_path / "r")]), spark)
    payload = json.loads(out["interim_curation_report.json"].read_text(encoding="utf-8"))
    stats = payload["statistics"]
    assert stats["train_core"] == {"kept_by_source": {"train_core": 1}, "kept_by_label": {"Saudi": 1}, "dropped_by_reason": {"out_of_scope_country": 1}}
    assert stats["dev_core"]["kept_by_label"] == {"Levantine": 1} and stats["dev_core"]["dropped_by_reason"] == {"benchmark_exact_overlap_with_train": 1}
    assert stats["train_aug_candidates"]["dropped_by_reason"] == {"conflicting_supporting_label": 2, "out_of_scope_country": 2, "overlap_with_dev_core": 1, "overlap_with_train_core": 1}
    assert stats["(all)"]["dropped_by_reason"]["out_of_scope_country"] == 3 and payload["n_conflicts"] == 1
    aug = readers.table(spark, out["train_aug_candidates.csv"]).collect()
    assert {r.source_id for r in aug} == {"a4", "b3"} and list(aug[0].asDict()) == curate.INTERIM
    done = cli.run(cli.parser().parse_args(["clean", "--input-dir", str(tmp_path / "interim"), "--output-dir", str(tmp_path / "processed")]), spark)
    rows = readers.table(spark, done["train_core"]).collect()
    assert len(rows) == 1 and rows[0].processed_text == "نص تدريب" and "text" not in rows[0].asDict()


def test_empty_text_takes_part_in_curation(spark, rows):
    data = [("train_core", "s", "f", "1", 2, "", "Egypt"), ("dev_core", "s", "f", "2", 3, None, "Egypt"), ("dev_core", None, None, None, None, "x", None)]
    df = spark.createDataFrame(data, "split_name string, source_dataset string, source_file string, source_id string, source_row_number long, text string, raw_label string")
    got = rows(curate.curate(curate.records(df)).select("source_id", "drop_reason"))
    assert got == sorted([("", "out_of_scope_country"), ("1", None), ("2", "benchmark_exact_overlap_with_train")], key=repr)
    assert rows(curate.curate(curate.records(df.where("false")))) == []


def test_validation(spark, tmp_path):
    root = tree(tmp_path, {
        f"{S1}/NADI2023_Subtask1_TRAIN.tsv": (H23, [("1", "نص مشترك جدا", "Saudi_Arabia"), ("2", "نص فريد", "Egypt")]),
        f"{S1}/NADI2023_Subtask1_DEV.tsv": (H23, [("3", "نص مشترك جدا", "Saudi_Arabia"), ("4", "نص تطوير", "Egypt")]),
        f"{S1}/NADI2020-TWT.tsv": (H20, [("A", "نص داعم", "UAE", "ae"), ("B", "نص آخر", "Saudi_Arabia", "sa")]),
        f"{S1}/NADI2021-TWT.tsv": (H21, [("C", "نص داعم", "United_Arab_Emirates", "ae"), ("D", "نص آخر", "Egypt", "eg")]),
        "nadi2020/NADI_release/unlabeled_10M.tsv": ("#1 tweet_ID", [("X",), ("Y",)]),
        "nadi2020/NADI_release/train_labeled.tsv": (H20, [("P", "نص مرجعي", "Saudi_Arabia", "sa")]),
        "other/odd.tsv": (H23, [("1", "مرحبا يا سعودية", "Saudi_Arabia"), ("2", "", "Egypt"), ("2", "", "Egypt"), ("3", "كلمة", "Jordan")]),
    })
    p = pipelines.validation(spark, root)
    groups = {g: (v["n_files"], v["n_rows"]) for g, v in p["groups"].items()}
    assert groups == {"benchmark_anchor": (2, 4), "canonical_supporting": (2, 4), "provenance_aux_eval": (1, 1), "unlabeled_id_only": (1, 2), "out_of_scope": (1, 4)}
    s = p["safety"]
    assert (s["texts_in_several_files"], s["train_dev_overlap"], s["supporting_conflicts"]) == (3, 1, 1)
    odd = next(f for f in p["files"] if f["path"].endswith("odd.tsv"))
    assert (odd["layout"], odd["n_rows"], odd["n_duplicates"], odd["n_empty"], odd["n_short"]) == ("nadi2023_st1_labeled", 4, 1, 2, 3)
    assert odd["class_counts"]["#3_label"]["Egypt"] == 2 and odd["empty_rows"] == [3, 4]
    assert "odd.tsv" in reports.validation(p)
    assert pipelines.validation(spark, tmp_path / "none")["totals"]["n_files"] == 0


def test_registry():
    assert match(["#1_id", "#2_content"]).name == "nadi2023_st1_test_unlabeled" and match(["x"]).name == "unknown"
    assert match(["#1_id", "#2_content", "#3_label", "extra"]).name == "nadi2023_st1_labeled"
    assert file_group("x/y.tsv", "nadi2020_unlabeled_ids") == "unlabeled_id_only" and file_group("x/y.tsv", "unknown") == "out_of_scope"


def test_audit(spark):
    schema = "source_id string, original_text string, processed_text string, macro_label string"
    train = spark.createDataFrame([("train_1", "A", "<USER> a b c", "Saudi"), ("train_2", "B", "dup text", "Egyptian"), ("train_3", "C", "dup text", "Egyptian")], schema)
    dev = spark.createDataFrame([("dev_1", "Z", "<USER> a b c", "Saudi"), ("dev_2", "Y", "dup text x", "Egyptian")], schema)
    p = pipelines.audit(train, dev, 0.6)
    assert [p["overlaps"][f]["count"] for f in ("source_id", "original_text", "processed_text")] == [0, 0, 1]
    assert p["duplicates"] == {"train": {"n_groups": 1, "n_additional_rows": 1}, "dev": {"n_groups": 0, "n_additional_rows": 0}}
    assert p["near_duplicates"] == 2 and p["status"] == "block" and "block" in reports.audit(p)
    assert pipelines.audit(train, dev.where("false"))["status"] == "pass"


def test_similarity_at_the_threshold(spark, rows):
    df = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "record_id long, processed_text string")
    ten = " ".join(f"w{i}" for i in range(10))
    nine = " ".join(f"w{i}" for i in range(9))
    assert rows(leakage.similar_rows(df(ten, ten), df(nine, ten, "", None), 0.9)) == [(1, ten, 2)]
    assert rows(leakage.first_partners(df("z", ten, ten), df(ten), 0.9)) == [(0, 1, 1.0)]


def test_precheck(spark, tmp_path):
    interim = lambda data: spark.createDataFrame(data, "source_id string, text string, macro_label string")
    processed = lambda data: spark.createDataFrame([(i, t, t, m) for i, t, m in data], "source_id string, original_text string, processed_text string, macro_label string")
    train, dev = [("train_1", "نص تدريب", "Saudi"), ("train_2", "نص اخر", "Egyptian")], [("dev_1", "نص تطوير", "Levantine"), ("dev_2", "نص مغاربي", "Maghrebi")]
    raw = spark.createDataFrame([("cand_1", "نص تدريب", "Saudi_Arabia"), ("cand_2", "نص جديد", "Jordan"), ("cand_3", "خارج", "Oman")], "source_id string, text string, raw_label string")
    p = pipelines.precheck("c", raw, {"train_core": (interim(train), processed(train)), "dev_core": (interim(dev), processed(dev))})
    assert (p["rows"], p["kept_rows"], p["combined"]["count"], p["overlaps"]["train_core.original_text"]["count"], p["overlaps"]["train_core.processed_text"]["count"]) == (3, 2, 1, 1, 1)
    assert p["tier"] == "not acceptable until deduplicated" and p["levantine_confirmed"] and p["dropped"] == ["Oman"] and p["mapped"] == ["Jordan", "Saudi_Arabia"]
    assert pipelines.recommendation([p]).startswith("stop") and "1%-5% band" in reports.precheck(p)
    empty = pipelines.precheck("e", raw.where("false"), {"train_core": (interim(train), processed(train))})
    assert empty["combined"] == {"count": 0, "percent": 0.0} and pipelines.recommendation([empty]).startswith("proceed")


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('a\tb.c\n1\t"x ""y"" z"\n2\t\n3\t"two\nlines"\n', encoding="utf-8")
    got = [tuple(r) for r in readers.numbered(spark, p, "\t").collect()]
    assert got == [("1", 'x "y" z', 2), ("2", "", 3), ("3", "two\nlines", 4)]
    assert [tuple(r) for r in readers.table(spark, p, "\t", strict=True).collect()] == [r[:2] for r in got]
    p.write_text('a\tb\n1\t"abc" def\n', encoding="utf-8")
    assert readers.table(spark, p, "\t", strict=True).first().b == "abc def"
    with pytest.raises(ValueError, match="nope"):
        readers.table(spark, p, "\t", ["nope"])
    assert readers.optional_table(spark, tmp_path / "no.csv", ["x"]).collect() == [] and readers.optional_json(spark, tmp_path / "no.json") is None
    df = spark.createDataFrame([(2, "b,\"c\""), (1, None)], "n int, t string")
    sinks.csv_file(df, tmp_path / "o.csv", ["n"])
    assert [tuple(r) for r in readers.table(spark, tmp_path / "o.csv").collect()] == [("1", ""), ("2", 'b,"c"')]
    sinks.csv_file(df.where("false"), tmp_path / "e.csv")
    assert readers.header(tmp_path / "e.csv", ",") == ["n", "t"]


def test_stability_from_files(spark, tmp_path):
    for seed, acc, f1 in ((42, 0.96693, 0.95952), (123, 0.97194, 0.96827), (7, 0.96493, 0.95614)):
        per = {x: {"f1": f1} for x in ("Saudi", "Egyptian", "Levantine", "Maghrebi")}
        (tmp_path / f"seed_{seed}.json").write_text(json.dumps({"accuracy": acc, "macro_f1": f1, "per_class_metrics": per}))
    out = cli.run(cli.parser().parse_args(["stability", "--folder", str(tmp_path), "--pattern", "seed_{seed}.json", "--report-dir", str(tmp_path / "r"), "--seeds", "42", "123", "7"]), spark)
    p = json.loads(out["stability.json"].read_text())
    assert p["metrics"]["macro_f1"]["mean"] == pytest.approx(0.96131, abs=1e-5) and p["metrics"]["macro_f1"]["std"] == pytest.approx(0.00627, abs=2e-5)
    assert p["interpretation"] == "acceptable stability" and "0.9613 +/- 0.0063" in out["stability.md"].read_text()


def test_streaming(spark, tmp_path, rows):
    from corpusloom.streaming import rows as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,text\n1,#مصر aaaa\n1,#مصر aaaa\n2,\n", encoding="utf-8")
    source = readers.stream(spark, tmp_path / "in", ["id", "text"])
    stream.to_memory(stream.cleaned(source), "cleaned")
    assert rows(spark.table("cleaned").select("id", "processed_text")) == [("1", "مصر aa"), ("1", "مصر aa"), ("2", "")]
    stream.to_memory(stream.first_seen(source, ["id", "text"]), "seen")
    assert rows(spark.table("seen").select("id")) == [("1",), ("2",)]
    timed = source.withColumn("at", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    stream.to_memory(stream.windowed_profile(timed, "at", "text"), "profile", "complete")
    assert rows(spark.table("profile").select("n_rows", "n_empty", "n_short")) == [(3, 1, 3)]
