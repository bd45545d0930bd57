"""Queries that must not cut their work short, over small tables and against whole SQL."""

import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS
from corpusloom.operators import metrics
from corpusloom.operators.perturb import FAMILIES
from corpusloom.operators.selection import numbered
from corpusloom.queries import QUERIES
from corpusloom.queries.common import sql_tokens
from corpusloom.queries.text import STEPS, chained

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture
def write(spark, tmp_path):
    """Writes one table of a data folder and returns the folder."""
    def to(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return to


def test_audit_blocks_texts_equal_only_after_cleaning(spark, rows, write):
    data = [("train_core", "a", "@user  #x"), ("dev_core", "b", "USER x"), ("train_core", "c", None), ("dev_core", "d", "y")]
    folder = write("interim_dataset", data, "split_name string, source_id string, text string")
    got = rows(QUERIES["E33_audit_status"](spark, folder))
    assert got == [("processed_text", 1, "block"), ("source_id", 0, "block"), ("text", 0, "block")]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_audit_equals_sql_of_three_checks(spark, rows):
    con = duckdb.connect()
    con.execute(f"create view interim_dataset as select * from '{DATA}/interim_dataset.parquet'")
    count = "select count(distinct {0}) from r where split_name = 'dev_core' and {0} in (select {0} from r where split_name = 'train_core')"
    sql = f"""with r as (select split_name, coalesce(source_id, '') as source_id, coalesce(text, '') as text, value as processed_text
      from interim_dataset join ({chained(STEPS)}) using (record_id)) """
    want = {f: con.execute(sql + count.format(f)).fetchone()[0] for f in ("source_id", "text", "processed_text")}
    status = "block" if any(want.values()) else "pass"
    assert rows(QUERIES["E33_audit_status"](spark, str(DATA))) == sorted((f, n, status) for f, n in want.items())


def test_all_file_pairs(spark, write):
    data = [(f"f{i:02}", "x", "same text") for i in range(20)] + [("f03", "x", "two"), ("f07", "x", "two")]
    folder = write("interim_dataset", data, "source_file string, raw_label string, text string")
    got = [tuple(r) for r in QUERIES["D11_G3_H6_file_pairs"](spark, folder).collect()]
    assert got[0] == ("f03", "f07", 2) and len(got) == 190
    assert got[1:] == [(f"f{i:02}", f"f{j:02}", 1) for i in range(20) for j in range(i + 1, 20) if (i, j) != (3, 7)]


def test_model_inputs_keep_max_length_tokens(spark, rows, write):
    data = [(n, " ".join(["ab"] * n), "Saudi", "i", "t") for n in (0, 8, 9, 128, 129)]
    folder = write("ood_leakage_precheck", data, "record_id long, processed_text string, macro_label string, source_id string, original_text string")
    got = rows(QUERIES["L6_tokenised"](spark, folder))
    assert got == sorted([(n, ",".join(["2"] * k), ",".join(["1"] * k), 0) for n, k in ((0, 0), (8, 8), (9, 9), (128, 128), (129, 128))], key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_model_inputs_equal_whole_sql(spark, rows):
    tokens = sql_tokens("coalesce(processed_text, '')")
    sql = f"select record_id, array_to_string([length(x) for x in ({tokens})[1:128]], ',') from '{DATA}/ood_leakage_precheck.parquet'"
    got = [r[:2] for r in rows(QUERIES["L6_tokenised"](spark, str(DATA)))]
    assert sorted(got, key=repr) == sorted(duckdb.connect().execute(sql).fetchall(), key=repr)


def test_robustness_over_the_same_records(spark):
    labels = ["Saudi", "Egyptian", "Levantine", "Maghrebi"]
    wrong = {("clean", "a"): 0, ("clean", "b"): 2, ("x", "a"): 4, ("x", "b"): 3, ("y", "a"): 0, ("y", "b"): 3, ("z", "a"): 4, ("z", "b"): 2}
    data = [(f, m, labels[i], labels[(i + (i < n)) % 4]) for (f, m), n in wrong.items() for i in range(4)]
    scored = spark.createDataFrame(data, "family string, model_name string, true_label string, predicted_label string")
    excluded = spark.createDataFrame([("x", False), ("y", False), ("z", True)], "family string, excluded boolean")
    got = {(r.family, r.model_name): r for r in metrics.robustness(scored, excluded).collect()}
    assert len(got) == 6 and {k: r.n_rows for k, r in got.items()} == dict.fromkeys(got, 4)
    assert {k: r.accuracy_drop for k, r in got.items()} == {(f, m): (n - wrong["clean", m]) / 4 for (f, m), n in wrong.items() if f != "clean"}
    assert got["x", "a"].macro_f1_drop == got["x", "a"].macro_f1_drop_percent / 100 == 1.0
    assert {r.larger_drop for (f, _), r in got.items() if f == "x"} == {"a"}
    assert (got["x", "a"].trend, got["x", "b"].trend) == ("shrinks", "grows")
    assert {m: r.n_wins for (_, m), r in got.items()} == {"a": 1, "b": 1}  # b loses less on x, a on y; z is excluded


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_robustness_scores_every_family_on_all_candidates(spark):
    got = QUERIES["N6_robustness"](spark, str(DATA)).collect()
    n = spark.read.parquet(f"{DATA}/ood_leakage_precheck.parquet").where(F.col("macro_label").isin(*LABELS) & (F.col("split_name") != "train_core")).count()
    assert {(r.family, r.n_rows) for r in got} == {(f, n) for f in FAMILIES} and len({r.clean_accuracy for r in got}) == 1


def test_numbered_keeps_rows_without_order_key(spark, rows):
    df = spark.createDataFrame([(None if i % 4 == 0 else i, i) for i in range(40)], "k long, i long")
    want = [(None, i) for i in range(0, 40, 4)] + [(i, i) for i in range(40) if i % 4]
    for parts in (None, 1, 6):
        assert rows(numbered(df, ["k", "i"], parts=parts)) == sorted(((k, i, at) for at, (k, i) in enumerate(want)), key=repr)


def test_numbered_cuts_a_hot_first_value(spark):
    df = spark.range(20000).selectExpr("if(id % 3 = 0, id, 7) as k", "id")
    out = numbered(df, ["k", "id"], parts=2000)
    got = out.orderBy("position").collect()
    assert [r.position for r in got] == list(range(20000)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert numbered(df.where("false"), ["k", "id"]).count() == 0
