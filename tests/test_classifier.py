"""The TF-IDF classifier against the relational weights and a plain fit; it must not work text by text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS, label_index
from corpusloom.operators import features, perturb, softmax
from corpusloom.plans import lineage
from corpusloom.queries import features as queries

TEXTS = ["وش ابغى توه ابغى", "وش توه", "ايه ده ازاي", "ايه ايه ده", "شو هاد هيك", "شو هيك a", "واخا دابا بزاف", "دابا بزاف وش", "", None, "a_1 é  x", "x é"]
DATA = [(i, t, LABELS[i // 2 % 4]) for i, t in enumerate(TEXTS)] + [(20 + i, TEXTS[i % 5], LABELS[i % 5 // 2 % 4]) for i in range(15)]


@pytest.fixture
def train(spark):
    return spark.createDataFrame(DATA, "k long, t string, y string")


def grouped(rows):
    return rows.groupBy(F.col("t").alias("text"), label_index(F.col("y")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def dense(blocks, size):
    x, labels, weights = [], [], []
    for b in blocks.collect():
        sizes, at, values, label, n = (np.frombuffer(b[c], t) for c, t in softmax.BLOCK.items())
        part = np.zeros((len(sizes), size))
        part[np.repeat(np.arange(len(sizes)), sizes), at] = values
        x.append(part), labels.append(label), weights.append(n)
    return np.concatenate(x), np.concatenate(labels), np.concatenate(weights)


@pytest.mark.parametrize("at_once", [3, 4096])
def test_columns_keep_every_product_of_weights(spark, train, monkeypatch, at_once):
    monkeypatch.setattr(features, "AT_ONCE", at_once)
    rows = grouped(train).orderBy("text", "label").coalesce(1).cache()
    vectors = features.Vectorizer(word_range=(1, 3)).fit(rows, "text", "n")
    x, _, n = dense(vectors.blocks(rows, "text", F.col("label"), "n"), vectors.size)
    assert vectors.n_rows == n.sum() == len(DATA)
    ids, want = {}, {}
    for r in rows.collect():
        ids[r.text, r.label] = len(ids)
    for space, terms in (("w", lambda c: features.word_ngrams(c, 1, 3)), ("c", features.char_ngrams)):
        counts = features.term_counts(train, "k", terms(F.col("t")))
        for k, term, weight in features.tfidf(counts, features.document_frequencies(counts, 2), len(DATA), "k").collect():
            want[k, space + term] = weight
    terms = {t: i for i, t in enumerate(sorted({t for _, t in want}))}
    full = np.zeros((len(ids), len(terms)))
    for k, t, y in DATA:
        for term, i in terms.items():
            full[ids[t, LABELS.index(y)], i] = want.get((k, term), 0.0)
    assert vectors.size < len(terms) and np.allclose(x @ x.T, full @ full.T, atol=1e-12)


def test_fit_is_the_optimum(spark, train):
    rows = grouped(train).where("label <> 2").cache()
    vectors = features.Vectorizer(1, 1).fit(rows, "text", "n")
    blocks = vectors.blocks(rows, "text", F.col("label"), "n").repartition(3).cache()
    penalty = 1 / (4 * vectors.n_rows)
    w = softmax.fit(blocks, vectors.size, 4, penalty, 300, 1e-13)
    x, y, n = dense(blocks, vectors.size)
    p = np.exp(x @ w[:-1] + w[-1])
    p /= p.sum(axis=1, keepdims=True)
    assert not p[:, 2].any() and w[-1, 2] == -np.inf  # no row has that label
    off = (p - np.eye(4)[y]) * n[:, None] / n.sum()
    assert abs(x.T @ off + penalty * w[:-1]).max() < 1e-5 and abs(off.sum(axis=0)).max() < 1e-5


def test_scoring_is_one_pass_over_batches(spark, train, rows):
    out = features.fit_predict(train, train, "k", "t", "y", max_iter=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "Join" not in plan and "Generate" not in plan
    got = {r.k: r for r in out.collect()}
    assert {k: r.true_label for k, r in got.items()} == {k: y for k, _, y in DATA}
    assert all(got[k].predicted_label == y for k, t, y in DATA if t)
    one = features.fit_predict(train.where("y = 'Levantine'"), train, "k", "t", "y", max_iter=50)
    assert rows(one.select("predicted_label").distinct()) == [("Levantine",)]


def test_fit_needs_rows_and_labels(spark, train):
    with pytest.raises(Exception, match="there are no rows|division"):
        features.fit_predict(train.where("false"), train, "k", "t", "y")
    with pytest.raises(Exception, match="no target label"):
        features.fit_predict(train.withColumn("y", F.lit("?")), train, "k", "t", "y")


def test_robustness_perturbs_every_candidate_once(spark, tmp_path, monkeypatch):
    data = [(k, "train_core", t or "", y) for k, t, y in DATA] + [(100 + k, "ood_2020_dev", t or "", y) for k, t, y in DATA]
    schema = "record_id long, split_name string, processed_text string, macro_label string"
    df = spark.createDataFrame(data, schema).selectExpr("*", "'' as source_id", "processed_text as original_text")
    df.write.parquet(str(tmp_path / "ood_leakage_precheck.parquet"))
    seen = []
    monkeypatch.setattr(queries, "cut", lambda d: seen.append(d._jdf.queryExecution().executedPlan().toString()) or lineage.cut(d))
    got = {r.family: r for r in queries.robustness(spark, str(tmp_path)).collect()}
    assert len(seen) == 1 and seen[0].count("Scan parquet") == 1
    assert {f: r.n_rows for f, r in got.items()} == dict.fromkeys(perturb.FAMILIES, len(DATA))
    for family, rule in perturb.FAMILIES.items():
        much = df.where("record_id >= 100").select(perturb.too_aggressive(F.col("processed_text"), rule(F.col("processed_text"), F.col("record_id"))).cast("int").alias("m"))
        assert got[family].excluded == (much.agg(F.avg("m")).first()[0] > 0.5)
