"""Metrics, subsets, few-shot, inference, features and perturbations on small inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS
from corpusloom.operators import encoder, features, inference, perturb, selection
from corpusloom.operators import metrics as M
from corpusloom.plans import pipelines, reports
from corpusloom.sources import config, providers

MATRIX = [[74, 0, 15, 11], [0, 64, 13, 22], [5, 5, 368, 21], [1, 2, 18, 379]]


def predictions(spark, matrix=MATRIX):
    rows = [(LABELS[t], LABELS[p], n) for t in range(4) for p, n in enumerate(matrix[t])]
    df = spark.createDataFrame(rows, "true_label string, predicted_label string, n int")
    return df.select("true_label", "predicted_label", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("x")).drop("x")


def test_known_matrix(spark):
    p = pipelines.measured(predictions(spark))
    assert p["confusion_matrix"] == MATRIX and p["rows"] == 998
    assert (p["accuracy"], p["macro_f1"], p["weighted_f1"]) == pytest.approx((0.8867735, 0.8476041, 0.8837268), abs=1e-6)
    assert [(c["true"], c["predicted"], c["n"]) for c in p["top_confusions"][:2]] == [("Egyptian", "Maghrebi", 22), ("Levantine", "Maghrebi", 21)]
    shares = {(r.true_label, r.predicted_label): r.share for r in M.error_shares(predictions(spark).withColumn("m", F.lit(1)), ["m"]).collect()}
    assert shares["Saudi", "Levantine"] == pytest.approx(15 / 26) and shares["Egyptian", "Maghrebi"] == pytest.approx(22 / 35)
    assert "Levantine" in reports.classification(p) and "Confusion matrix" in reports.model("x", p)


def test_absent_label_counts_zero(spark):
    p = pipelines.measured(predictions(spark, [[2, 0, 0, 0], [1, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]))
    assert p["per_class_metrics"]["Maghrebi"] == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 0}
    assert p["macro_f1"] == pytest.approx((0.8 + 2 / 3) / 4) and p["present_macro_f1"] == pytest.approx((0.8 + 2 / 3) / 2)
    assert pipelines.measured(predictions(spark).where("false"))["rows"] == 0


def test_latest_prediction_counts(spark, rows):
    df = spark.createDataFrame([(1, "m", 1, "a"), (1, "m", 3, "c"), (1, "m", 2, "b"), (2, "m", 4, None)], "record_id long, model_name string, prediction_id long, predicted_label string")
    assert rows(M.latest(df, ["record_id", "model_name"], "prediction_id").select("record_id", "predicted_label")) == [(1, "c"), (2, None)]


def test_early_stop(spark):
    def run(values, patience=2, least=0.001):
        h = F.array(*[F.struct(F.lit(i).alias("epoch"), F.lit(v).alias("value")) for i, v in enumerate(values, 1)])
        return spark.range(1).select(M.early_stop(h, patience, least).alias("x")).first()["x"]

    assert run([0.5, 0.6, 0.7, 0.8, 0.9]).best_epoch == 5
    r = run([0.9, 0.9005, 0.8, 0.99])
    assert (r.best_epoch, r.last_epoch, r.stopped) == (1, 3, True)


def test_seeds_and_weights(spark):
    one = spark.createDataFrame([(1, 0.5)], "seed int, v double").withColumn("k", F.lit("a"))
    assert M.seed_summary(one, ["k"], "v").first().deviation is None
    w = {r.y: r.weight for r in M.class_weights(spark.createDataFrame([("a",)] * 3 + [("b",)], "y string"), "y").collect()}
    assert w == {"a": pytest.approx(4 / 6), "b": 2.0}
    assert M.weighted_mean(spark.createDataFrame([("k", 1.0, 1), ("k", 4.0, 2)], "k string, v double, n int"), ["k"], "v", "n").first()["mean"] == 3.0


def test_hard_subset(spark, rows):
    data = [
        ("d1", "classical", "Saudi", "Levantine"), ("d1", "zero", "Saudi", "Saudi"), ("d1", "few", "Saudi", "Saudi"), ("d2", "classical", "Egyptian", "Maghrebi"), ("d2", "zero", "Egyptian", "Egyptian"),
        ("d2", "few", "Egyptian", "Levantine"), ("d3", "classical", "Saudi", "Saudi"), ("d3", "zero", "Saudi", "Maghrebi"), ("d3", "few", "Saudi", "Saudi"), ("d4", "classical", "Levantine", "Levantine"),
    ]
    df = spark.createDataFrame(data, "record_id string, model_name string, true_label string, predicted_label string")
    reasons = selection.hard_reasons(df, {"classical": "classical", "zero": "gemini_zero", "few": "gemini_few"})
    assert rows(reasons) == [("d1", ["classical"]), ("d2", ["classical", "gemini_few"]), ("d3", ["gemini_zero"])]
    assert dict(rows(selection.combinations(reasons)))["classical, gemini_few"] == 1 and dict(rows(selection.by_selector(reasons)))["classical"] == 2
    subset = selection.subset_predictions(reasons, df.where("model_name = 'classical'"))
    assert M.accuracy(subset, ["model_name"]).first().accuracy == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="no prediction for d1"):
        selection.subset_predictions(reasons, df.where("record_id <> 'd1' and model_name = 'classical'")).collect()


def support(spark):
    texts = {"Saudi": ["وش فيك اليوم يا رجال", "وش فيك اليوم يا رجال ", "abc", "", None], "Egyptian": ["ايه ده يا عم بس", "ازيك"], "Levantine": ["شو هاد كتير حلو هيك", "هلق"], "Maghrebi": ["واخا صافي بزاف دابا هنا", "راه"]}
    rows = [(f"s{i}", t, x) for x, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "source_id string, processed_text string, macro_label string")


def test_few_shot(spark):
    got = [(r.label, r["rank"], r.source_id) for r in selection.few_shot(support(spark), "processed_text", "macro_label", 2).orderBy("label", "rank").collect()]
    assert got[-2:] == [("Saudi", 1, "s0"), ("Saudi", 2, "s2")]
    with pytest.raises(ValueError, match="Egyptian"):
        selection.require_per_class(selection.few_shot(support(spark), "processed_text", "macro_label", 3), 3)


def test_batches_across_blocks(spark, rows):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "record_id long")
    got = rows(selection.numbered(df, ["record_id"], parts=12))
    assert sorted(got) == [(i, i) for i in range(1000)]


class Stub:
    """Answers every item with its label from a list, as the service would."""

    def __init__(self, wrong=()):
        self.wrong = wrong

    def __call__(self, developer, prompt):
        ids = [x.split("\t")[0] for x in prompt.split(f"{inference.ITEMS_HEADING}\n")[1].split("\n")]
        few = inference.SUPPORT_HEADING in prompt
        answer = [{"item_id": i, "label": "Maghrebi" if not few and i == "3" else LABELS[int(i) - 1]} for i in ids]
        return "```json\n" + json.dumps({"predictions": answer}) + "\n```", 100, 20, 250.0


def test_prompted_run(spark):
    dev = spark.createDataFrame([(f"d{i}", i + 2, "نص", x) for i, x in enumerate(LABELS)], "source_id string, source_row_number long, processed_text string, macro_label string")
    c = config.InferenceConfig(batch_size=4, few_shot_examples_per_class=2, price_in=1.0, price_out=2.0)
    zero, few = (pipelines.prompted_run(support(spark), dev, c, Stub, m)[1] for m in ("zero_shot", "few_shot"))
    assert zero["accuracy"] == 0.75 and few["accuracy"] == 1.0
    assert zero["usage"]["prompt_tokens"] == 100 and zero["usage"]["latency_per_row_ms"] == 62.5 and zero["usage"]["cost"] == pytest.approx(140 / 1e6)


def test_answers(spark, rows):
    reply = lambda s: spark.createDataFrame([(0, s)], "batch_id long, content string")
    good = '{"predictions":[{"item_id":1,"label":"SAUDI"},{"item_id":"2","label":"x"},{"item_id":"2","label":"it is Egyptian."}]}'
    assert rows(inference.answers(reply(good.replace('"x"', '"Saudi"')))) == [(0, "1", "Saudi"), (0, "2", "Egyptian")]
    for bad, match in ((good, "no such label"), ("nonsense", "no list"), ('{"predictions":[{"label":"Saudi"}]}', "no item_id")):
        with pytest.raises(Exception, match=match):
            inference.answers(reply(bad)).collect()
    items = spark.createDataFrame([(0, 1), (0, 9)], "batch_id long, item_id long")
    with pytest.raises(Exception, match="lacks item 9"):
        inference.answered(items, inference.answers(reply(good.replace('"x"', '"Saudi"')))).collect()


def test_providers(monkeypatch):
    monkeypatch.setenv("KEY", "k")
    sent = []
    replies = {
        "openai_chat_completions": {"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}]}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}},
        "gemini_generate_content": {"candidates": [{"content": {"parts": [{"text": "a"}]}}], "usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 4}},
        "anthropic_messages": {"content": [{"type": "text", "text": "a"}], "usage": {"input_tokens": 3, "output_tokens": 4}},
    }
    for name, reply in replies.items():
        c = config.InferenceConfig(provider=name, model="m", api_base="http://x", api_key_env="KEY", max_retries=1)
        tries = iter([b"not json", json.dumps(reply).encode()])
        client = providers.Client(c, lambda *a: sent.append(a) or next(tries), pause=0.0)  # noqa: B023
        assert client("d", "u")[:3] == ("a", 3, 4)
        broken = providers.Client(c, lambda *a: b"{}", pause=0.0)
        with pytest.raises(RuntimeError, match="2 times"):
            broken("d", "u")
    assert len(sent) == 6 and "key=k" in sent[2][0]
    with pytest.raises(ValueError, match="unknown provider"):
        providers.Client(config.InferenceConfig(provider="x"))
    monkeypatch.delenv("KEY")
    with pytest.raises(RuntimeError, match="KEY"):
        providers.Client(config.InferenceConfig(api_key_env="KEY"))


def test_configs(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"data": {"train_path": "t"}, "model": {"C": 2}}))
    c = config.load(tmp_path / "c.json", config.BaselineConfig)
    assert (c.train_path, c.c, c.word_min_df) == ("t", 2.0, 2) and isinstance(c.c, float)
    (tmp_path / "d.json").write_text(json.dumps({"provider": {"name": "x", "nickname": "y"}, "batch_size": 3}))
    with pytest.raises(ValueError, match="no setting batch_size, provider.nickname"):
        config.load(tmp_path / "d.json", config.InferenceConfig)
    (tmp_path / "e.json").write_text(json.dumps({"optimizer": {"type": "sgd"}}))
    with pytest.raises(ValueError, match="optimizer='sgd'"):
        config.load(tmp_path / "e.json", config.EncoderConfig)
    assert config.check(config.EncoderConfig()).seed == 42
    with pytest.raises(ValueError, match="optimizer='sgd'.*warmup_ratio=2"):
        config.check(config.EncoderConfig(optimizer="sgd", warmup_ratio=2))


@pytest.mark.parametrize(
    ("kind", "text", "values"),
    [
        (config.BaselineConfig, "features:\n  lowercase: true\n  word:\n    ngram_range: [1, 3]\n    min_df: 1\n  char:\n    min_df: 4\nmodel:\n  C: 4.0\n  random_state: 7\n"
         "labels:\n  order: [Maghrebi, Saudi, Egyptian, Levantine]\noutput:\n  report_dir: out\n  prefix: p\n",
         {"lowercase": True, "word_ngrams": [1, 3], "word_min_df": 1, "char_min_df": 4, "char_ngrams": [3, 5], "seed": 7, "output_dir": "out", "prefix": "p",
          "labels": ["Maghrebi", "Saudi", "Egyptian", "Levantine"]}),
        (config.HardSubsetConfig, "artifacts:\n  classical_predictions_path: a.csv\n  gemini_predictions_path: b.csv\nprovider:\n  name: anthropic_messages\n  model: m\n"
         "  input_price_per_1m_tokens: 3.0\n  output_price_per_1m_tokens:\ninference:\n  batch_size: 20\n  max_completion_tokens: 400\nfew_shot:\n  examples_per_class: 3\n",
         {"classical_predictions": "a.csv", "llm_predictions": "b.csv", "provider": "anthropic_messages", "model": "m", "price_in": 3.0, "price_out": None, "batch_size": 20,
          "max_completion_tokens": 400, "few_shot_examples_per_class": 3}),
        (config.EncoderConfig, "model:\n  name_or_path: n\n  max_length: 64\ntraining:\n  learning_rate: 3.0e-5\n  num_epochs: 2\n  max_grad_norm: 1\nloss:\n  class_weights: balanced\n"
         "seed: 123\nreproducibility:\n  cudnn_benchmark: true\noutput:\n  checkpoint_dir: k\n",
         {"model": "n", "max_length": 64, "learning_rate": 3e-5, "epochs": 2, "max_grad_norm": 1.0, "class_weights": "balanced", "seed": 123, "cudnn_benchmark": True, "checkpoint_dir": "k"}),
    ],
)
def test_config_places(tmp_path, kind, text, values):
    (tmp_path / "c.yaml").write_text(text)
    got = config.load(tmp_path / "c.yaml", kind)
    assert {k: getattr(got, k) for k in values} == values


def test_ngrams_and_tfidf(spark, rows):
    df = spark.createDataFrame([(1, "a bb a"), (2, "bb"), (3, None)], "k long, t string")
    grams = {r.k: r for r in df.select("k", features.word_ngrams(F.col("t")).alias("w"), features.char_ngrams(F.col("t")).alias("c")).collect()}
    assert grams[1].w == ["a", "bb", "a", "a bb", "bb a"] and grams[2].c == [" bb", "bb ", " bb "]
    counts = features.term_counts(df, "k", features.word_ngrams(F.col("t")))
    weights = {(k, t): w for k, t, w in rows(features.tfidf(counts, features.document_frequencies(counts, 1), 3, "k"))}
    idf = lambda n: math.log(4 / (1 + n)) + 1
    raw = {"a": (1 + math.log(2)) * idf(1), "bb": idf(2), "a bb": idf(1), "bb a": idf(1)}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert {t: w for (k, t), w in weights.items() if k == 1} == pytest.approx({t: v / norm for t, v in raw.items()})


def test_classifier(spark):
    words = {"Saudi": "وش ابغى توه", "Egyptian": "ايه ده ازاي", "Levantine": "شو هاد هيك", "Maghrebi": "واخا دابا بزاف"}
    train = spark.createDataFrame([(f"t{x}{i}", w, x) for x, w in words.items() for i in range(2)], "source_id string, processed_text string, macro_label string")
    dev = spark.createDataFrame([(f"d{x}", w.split()[0] + " " + w.split()[1], x) for x, w in words.items()], "source_id string, processed_text string, macro_label string")
    found, metrics = pipelines.baseline(train, dev, config.BaselineConfig(word_min_df=1, char_min_df=1, max_iter=100))
    assert found.count() == 4 and metrics["accuracy"] == 1.0 and metrics["train_rows"] == 8


def test_perturbations(spark):
    df = spark.createDataFrame([(i, "مرحبا يا صديقي العزيز") for i in range(30)] + [(99, ""), (100, "zz")], "k long, t string")
    out = df.select("k", "t", *[f(F.col("t"), F.col("k")).alias(n) for n, f in perturb.FAMILIES.items()]).collect()
    assert out == df.select("k", "t", *[f(F.col("t"), F.col("k")).alias(n) for n, f in perturb.FAMILIES.items()]).collect()
    for r in out:
        assert 0 <= len(r.t) - len(r.typo_noise) <= 3 and len(r.elongation) - len(r.t) in (0, 1, 2, 3)
        assert r.placeholder_noise.removeprefix("USER ").removesuffix(" URL") == r.t
        assert r.punctuation_spacing.rstrip("!.").split() == r.t.split()
    assert len({r.typo_noise for r in out}) > 5 and {r.t for r in out if r.t == r.elongation} == {"", "zz"}


def test_encoder_interface(spark, rows):
    df = spark.createDataFrame([("a", "x yy zzz", "Saudi"), ("b", "x", "Maghrebi"), ("c", None, "?")], "source_id string, t string, y string")
    tokenised = encoder.tokenised(df, "source_id", "t", "y", len_tokens, 2)
    assert rows(tokenised) == [("a", [1, 2], [1, 1], 0), ("b", [1], [1], 3), ("c", [], [], None)]
    padded = encoder.dynamic_padding(tokenised.withColumn("batch_id", F.lit(0)))
    assert {tuple(r.input_ids) for r in padded.collect()} == {(1, 2), (1, 0), (0, 0)}
    assert rows(encoder.predict(tokenised, "source_id", lambda ids, mask: [sum(m) for m in mask])) == [("a", "Levantine"), ("b", "Egyptian"), ("c", "Saudi")]
    rate = spark.range(1).select(*[encoder.learning_rate(F.lit(s), F.lit(10), F.lit(110), 1.0) for s in (0, 5, 10, 60, 110)]).first()[:]
    assert rate == (0.0, 0.5, 1.0, 0.5, 0.0)


def len_tokens(text):
    return [len(w) for w in text.split()]


def test_robustness():
    drops = pipelines.robustness({"accuracy": 0.8, "macro_f1": 0.5}, {"typo": {"accuracy": 0.6, "macro_f1": 0.5}})
    assert drops["typo"]["relative_accuracy_drop_pct"] == pytest.approx(25) and drops["typo"]["macro_f1_drop"] == 0
    assert pipelines.compare_robustness(drops["typo"], {**drops["typo"], "macro_f1_drop": 0.1}) == {"larger_absolute_drop": "second", "larger_relative_drop": "equal", "first_model_lead": "grows"}
