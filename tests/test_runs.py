"""Model runs over small files: what they write and what it says."""

import csv
import json

import pytest

from corpusloom.functions.labels import LABELS
from corpusloom.operators import inference
from corpusloom.plans import runs
from corpusloom.sources.config import BaselineConfig, HardSubsetConfig, InferenceConfig

WORDS = {"Saudi": "وش ابغى توه", "Egyptian": "ايه ده ازاي", "Levantine": "شو هاد هيك", "Maghrebi": "واخا دابا بزاف"}


def write(path, columns, rows):
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([columns, *rows])
    return str(path)


@pytest.fixture
def files(tmp_path):
    columns = ["source_id", "processed_text", "macro_label"]
    train = write(tmp_path / "train.csv", columns, [(f"t{x}{i}", f"{w} {i}", x) for x, w in WORDS.items() for i in range(2)])
    dev = write(tmp_path / "dev.csv", columns, [(f"d{i}", " ".join(w.split()[:2]), x) for i, (x, w) in enumerate(WORDS.items(), 1)])
    return {"train_path": train, "dev_path": dev, "output_dir": str(tmp_path / "out")}


class Stub:
    """Answers by the position of the item: right, but for Maghrebi in zero-shot mode."""

    def __call__(self, developer, prompt):
        items = [x.split("\t") for x in prompt.split(f"{inference.ITEMS_HEADING}\n")[1].split("\n")]
        right = {" ".join(w.split()[:2]): x for x, w in WORDS.items()}
        few = inference.SUPPORT_HEADING in prompt
        named = lambda t: right[t] if few or right[t] != "Maghrebi" else "Egyptian"
        return json.dumps({"predictions": [{"item_id": i, "label": named(t)} for i, t in items]}), 10, 5, 20.0


def test_baseline_writes_seven_files(spark, files):
    out = runs.baseline_run(spark, BaselineConfig(**files, prefix="p", word_min_df=1, char_min_df=1, max_iter=50))
    kinds = ["classification_report.json", "classification_report.txt", "confusion_matrix.csv", "dev_predictions.csv", "error_analysis.md", "metrics.json", "summary.md"]
    assert sorted(out) == [f"p_{k}" for k in kinds] and all(p.exists() for p in out.values())
    metrics = json.loads(out["p_metrics.json"].read_text(encoding="utf-8"))
    assert (metrics["train_rows"], metrics["dev_rows"], metrics["accuracy"]) == (8, 4, 1.0)
    rows = list(csv.reader(open(out["p_confusion_matrix.csv"], encoding="utf-8")))
    assert rows[0] == ["true_label", *LABELS] and [r[1:] for r in rows[1:]] == [["1" if i == j else "0" for j in range(4)] for i in range(4)]
    assert len(list(csv.DictReader(open(out["p_dev_predictions.csv"], encoding="utf-8")))) == 4


def test_robustness_writes_drops(spark, files):
    out = runs.robustness_run(spark, BaselineConfig(**files, prefix="p", word_min_df=1, char_min_df=1, max_iter=30))
    payload = json.loads(out["p_robustness_metrics.json"].read_text(encoding="utf-8"))
    assert payload["rows"] == 4 and set(payload["drops"]) == {"typo_noise", "elongation", "placeholder_noise", "punctuation_spacing"}
    for family, drop in payload["drops"].items():
        assert drop["accuracy_drop"] == pytest.approx(payload["clean"]["accuracy"] - payload["perturbed"][family]["accuracy"])
        assert payload["perturbed"][family]["rows"] == 4


def test_inference_writes_six_files(spark, files):
    out = runs.inference_run(spark, InferenceConfig(**files, prefix="m", batch_size=3, few_shot_examples_per_class=2), Stub)
    assert len(out) == 6 and all(p.exists() for p in out.values())
    metrics = json.loads(out["m_metrics.json"].read_text(encoding="utf-8"))
    assert (metrics["zero_shot"]["accuracy"], metrics["few_shot"]["accuracy"]) == (0.75, 1.0)
    rows = {r["source_id"]: r for r in csv.DictReader(open(out["m_dev_predictions.csv"], encoding="utf-8"))}
    assert rows["d4"]["zero_shot_predicted_label"] == "Egyptian" and rows["d4"]["few_shot_predicted_label"] == "Maghrebi"


def test_hard_subset_writes_seven_files(spark, files, tmp_path):
    truth = [(f"d{i}", x) for i, x in enumerate(WORDS, 1)]
    first = {"d1": "Levantine", "d2": "Maghrebi"}
    classical = write(tmp_path / "a.csv", ["source_id", "true_label", "predicted_label"], [(i, x, first.get(i, x)) for i, x in truth])
    asked = write(tmp_path / "b.csv", ["source_id", "true_label", "zero_shot_predicted_label", "few_shot_predicted_label"], [(i, x, x, "Levantine" if i == "d1" else x) for i, x in truth])
    config = HardSubsetConfig(**files, prefix="h", model="m", classical_predictions=classical, llm_predictions=asked, few_shot_examples_per_class=2)
    out = runs.hard_subset_run(spark, config, Stub)
    kinds = ["classification_report.json", "comparison.md", "definition.md", "error_analysis.md", "metrics.json", "predictions.csv", "summary.md"]
    assert sorted(out) == [f"h_{k}" for k in kinds] and all(p.exists() for p in out.values())
    metrics = json.loads(out["h_metrics.json"].read_text(encoding="utf-8"))
    rows = {r["source_id"]: r for r in csv.DictReader(open(out["h_predictions.csv"], encoding="utf-8"))}
    assert metrics["hard_subset_rows"] == len(rows) >= 1 and metrics["dev_rows"] == 4
    assert rows["d1"]["selection_reasons"] == "classical, llm few-shot" and rows["d1"]["classical_predicted_label"] == "Levantine"
    assert metrics["earlier"]["classical"]["accuracy"] == 0.0 and metrics["zero_shot"]["accuracy"] == 1.0
