"""Model runs from a configuration to their files: baseline, text model, hard subset, robustness.

Every run computes its predictions once, keeps them in the shared folder and
writes all its files from there.  Lists of examples are the first few by id.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS, is_tracked
from corpusloom.operators import features, inference, perturb, selection
from corpusloom.plans import pipelines, reports
from corpusloom.plans.lineage import cut
from corpusloom.sources import readers, sinks
from corpusloom.sources.config import BaselineConfig, HardSubsetConfig, InferenceConfig

MODES = ["zero_shot", "few_shot"]
#: Selectors of the hard subset: the column of the predictions file that each reads.
SELECTORS = {"classical": "predicted_label", "llm zero-shot": "zero_shot_predicted_label", "llm few-shot": "few_shot_predicted_label"}
SHOWN = 5


def _splits(spark: SparkSession, config: Any) -> tuple[DataFrame, DataFrame]:
    columns = ["source_id", config.text_column, config.target_column]
    return readers.table(spark, config.train_path, columns=columns), readers.numbered(spark, config.dev_path, columns=columns)


def confusion_rows(spark: SparkSession, metrics: dict[str, Any]) -> DataFrame:
    """The confusion matrix as a table: a row for each true label."""
    rows = [(t, *m) for t, m in zip(LABELS, metrics["confusion_matrix"], strict=True)]
    return spark.createDataFrame(rows, ", ".join(["true_label string", *[f"{x} long" for x in LABELS]]))


def classification(metrics: dict[str, Any]) -> dict[str, Any]:
    """What a classification report holds."""
    return {"labels": metrics["per_class_metrics"], **{k: metrics[k] for k in ("accuracy", "macro_f1", "weighted_f1", "rows")}}


def examples(found: DataFrame, rows: DataFrame, text: str) -> list[dict[str, Any]]:
    """The first rows of every tracked confusion, with their text."""
    wrong = found.where(is_tracked(F.col("true_label"), F.col("predicted_label")))
    few = selection.examples(wrong, ["true_label", "predicted_label"], [F.col("source_id")], SHOWN).drop("rank")
    shown = few.join(rows.select("source_id", F.col(text).alias("text")).groupBy("source_id").agg(F.min("text").alias("text")), "source_id", "left")
    return [r.asDict() for r in shown.orderBy("true_label", "predicted_label", "source_id").collect()]


def merged(found: dict[str, DataFrame]) -> DataFrame:
    """source_id, true_label and the prediction of every mode."""
    out = None
    for mode, rows in found.items():
        part = rows.withColumnRenamed("predicted_label", f"{mode}_predicted_label")
        out = part if out is None else out.join(part.drop("true_label"), "source_id")
    return out


def baseline_run(spark: SparkSession, config: BaselineConfig) -> dict[str, Path]:
    """Fit, predict and write the seven files of the linear baseline."""
    train, dev = _splits(spark, config)
    found, metrics = pipelines.baseline(train, dev, config)
    found = cut(found.select("source_id", "true_label", "predicted_label"))
    name = lambda x: f"{config.prefix}_{x}"
    return sinks.fan_out(
        config.output_dir,
        {name("dev_predictions.csv"): found, name("confusion_matrix.csv"): confusion_rows(spark, metrics)},
        {name("metrics.json"): metrics, name("classification_report.json"): classification(metrics)},
        {
            name("classification_report.txt"): reports.classification(metrics), name("summary.md"): reports.model("Linear baseline", metrics),
            name("error_analysis.md"): reports.errors("Errors of the linear baseline", {"baseline": metrics}, {"baseline": examples(found, dev, config.text_column)}),
        },
    )


def _asked(train: DataFrame, dev: DataFrame, config: InferenceConfig, make_provider: Callable[[], inference.Provider]) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    done = {m: pipelines.prompted_run(train, dev, config, make_provider, m) for m in MODES}
    return {m: x[0] for m, x in done.items()}, {m: x[1] for m, x in done.items()}


def inference_run(spark: SparkSession, config: InferenceConfig, make_provider: Callable[[], inference.Provider], beside: dict[str, dict[str, Any]] | None = None) -> dict[str, Path]:
    """Ask in both modes and write the six files; ``beside`` are metrics of other runs to compare with."""
    train, dev = _splits(spark, config)
    found, runs = _asked(train, dev, config, make_provider)
    name = lambda x: f"{config.prefix}_{x}"
    shown = {m: examples(f, dev, config.text_column) for m, f in found.items()}
    return sinks.fan_out(
        config.output_dir,
        {name("dev_predictions.csv"): merged(found)},
        {name("metrics.json"): runs, name("classification_report.json"): {m: classification(r) for m, r in runs.items()}},
        {
            name("summary.md"): reports.asked(f"Text model {config.model}", runs), name("error_analysis.md"): reports.errors(f"Errors of {config.model}", runs, shown),
            name("full_dev_comparison.md"): reports.comparison("Comparison on all rows", {**(beside or {}), **runs}),
        },
    )


def hard_rows(spark: SparkSession, config: HardSubsetConfig, dev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that a selector confused in a tracked way (with reasons), and the earlier predictions by model."""
    classical = readers.table(spark, config.classical_predictions, columns=["source_id", "true_label", "predicted_label"])
    asked = readers.table(spark, config.llm_predictions, columns=["source_id", "true_label", *[f"{m}_predicted_label" for m in MODES]])
    out = None
    for selector, column in SELECTORS.items():
        source = classical if column == "predicted_label" else asked
        part = source.select("source_id", "true_label", F.col(column).alias("predicted_label"), F.lit(selector).alias("model_name"))
        out = part if out is None else out.unionByName(part)
    reasons = selection.hard_reasons(out, {s: s for s in SELECTORS}, "source_id")
    return selection.hard_subset(dev, reasons, "source_id"), out


def hard_subset_run(spark: SparkSession, config: HardSubsetConfig, make_provider: Callable[[], inference.Provider]) -> dict[str, Path]:
    """Pick the hard rows, ask in both modes, compare with the earlier models; seven files."""
    train, dev = _splits(spark, config)
    chosen, earlier = hard_rows(spark, config, dev)
    chosen = cut(chosen)
    found, runs = _asked(train, chosen.drop("reasons"), config, make_provider)
    before = {}
    table = chosen.select("source_id", F.array_join("reasons", ", ").alias("selection_reasons")).join(merged(found), "source_id")
    for selector in SELECTORS:
        own = selection.subset_predictions(chosen.select("source_id"), earlier.where(F.col("model_name") == selector).drop("model_name"), "source_id")
        own = cut(own.select("source_id", "true_label", "predicted_label"))
        before[selector] = pipelines.measured(own)
        table = table.join(own.select("source_id", F.col("predicted_label").alias(f"{selector.replace(' ', '_').replace('-', '_')}_predicted_label")), "source_id")
    counts = lambda df, key: {r[key]: r.n for r in df.orderBy(key).collect()}
    reasons = chosen.select("reasons", F.col(config.target_column).alias("label"))
    payload = {"hard_subset_rows": chosen.count(), "dev_rows": dev.count(), "earlier": before, **runs}
    definition = reports.hard_subset(
        payload["dev_rows"], payload["hard_subset_rows"], counts(selection.by_selector(reasons), "selector"), counts(selection.combinations(reasons), "selectors"),
        counts(reasons.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label"),
    )
    name = lambda x: f"{config.prefix}_{x}"
    shown = {m: examples(f, chosen, config.text_column) for m, f in found.items()}
    return sinks.fan_out(
        config.output_dir,
        {name("predictions.csv"): table},
        {name("metrics.json"): payload, name("classification_report.json"): {m: classification(r) for m, r in {**before, **runs}.items()}},
        {
            name("definition.md"): definition, name("summary.md"): reports.asked(f"Hard subset, {config.model}", runs),
            name("error_analysis.md"): reports.errors("Errors on the hard subset", runs, shown),
            name("comparison.md"): reports.comparison("Comparison on the hard subset", {**before, **runs}),
        },
    )


def robustness_run(spark: SparkSession, config: BaselineConfig) -> dict[str, Path]:
    """Fit the baseline once, predict the dev rows clean and under every perturbation family, compare; two files."""
    train, dev = _splits(spark, config)
    text, key = F.col(config.text_column), F.col("source_id")
    versions = {"clean": text} | {name: rule(text, key) for name, rule in perturb.FAMILIES.items()}
    version = F.explode(F.array(*[F.struct(F.lit(n).alias("family"), t.alias("t")) for n, t in versions.items()]))
    every = dev.select("source_id", config.target_column, text.alias("clean"), version.alias("v"))
    every = every.select(F.concat_ws(":", "v.family", "source_id").alias("source_id"), config.target_column, "clean", F.col("v.t").alias(config.text_column), "v.family")
    vectorizer = features.Vectorizer(config.word_min_df, config.char_min_df, tuple(config.word_ngrams), tuple(config.char_ngrams), config.lowercase)
    scored = features.fit_predict(train, every, "source_id", config.text_column, config.target_column, config.c, config.max_iter, vectorizer)
    scored = cut(scored.withColumn("family", F.substring_index("source_id", ":", 1)))
    runs = {n: pipelines.measured(scored.where(F.col("family") == n)) for n in versions}
    much = every.groupBy("family").agg(F.avg(perturb.too_aggressive(F.col("clean"), F.col(config.text_column)).cast("int")).alias("m"))
    excluded = {r.family: r.m > 0.5 for r in much.collect()}
    clean = runs.pop("clean")
    drops = {n: {**d, "excluded": bool(excluded.get(n))} for n, d in pipelines.robustness(clean, runs).items()}
    name = lambda x: f"{config.prefix}_robustness_{x}"
    payload = {"rows": clean["rows"], "clean": clean, "perturbed": runs, "drops": drops}
    return sinks.fan_out(config.output_dir, None, {name("metrics.json"): payload}, {name("summary.md"): reports.robustness(drops)})
