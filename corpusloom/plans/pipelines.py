"""Whole runs over files: validation, curation, cleaning, audits, baselines.

Each run builds its DataFrames from files, computes one small payload on the
driver and returns it with the tables; writing is left to ``write_*`` calls.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tiers
from corpusloom.functions.labels import ALIASES, LABELS, LEVANTINE, MACRO, TRACKED, macro, normalized
from corpusloom.functions.text import clean, fingerprint, row_fingerprint, strip_ws, token_count
from corpusloom.operators import curate, features, inference, leakage, selection, validate
from corpusloom.operators import metrics as M
from corpusloom.plans.lineage import cut
from corpusloom.sources import readers
from corpusloom.sources.config import BaselineConfig, InferenceConfig
from corpusloom.sources.registry import LARGE_FILE_BYTES, file_group, match

# The raw files of the three outputs and their columns.
SUBTASK = "nadi2023/NADI2023_Release_Train/Subtask1"
SOURCES = [
    (curate.TRAIN, "train_core", f"{SUBTASK}/NADI2023_Subtask1_TRAIN.tsv", ("#1_id", "#2_content", "#3_label")),
    (curate.DEV, "dev_core", f"{SUBTASK}/NADI2023_Subtask1_DEV.tsv", ("#1_id", "#2_content", "#3_label")),
    (curate.AUG, "train_aug_2020", f"{SUBTASK}/NADI2020-TWT.tsv", ("#1 tweet_ID", "#2 tweet_content", "#3 country_label")),
    (curate.AUG, "train_aug_2021", f"{SUBTASK}/NADI2021-TWT.tsv", ("#1_tweetid", "#2_tweet", "#3_country_label")),
]
CANDIDATES = {
    "nadi2020": ("NADI 2020 dev", "nadi2020/NADI_release/dev_labeled.tsv", ("#1 tweet_ID", "#2 tweet_content", "#3 country_label")),
    "nadi2021": ("NADI 2021 DA dev", "nadi2021/NADI2021_DEV.1.0/Subtask_1.2+2.2_DA/DA_dev_labeled.tsv", ("#1_tweetid", "#2_tweet", "#3_country_label")),
}
SPLITS = [curate.TRAIN, curate.DEV, curate.AUG]


def _cell(column: str) -> Any:
    return F.col("`" + column.replace("`", "``") + "`")


def _dicts(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a small report table."""
    return [r.asDict(recursive=True) for r in df.collect()]


# --- validation ---------------------------------------------------------------------------------


def scanned(spark: SparkSession, root: str | Path, check_large: bool = False) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Rows of all raw files in one shape, and what is known of each file.

    Headers differ, so the files are bound one by one; the rows are one plan.
    A large file of ids alone isn't searched for repeats unless asked.
    """
    files, parts = [], []
    for path in readers.tree(root):
        names = readers.header(path, "\t")
        layout = match(names)
        texts, classes = layout.columns(names)
        size = Path(path).stat().st_size
        skipped = size >= LARGE_FILE_BYTES and not texts and not classes and not check_large
        rows = readers.numbered(spark, path, "\t")
        bare = [strip_ws(_cell(t)) for t in texts]
        value = lambda c: F.when(strip_ws(_cell(c)) == "", "<EMPTY>").otherwise(strip_ws(_cell(c)))
        count = lambda tests: sum((t.cast("long") for t in tests), F.lit(0).cast("long"))
        pairs = [F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in classes]
        parts.append(rows.select(
            F.lit(path).alias("path"), "source_row_number",
            (F.lit(None).cast("string") if skipped else row_fingerprint(*[_cell(n) for n in names])).alias("fp"),
            count(b == "" for b in bare).alias("n_empty"), count(token_count(b) < validate.SHORT for b in bare).alias("n_short"),
            (F.array(*pairs) if pairs else F.array().cast("array<struct<column: string, value: string>>")).alias("classes"),
            (bare[0] if bare else F.lit("")).alias("text"), (value(classes[0]) if classes else F.lit("")).alias("label"),
        ))
        files.append({
            "path": path, "layout": layout.name, "file_group": file_group(path, layout.name), "size": size, "columns": names, "missing_columns": [],
            "text_columns": texts, "class_columns": classes, "duplicate_check": "skipped_large_id_only" if skipped else "full",
        })
    out = parts[0] if parts else spark.createDataFrame([], "path string, source_row_number long, fp string, n_empty long, n_short long, classes array<struct<column: string, value: string>>, text string, label string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, files


def file_profiles(rows: DataFrame) -> DataFrame:
    """Rows, repeats, empty and short texts of every file."""
    by_row = rows.groupBy("path", "fp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_empty").alias("e"), F.sum("n_short").alias("s"))
    repeats = F.when(F.col("fp").isNotNull(), F.col("n") - 1).otherwise(0)
    return by_row.groupBy("path").agg(F.sum("n").alias("n_rows"), F.sum(repeats).alias("n_duplicates"), F.sum("e").alias("n_empty"), F.sum("s").alias("n_short"))


def validation(spark: SparkSession, root: str | Path, check_large: bool = False) -> dict[str, Any]:
    """The validation payload of a tree of raw files."""
    rows, files = scanned(spark, root, check_large)
    rows = rows.cache()
    profiles = {r["path"]: r for r in _dicts(file_profiles(rows))}
    counts = rows.select("path", F.explode("classes").alias("x")).groupBy("path", "x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    by_file: dict[str, dict[str, dict[str, int]]] = {}
    for r in counts.orderBy("path", "column", F.desc("n"), "value").collect():
        by_file.setdefault(r.path, {}).setdefault(r.column, {})[r.value] = r.n
    samples: dict[tuple[str, str], list[int]] = {}
    for kind, test in (("empty", F.col("n_empty") > 0), ("short", F.col("n_short") > 0)):
        for r in validate.first_rows(rows.where(test), ["path"], ["source_row_number"], 5).collect():
            samples.setdefault((r.path, kind), []).append(r.source_row_number)
    for f in files:
        f |= {k: v for k, v in profiles.get(f["path"], {"n_rows": 0, "n_duplicates": 0, "n_empty": 0, "n_short": 0}).items() if k != "path"}
        f |= {"class_counts": by_file.get(f["path"], {}), "empty_rows": samples.get((f["path"], "empty"), []), "short_rows": samples.get((f["path"], "short"), [])}
    has = lambda fs, k: sum(f[k] > 0 for f in fs)
    summary = lambda fs: {
        "n_files": len(fs), "n_rows": sum(f["n_rows"] for f in fs), "n_files_with_duplicates": has(fs, "n_duplicates"),
        "n_files_with_empty": has(fs, "n_empty"), "n_files_with_short": has(fs, "n_short"),
    }
    payload = {
        "totals": summary(files), "groups": {g: summary([f for f in files if f["file_group"] == g]) for g in validate.GROUPS}, "files": files,
        "safety": safety(rows, files), "aliases": ALIASES,
    }
    rows.unpersist()
    return payload


def safety(rows: DataFrame, files: list[dict[str, Any]]) -> dict[str, Any]:
    """Texts across benchmark and supporting files: overlaps and conflicting labels."""
    usable = [f for f in files if f["text_columns"] and f["class_columns"]]
    anchor = [f["path"] for f in usable if f["file_group"] == validate.GROUPS[0]]
    support = [f["path"] for f in usable if f["file_group"] == validate.GROUPS[1]]
    found = rows.where((F.col("text") != "") & F.col("path").isin([*anchor, *support])).select(F.col("path").alias("file"), fingerprint(F.col("text")).alias("text_hash"), normalized(F.col("label")).alias("label"))
    pool = found.where(F.col("file").isin(support))
    conflicts = validate.cross_file_conflicts(pool)
    pairs = _dicts(validate.file_pairs(found).orderBy(F.desc("n_shared"), "file_a", "file_b"))
    return {
        "anchor_files": anchor, "supporting_files": support, "unique_texts": found.select("text_hash").distinct().count(),
        "texts_in_several_files": validate.texts_in_several_files(found).count(), "pairs": pairs,
        "train_dev_overlap": sum(p["n_shared"] for p in pairs if p["file_a"] in anchor and p["file_b"] in anchor),
        "supporting_texts_in_several_files": validate.texts_in_several_files(pool).count(), "supporting_conflicts": conflicts.count(),
        "conflict_examples": _dicts(conflicts.orderBy(F.desc("n_files"), F.desc("n_rows"), "text_hash").limit(20)),
    }


def file_summary(payload: dict[str, Any]) -> list[dict[str, Any]]:
    """One flat row for each file."""
    flat = lambda f: {k: ",".join(v) if isinstance(v, list) else v for k, v in f.items() if k not in ("class_counts", "empty_rows", "short_rows")}
    return [flat(f) for f in payload["files"]]


# --- curation and cleaning ----------------------------------------------------------------------


def raw_records(spark: SparkSession, root: str | Path) -> DataFrame:
    """Records of the four raw sources, in order."""
    out = None
    for split, dataset, path, (i, t, c) in SOURCES:
        full = Path(root, path).as_posix()
        rows = readers.mapped(readers.numbered(spark, full, "\t", [i, t, c]), {"source_id": i, "text": t, "raw_label": c})
        part = rows.withColumns({"split_name": F.lit(split), "source_dataset": F.lit(dataset), "source_file": F.lit(full)})
        out = part if out is None else out.unionByName(part)
    return curate.records(out)


def curation(spark: SparkSession, root: str | Path) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """The three outputs and the curation payload."""
    rows = raw_records(spark, root)
    curated = curate.curate(rows).cache()
    stats: dict[str, dict[str, dict[str, int]]] = {}
    for r in curate.statistics(curated).orderBy("output", "dimension", F.desc("n"), "key").collect():
        stats.setdefault(r.output, {}).setdefault(r.dimension, {})[r.key] = r.n
    order = ["source_file", "source_row_number"]
    shown = ["text_hash", "source_dataset", "source_id", "source_row_number", "normalized_raw_label"]
    overlaps = validate.first_rows(curated.where(F.col("drop_reason").contains("overlap")), ["split_name", "drop_reason"], order, 20)
    payload = {
        "statistics": stats, "overlaps": _dicts(curate.overlap_counts(curated)), "n_conflicts": curate.conflicts(rows).count(),
        "conflict_examples": _dicts(curate.conflict_examples(rows, order)), "overlap_examples": _dicts(overlaps.select("split_name", "drop_reason", *shown)),
    }
    return {s: curate.output(curated, s) for s in SPLITS}, payload


def cleaning(rows: DataFrame) -> DataFrame:
    """A curated table with original_text and processed_text in place of text."""
    return curate.processed(rows, clean)


def clean_folder(spark: SparkSession, source: str | Path, target: str | Path) -> dict[str, Path]:
    """The three curated CSV files, cleaned, under the same names in another folder."""
    from corpusloom.sources.sinks import csv_file

    out = {}
    Path(target).mkdir(parents=True, exist_ok=True)
    for split in SPLITS:
        rows = readers.table(spark, Path(source, f"{split}.csv"), columns=["text"])
        out[split] = Path(target, f"{split}.csv")
        csv_file(cleaning(rows), out[split])
    return out


# --- audits -------------------------------------------------------------------------------------


def audit(train: DataFrame, dev: DataFrame, threshold: float = 0.9) -> dict[str, Any]:
    """Training against dev rows: overlaps of three fields, repeats, similar rows, verdict."""
    fields = ["source_id", "original_text", "processed_text"]
    order = [c for c in ("source_row_number",) if c in train.columns and c in dev.columns] + ["source_id"]
    overlaps = {
        f: {"count": leakage.shared_values(train, dev, f).count(), "pairs": _dicts(leakage.representative_pairs(train, dev, f, order, 5))} for f in fields
    }
    repeats = {n: leakage.duplicate_totals(leakage.duplicate_groups(df, "processed_text")).first().asDict() for n, df in (("train", train), ("dev", dev))}
    return {
        "overlaps": overlaps, "duplicates": repeats, "near_duplicates": leakage.similar_rows(train, dev, threshold).count(), "threshold": threshold,
        "status": "block" if any(o["count"] for o in overlaps.values()) else "pass",
    }


def candidate_rows(raw: DataFrame) -> DataFrame:
    """Rows (source_id, text, raw_label) with labels and cleaned text."""
    label = normalized(F.col("raw_label"))
    return raw.select("source_id", "raw_label", label.alias("normalized_raw_label"), macro(label).alias("macro_label"), F.col("text").alias("original_text"), clean(F.col("text")).alias("processed_text"))


def precheck(name: str, raw: DataFrame, references: dict[str, tuple[DataFrame, DataFrame]], threshold: float = 0.9) -> dict[str, Any]:
    """A candidate split against the references (interim and processed rows of each)."""
    rows = candidate_rows(raw).cache()
    kept = rows.where("macro_label is not null")
    n, n_raw = kept.count(), rows.count()
    percent = lambda k: round(100 * k / n, 2) if n else 0.0
    overlaps: dict[str, dict[str, Any]] = {}
    hit = None
    missing = {}
    for ref, (interim, processed) in references.items():
        both = interim.select("source_id", F.col("text").alias("original_text")).union(processed.select("source_id", "original_text"))
        sides = {"source_id": both, "original_text": both, "processed_text": processed}
        missing[ref] = leakage.missing_ids(interim, processed).count()
        for field, side in sides.items():
            ids = leakage.shared_ids(side, kept, field)
            k = ids.count()
            overlaps[f"{ref}.{field}"] = {"count": k, "percent": percent(k)}
            hit = ids if hit is None else hit.union(ids)
    combined = hit.distinct().count() if hit is not None else 0
    train = references["train_core"][1]
    near = leakage.similar_rows(train, kept, threshold).select("source_id").distinct().count()
    tier = tiers.OOD_OK if combined == 0 else tiers.HISTORICAL if percent(combined) <= 5 else tiers.NOT_YET
    counts = lambda df: {r.label: r.n for r in leakage.label_distribution(df).collect()}
    own, base = counts(kept), counts(references["train_core"][0])
    share = lambda c: {k: round(100 * v / max(1, sum(c.values())), 2) for k, v in c.items()}
    inventory = _dicts(leakage.label_inventory(rows).orderBy("normalized_raw_label"))
    levantine = [r for r in inventory if r["normalized_raw_label"] in LEVANTINE]
    payload = {
        "candidate": name, "rows": n_raw, "kept_rows": n, "mapped": [r["normalized_raw_label"] for r in inventory if r["is_mapped"]],
        "dropped": [r["normalized_raw_label"] for r in inventory if not r["is_mapped"]], "levantine_confirmed": all(MACRO[r["normalized_raw_label"]] == "Levantine" for r in levantine),
        "distribution": own, "delta_points": {k: round(share(own)[k] - share(base)[k], 2) for k in LABELS}, "overlaps": overlaps, "missing_processed": missing,
        "combined": {"count": combined, "percent": percent(combined)}, "duplicates": leakage.duplicate_totals(leakage.duplicate_groups(kept, "original_text")).first().asDict(),
        "near_duplicates": {"count": near, "percent": percent(near), "threshold": threshold}, "tier": tier, "caveat": combined > 0 and percent(combined) >= 1,
    }
    rows.unpersist()
    return payload


def recommendation(payloads: list[dict[str, Any]]) -> str:
    """What the audited candidates allow: stop, proceed, mixed or historical use only."""
    kinds = {p["tier"] for p in payloads}
    if tiers.NOT_YET in kinds:
        return "stop: deduplicate, drop the source, or use it as held-out historical evaluation with a caveat"
    if kinds == {tiers.OOD_OK}:
        return "proceed: every candidate is free of exact overlaps"
    if tiers.OOD_OK in kinds:
        strict = ", ".join(p["candidate"] for p in payloads if p["tier"] == tiers.OOD_OK)
        return f"mixed: strict evaluation only for {strict}; the others are historical"
    return "historical only: no candidate is fit for strict evaluation"


# --- models -------------------------------------------------------------------------------------


def measured(predictions: DataFrame) -> dict[str, Any]:
    """Metrics of one set of predictions (true_label, predicted_label)."""
    rows = predictions.withColumn("model_name", F.lit("m")).cache()
    per = {r.label: r.asDict() for r in M.per_class(rows, ["model_name"]).collect()}
    mean = M.averages(M.per_class(rows, ["model_name"]), ["model_name"]).first()
    hits = M.accuracy(rows, ["model_name"]).first()
    counts = {(r.true_label, r.predicted_label): r.n for r in M.confusion(rows, []).collect()}
    out = {
        "rows": hits.n_rows if hits else 0, "accuracy": hits.accuracy if hits else 0.0, "macro_f1": mean.macro_f1 if mean else 0.0, "weighted_f1": mean.weighted_f1 if mean else 0.0,
        "present_macro_f1": mean.present_macro_f1 if mean else 0.0, "per_class_metrics": {k: {x: per[k][x] for x in ("precision", "recall", "f1", "support")} for k in LABELS if k in per},
        "confusion_matrix": [[counts.get((t, p), 0) for p in LABELS] for t in LABELS],
        "tracked": {f"{t}->{p}": counts.get((t, p), 0) for t, p in TRACKED},
        "top_confusions": [{"true": r.true_label, "predicted": r.predicted_label, "n": r.n} for r in M.top_confusions(rows, ["model_name"]).orderBy("rank").collect()],
    }
    rows.unpersist()
    return out


def baseline(train: DataFrame, dev: DataFrame, config: BaselineConfig) -> tuple[DataFrame, dict[str, Any]]:
    """Predictions of the linear baseline for ``dev``, and the metrics."""
    vectorizer = features.Vectorizer(config.word_min_df, config.char_min_df, tuple(config.word_ngrams), tuple(config.char_ngrams), config.lowercase)
    found = features.fit_predict(train, dev, "source_id", config.text_column, config.target_column, config.c, config.max_iter, vectorizer)
    return found, measured(found) | {"train_rows": train.count(), "dev_rows": dev.count()}


def prompted_run(train: DataFrame, dev: DataFrame, config: InferenceConfig, make_provider: Callable[[], inference.Provider], mode: str) -> tuple[DataFrame, dict[str, Any]]:
    """Predictions of a text model for ``dev`` in one mode (zero_shot or few_shot), metrics and usage."""
    rows = selection.batches(dev, ["source_row_number"], config.batch_size)
    support = None
    if mode == "few_shot":
        chosen = selection.require_per_class(selection.few_shot(train, config.text_column, config.target_column, config.few_shot_examples_per_class), config.few_shot_examples_per_class)
        support = F.lit(inference.support_block(chosen).first()["support"])
    replies = inference.ask(inference.prompts(rows, config.text_column, support), make_provider, inference.developer_prompt(config.labels))
    replies = cut(replies)  # answers are paid for: asked once, kept where a lost executor doesn't take them
    found = inference.answered(rows, inference.answers(replies)).select("source_id", F.col(config.target_column).alias("true_label"), "predicted_label")
    found = cut(found)
    n = found.count()
    spent = M.usage(replies.withColumn("k", F.lit(1)), ["k"], "prompt_tokens", "completion_tokens", "latency_ms", config.price_in, config.price_out).drop("k").first()
    usage = (spent.asDict() if spent else {}) | {"latency_per_row_ms": (spent.total_latency_ms / n if spent and n else 0.0)}
    return found, measured(found) | {"mode": mode, "usage": usage}


def stability(runs: DataFrame) -> dict[str, Any]:
    """Mean and spread across seeds of runs (seed, accuracy, macro_f1, per_class_metrics)."""
    parts = [runs.select("seed", F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("accuracy", "macro_f1")]
    parts += [runs.select("seed", F.lit(f"f1 {x}").alias("metric"), F.col(f"per_class_metrics.{x}.f1").cast("double").alias("value")) for x in LABELS]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    rows = M.seed_summary(long, ["metric"], "value").collect()
    out = {r.metric: {"mean": r["mean"], "std": r.deviation, "values": [x.value for x in r["values"]]} for r in rows}
    spread = out["macro_f1"]["std"]
    tier = None if spread is None else runs.sparkSession.range(1).select(tiers.stability_tier(F.lit(spread)).alias("t")).first()["t"]
    return {"n_seeds": runs.count(), "metrics": out, "interpretation": tier}


def robustness(clean_run: dict[str, Any], perturbed: dict[str, dict[str, Any]]) -> dict[str, dict[str, float]]:
    """Drops of accuracy and macro F1 of each perturbation family."""
    out = {}
    for family, run in perturbed.items():
        drop = {m: clean_run[m] - run[m] for m in ("accuracy", "macro_f1")}
        out[family] = {f"{m}_drop": d for m, d in drop.items()} | {f"relative_{m}_drop_pct": (100 * d / clean_run[m] if clean_run[m] else 0.0) for m, d in drop.items()}
    return out


def compare_robustness(a: dict[str, float], b: dict[str, float]) -> dict[str, str]:
    """Which of two models loses more, and whether the first one's lead over the second grows."""
    larger = lambda key: "first" if a[key] > b[key] else "second" if b[key] > a[key] else "equal"
    trend = {"first": "shrinks", "second": "grows", "equal": "stays"}[larger("macro_f1_drop")]
    return {"larger_absolute_drop": larger("macro_f1_drop"), "larger_relative_drop": larger("relative_macro_f1_drop_pct"), "first_model_lead": trend}
