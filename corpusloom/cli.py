"""Command line: one sub-command for each run over files."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import pipelines, reports
from corpusloom.plans import runs as model_runs
from corpusloom.sources import readers, sinks
from corpusloom.sources.config import BaselineConfig, HardSubsetConfig, InferenceConfig, load
from corpusloom.sources.providers import Client


def parser() -> argparse.ArgumentParser:
    """The sub-commands and their arguments."""
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "validate": ["data_root", "report_dir"], "curate": ["data_root", "output_dir", "report_dir"], "clean": ["input_dir", "output_dir"],
        "audit": ["train", "dev", "report_dir"], "precheck": ["data_root", "interim_dir", "processed_dir", "report_dir"],
        "baseline": ["config"], "robustness": ["config"], "infer": ["config"], "hard-subset": ["config"], "stability": ["folder", "pattern", "report_dir"],
    }.items():
        command = sub.add_parser(name)
        for a in arguments:
            command.add_argument(f"--{a.replace('_', '-')}", required=True)
        if name in ("audit", "precheck"):
            command.add_argument("--threshold", type=float, default=0.9)
        if name == "stability":
            command.add_argument("--seeds", type=int, nargs="+", required=True)
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> dict[str, Path]:
    """Do one command; names and paths of what was written."""
    c = args.command
    if c == "validate":
        payload = pipelines.validation(spark, args.data_root)
        files = spark.createDataFrame([{k: str(v) for k, v in f.items()} for f in pipelines.file_summary(payload)]) if payload["files"] else None
        tables = {"data_validation_files.csv": files} if files is not None else {}
        return sinks.fan_out(args.report_dir, tables, {"data_validation_report.json": payload}, {"data_validation_summary.md": reports.validation(payload)})
    if c == "curate":
        tables, payload = pipelines.curation(spark, args.data_root)
        out = sinks.fan_out(args.output_dir, {f"{k}.csv": v for k, v in tables.items()})
        return out | sinks.fan_out(args.report_dir, None, {"interim_curation_report.json": payload}, {"interim_curation_report.md": reports.curation(payload)})
    if c == "clean":
        return pipelines.clean_folder(spark, args.input_dir, args.output_dir)
    if c == "audit":
        payload = pipelines.audit(*[readers.table(spark, p, columns=["source_id", "original_text", "processed_text"]) for p in (args.train, args.dev)], args.threshold)
        return sinks.fan_out(args.report_dir, None, {"leakage_audit.json": payload}, {"leakage_audit.md": reports.audit(payload)})
    if c == "precheck":
        references = {s: (readers.table(spark, Path(args.interim_dir, f"{s}.csv")), readers.table(spark, Path(args.processed_dir, f"{s}.csv"))) for s in ("train_core", "dev_core")}
        payloads = []
        for name, path, (i, t, label) in pipelines.CANDIDATES.values():
            full = Path(args.data_root, path)
            if full.exists():
                raw = readers.mapped(readers.table(spark, full, "\t", [i, t, label]), {"source_id": i, "text": t, "raw_label": label})
                payloads.append(pipelines.precheck(name, raw, references, args.threshold))
        texts = {f"precheck_{n}.md": reports.precheck(p) for n, p in enumerate(payloads)} | {"precheck_summary.md": reports.precheck_summary(payloads, pipelines.recommendation(payloads))}
        return sinks.fan_out(args.report_dir, None, {f"precheck_{n}.json": p for n, p in enumerate(payloads)}, texts)
    if c == "baseline":
        return model_runs.baseline_run(spark, load(args.config, BaselineConfig))
    if c == "robustness":
        return model_runs.robustness_run(spark, load(args.config, BaselineConfig))
    if c == "infer":
        config = load(args.config, InferenceConfig)
        return model_runs.inference_run(spark, config, lambda: Client(config))
    if c == "hard-subset":
        subset = load(args.config, HardSubsetConfig)
        return model_runs.hard_subset_run(spark, subset, lambda: Client(subset))
    runs = readers.seed_runs(spark, args.folder, args.seeds, args.pattern)
    payload = pipelines.stability(runs.withColumn("seed", F.col("seed").cast("int")))
    return sinks.fan_out(args.report_dir, None, {"stability.json": payload}, {"stability.md": reports.stability(payload)})


def main(argv: list[str] | None = None) -> int:
    """Entry point."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    for name, path in run(args, spark).items():
        print(f"{name}: {path}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
