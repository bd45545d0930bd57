"""Payloads as Markdown: one table renderer, and a layout for each kind of run."""

from __future__ import annotations

from typing import Any

from corpusloom.functions.labels import LABELS


def markdown_table(header: list[str], rows: list[list[Any]]) -> str:
    """A Markdown table; bars in cells are escaped, floats get four decimals."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(header) + " |", "| " + " | ".join("---" for _ in header) + " |"]
    return "\n".join([*lines, *["| " + " | ".join(map(show, r)) + " |" for r in rows]])


def document(title: str, sections: list[tuple[str, str]]) -> str:
    """A Markdown document of titled sections."""
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{body}" for name, body in sections if body]]) + "\n"


def records(items: list[dict[str, Any]], columns: list[str] | None = None) -> str:
    """A table of dictionaries with equal keys."""
    if not items:
        return "None."
    columns = columns or list(items[0])
    return markdown_table(columns, [[i.get(c, "") for c in columns] for i in items])


def mapping(values: dict[str, Any], names: tuple[str, str] = ("item", "value")) -> str:
    """A two-column table."""
    return markdown_table(list(names), [[k, v] for k, v in values.items()])


def validation(payload: dict[str, Any]) -> str:
    """The validation summary."""
    s = payload["safety"]
    groups = [{"group": g, **v} for g, v in payload["groups"].items()]
    files = [{k: f[k] for k in ("path", "layout", "file_group", "n_rows", "n_duplicates", "n_empty", "n_short", "duplicate_check")} for f in payload["files"]]
    overlap = {k: v for k, v in s.items() if isinstance(v, int)}
    labels = [{"path": f["path"], "column": c, "value": v, "n": n} for f in payload["files"] for c, counts in f["class_counts"].items() for v, n in counts.items()]
    return document("Data validation", [
        ("Totals", mapping(payload["totals"])), ("Groups", records(groups)), ("Texts across files", mapping(overlap)), ("File pairs", records(s["pairs"])),
        ("Conflicts", records(s["conflict_examples"])), ("Files", records(files)), ("Labels", records(labels)),
    ])


def curation(payload: dict[str, Any]) -> str:
    """The curation report."""
    stats = [{"output": o, "dimension": d, "key": k, "n": n} for o, ds in payload["statistics"].items() for d, ks in ds.items() for k, n in ks.items()]
    return document("Curation", [
        ("Kept and dropped rows", records(stats)), ("Overlaps", records(payload["overlaps"])),
        ("Conflicting texts", f"{payload['n_conflicts']} texts.\n\n{records(payload['conflict_examples'])}"), ("Dropped for overlap, first rows", records(payload["overlap_examples"])),
    ])


def precheck(payload: dict[str, Any]) -> str:
    """The pre-check of one candidate split."""
    return document(f"Pre-check of {payload['candidate']}", [
        ("Verdict", f"{payload['tier']}{' (with caveat)' if payload['caveat'] else ''}: {payload['combined']['count']} rows ({payload['combined']['percent']:.2f}%) with an exact overlap; "
         f"{payload['near_duplicates']['count']} similar rows. Bands: below 1%, 1%-5% band, above 5%."),
        ("Rows", mapping({"rows": payload["rows"], "kept": payload["kept_rows"], "mapped labels": ", ".join(payload["mapped"]), "dropped labels": ", ".join(payload["dropped"])})),
        ("Labels", records([{"label": k, "n": payload["distribution"][k], "delta_points": payload["delta_points"][k]} for k in LABELS])),
        ("Exact overlaps", records([{"check": k, **v} for k, v in payload["overlaps"].items()])), ("Repeated texts", mapping(payload["duplicates"])),
    ])


def precheck_summary(payloads: list[dict[str, Any]], advice: str) -> str:
    """All candidates side by side, with the recommendation."""
    rows = [{"candidate": p["candidate"], "kept": p["kept_rows"], "overlap": p["combined"]["count"], "percent": p["combined"]["percent"], "similar": p["near_duplicates"]["count"], "tier": p["tier"]} for p in payloads]
    return document("Pre-check summary", [("Candidates", records(rows)), ("Recommendation", advice)])


def audit(payload: dict[str, Any]) -> str:
    """The leakage audit of training against dev rows."""
    return document("Leakage audit", [
        ("Status", payload["status"]), ("Exact overlaps", mapping({k: v["count"] for k, v in payload["overlaps"].items()}, ("field", "values"))),
        ("Repeated texts", records([{"split": k, **v} for k, v in payload["duplicates"].items()])),
        ("Similar rows", f"{payload['near_duplicates']} dev rows above {payload['threshold']}."),
    ])


def classification(metrics: dict[str, Any]) -> str:
    """The text table of a classification report."""
    head = f"{'':>14}{'precision':>11}{'recall':>11}{'f1-score':>11}{'support':>11}\n"
    line = lambda n, m: f"{n:>14}{m['precision']:>11.4f}{m['recall']:>11.4f}{m['f1']:>11.4f}{m['support']:>11}"
    body = [line(k, v) for k, v in metrics["per_class_metrics"].items()]
    return "\n".join([head, *body, "", f"{'accuracy':>14}{metrics['accuracy']:>33.4f}{metrics['rows']:>11}", f"{'macro f1':>14}{metrics['macro_f1']:>33.4f}", f"{'weighted f1':>14}{metrics['weighted_f1']:>33.4f}"]) + "\n"


def model(title: str, metrics: dict[str, Any]) -> str:
    """Metrics and errors of one run."""
    per = [{"label": k, **v} for k, v in metrics["per_class_metrics"].items()]
    matrix = markdown_table(["true \\ predicted", *LABELS], [[t, *row] for t, row in zip(LABELS, metrics["confusion_matrix"], strict=True)])
    return document(title, [
        ("Metrics", mapping({k: metrics[k] for k in ("rows", "accuracy", "macro_f1", "weighted_f1", "present_macro_f1")})), ("Labels", records(per)), ("Confusion matrix", matrix),
        ("Tracked confusions", mapping(metrics["tracked"], ("direction", "n"))), ("Top confusions", records(metrics["top_confusions"])),
        ("Usage", mapping(metrics["usage"]) if "usage" in metrics else ""),
    ])


def comparison(title: str, runs: dict[str, dict[str, Any]]) -> str:
    """Several runs side by side."""
    rows = [{"run": k, "rows": v["rows"], "accuracy": v["accuracy"], "macro_f1": v["macro_f1"], **v["tracked"]} for k, v in runs.items()]
    return document(title, [("Runs", records(rows))])


def asked(title: str, runs: dict[str, dict[str, Any]]) -> str:
    """Runs of a text model: their metrics, and what they cost in requests, tokens and time."""
    usage = [{"run": k, **{x: v for x, v in r["usage"].items() if v is not None}} for k, r in runs.items()]
    per = [{"run": k, "label": x, **m} for k, r in runs.items() for x, m in r["per_class_metrics"].items()]
    columns = list(dict.fromkeys(c for u in usage for c in u))
    return document(title, [
        ("Runs", records([{"run": k, **{m: r[m] for m in ("rows", "accuracy", "macro_f1", "weighted_f1", "present_macro_f1")}} for k, r in runs.items()])),
        ("Usage", records(usage, columns)), ("Labels", records(per)),
    ])


def errors(title: str, runs: dict[str, dict[str, Any]], shown: dict[str, list[dict[str, Any]]]) -> str:
    """Which labels every run confuses, with the first rows of the tracked confusions."""
    sections = []
    for name, run in runs.items():
        by_label = [{"label": t, "rows": sum(row), "errors": sum(row) - row[i]} for i, (t, row) in enumerate(zip(LABELS, run["confusion_matrix"], strict=True))]
        sections += [
            (f"Errors by label, {name}", records(by_label)), (f"Most frequent confusions, {name}", records(run["top_confusions"])),
            (f"Tracked confusions, {name}", mapping(run["tracked"], ("direction", "n"))), (f"First rows, {name}", records(shown.get(name, []))),
        ]
    return document(title, sections)


def hard_subset(total: int, size: int, selectors: dict[str, int], combinations: dict[str, int], labels: dict[str, int]) -> str:
    """Definition of the hard subset."""
    return document("Hard subset", [
        ("Rows", mapping({"dev rows": total, "subset rows": size})), ("By selector", mapping(selectors)), ("By combination", mapping(combinations)), ("By label", mapping(labels)),
    ])


def stability(payload: dict[str, Any]) -> str:
    """Means and deviations across seeds."""
    show = lambda m: f"{m['mean']:.4f} +/- {m['std']:.4f}" if m["std"] is not None else f"{m['mean']:.4f}"
    return document("Stability", [("Metrics", mapping({k: show(v) for k, v in payload["metrics"].items()})), ("Interpretation", payload["interpretation"] or "one seed only")])


def robustness(families: dict[str, dict[str, float]]) -> str:
    """Drops of every perturbation family."""
    return document("Robustness", [("Drops", records([{"family": k, **v} for k, v in families.items()]))])
