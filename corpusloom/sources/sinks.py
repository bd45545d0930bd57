"""Writing results: tables by Spark, small reports by the driver."""

from __future__ import annotations

import json
import shutil
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def csv_folder(rows: DataFrame, path: str | Path, order: list[str] | None = None) -> None:
    """CSV part files with header, as many as there are partitions; ordered if asked."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").csv(str(path), header=True, quote='"', escape='"', emptyValue="", nullValue="")


def csv_file(rows: DataFrame, path: str | Path, order: list[str] | None = None) -> None:
    """One CSV file, for results of a size that one file should have."""
    with tempfile.TemporaryDirectory(dir=Path(path).parent) as folder:
        one = rows.orderBy(*order).coalesce(1) if order else rows.coalesce(1)
        csv_folder(one, Path(folder, "part"))
        parts = sorted(Path(folder, "part").glob("part-*.csv"))
        if parts:
            shutil.move(parts[0], path)
        else:
            Path(path).write_text(",".join(rows.columns) + "\n", encoding="utf-8")


def json_file(payload: Any, path: str | Path) -> None:
    """A report as JSON with readable characters."""
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def text_file(text: str, path: str | Path) -> None:
    """A report as text or Markdown."""
    Path(path).write_text(text if text.endswith("\n") else text + "\n", encoding="utf-8")


def fan_out(folder: str | Path, tables: dict[str, DataFrame] | None = None, payloads: dict[str, Any] | None = None, texts: dict[str, str] | None = None) -> dict[str, Path]:
    """One result as several files; names and paths of what was written."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out: dict[str, Path] = {}
    for name, rows in (tables or {}).items():
        csv_file(rows, out.setdefault(name, Path(folder, name)))
    for name, payload in (payloads or {}).items():
        json_file(payload, out.setdefault(name, Path(folder, name)))
    for name, text in (texts or {}).items():
        text_file(text, out.setdefault(name, Path(folder, name)))
    return out
