"""Scans of text tables: every column a string, null read as ''."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.registry import require


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def header(path: str | Path, separator: str) -> list[str]:
    """Column names of one file (its first record, read on the driver)."""
    with open(path, encoding="utf-8", newline="") as f:
        return next(csv.reader(f, delimiter=separator), [])


def table(spark: SparkSession, path: str | Path, separator: str = ",", columns: list[str] | None = None, strict: bool = False) -> DataFrame:
    """One delimited file with header; ``columns`` must be there.

    ``strict`` reads malformed quoting (text after a closing quote) as Python's csv
    module does, in a Python worker.  The native reader leaves such quotes in place.
    """
    names = header(path, separator)
    require(names, columns or [])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if strict:
        return _strict(spark, path, separator, schema)
    raw = spark.read.schema(schema).csv(str(path), sep=separator, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", enforceSchema=True)
    return raw.select(*[F.coalesce(F.col(_quoted(n)), F.lit("")).alias(n) for n in names])


def numbered(spark: SparkSession, path: str | Path, separator: str = ",", columns: list[str] | None = None) -> DataFrame:
    """``table`` with source_row_number: the record's ordinal plus 1 for the header.

    A file with quoted line ends is one partition, so its records are numbered in order.
    """
    return table(spark, path, separator, columns).withColumn("source_row_number", F.monotonically_increasing_id() + 2)


def _strict(spark: SparkSession, path: str | Path, separator: str, schema: T.StructType) -> DataFrame:
    names = schema.fieldNames()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                rows = csv.DictReader(io.StringIO(content.decode("utf-8"), newline=""), delimiter=separator)
                yield pd.DataFrame([[r.get(n) or "" for n in names] for r in rows], columns=names)

    return spark.read.format("binaryFile").load(str(path)).select("content").mapInPandas(parse, schema)


def tree(root: str | Path, pattern: str = "*.tsv") -> list[str]:
    """Files below ``root`` that match ``pattern``, sorted by path."""
    return [p.as_posix() for p in sorted(Path(root).rglob(pattern))]


def mapped(rows: DataFrame, source: dict[str, str]) -> DataFrame:
    """Columns renamed: ``source`` gives the raw column of each new name."""
    require(rows.columns, list(source.values()))
    extra = [c for c in ("source_row_number",) if c in rows.columns]
    return rows.select(*extra, *[F.col(_quoted(raw)).alias(new) for new, raw in source.items()])


def json_table(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON documents, one per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def seed_runs(spark: SparkSession, folder: str | Path, seeds: list[int], name: str) -> DataFrame:
    """One metrics document per seed, with its seed; ``name`` has a place for it."""
    out = None
    for seed in seeds:
        part = json_table(spark, str(Path(folder, name.format(seed=seed)))).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def optional_table(spark: SparkSession, path: str | Path, columns: list[str], separator: str = ",") -> DataFrame:
    """``table``, or no rows with ``columns`` if the file is missing; rows that lack one are left out."""
    if not Path(path).exists():
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    rows = table(spark, path, separator)
    if not set(columns) <= set(rows.columns):
        return rows.sparkSession.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    held = F.lit(True)
    for c in columns:
        held = held & (F.col(_quoted(c)) != "")
    return rows.where(held)


def optional_json(spark: SparkSession, path: str | Path) -> DataFrame | None:
    """A JSON document, or None if the file is missing."""
    return json_table(spark, str(path)) if Path(path).exists() else None


def stream(spark: SparkSession, folder: str | Path, columns: list[str], separator: str = ",") -> DataFrame:
    """A stream of delimited files that arrive in ``folder``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.readStream.schema(schema).csv(str(folder), sep=separator, header=True, quote='"', escape='"')
    return raw.select(*[F.coalesce(F.col(_quoted(c)), F.lit("")).alias(c) for c in columns])
