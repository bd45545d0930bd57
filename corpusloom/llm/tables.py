"""The input tables of the queries, read lazily and whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def two_tables(spark: SparkSession, folder: str, text_of_leakage: str) -> list[tuple[str, DataFrame]]:
    """(name, rows) of the two post tables, each with record_id and ``text``."""
    interim = table(spark, folder, "interim_dataset")
    leakage = table(spark, folder, "ood_leakage_precheck")
    return [
        ("interim_dataset", interim.select("record_id", "split_name", "source_dataset", "text")),
        (
            "ood_leakage_precheck",
            leakage.select("record_id", "split_name", "source_dataset", "source_id", leakage[text_of_leakage].alias("text")),
        ),
    ]


def fixed_rows(df: DataFrame, columns: list[str], most: int = 1000) -> list[Row]:
    """The distinct rows of a table that is fixed and short; a longer one is an error."""
    rows = df.select(*columns).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a fixed table has more than {most} rows of {', '.join(columns)}")
    return rows
