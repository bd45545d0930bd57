"""Interfaces around a fine-tuned encoder: batches, schedule, checkpoints' choice.

Training itself is off: no deep learning library is installed here.  A tokenizer
is any callable from a text to token ids; a model is any callable from a padded
batch to label positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.labels import index_label, label_index
from corpusloom.plans.shipping import ship

Tokenizer = Callable[[str], list[int]]
Model = Callable[[list[list[int]], list[list[int]]], list[int]]


def tokenised(rows: DataFrame, key: str, text: str, target: str, tokenizer: Tokenizer, max_length: int) -> DataFrame:
    """key, input_ids cut to ``max_length``, attention_mask and label position."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [tokenizer(t or "")[:max_length] for t in batch.text]
            yield pd.DataFrame({"key": batch.key, "input_ids": ids, "attention_mask": [[1] * len(x) for x in ids], "labels": batch.labels})

    kind = dict(rows.dtypes)[key]
    source = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), label_index(F.col(target)).alias("labels"))
    out = source.mapInPandas(run, f"key {kind}, input_ids array<long>, attention_mask array<long>, labels int")
    return out.withColumnRenamed("key", key)


def padded(ids: Column, length: Column, fill: int = 0) -> Column:
    """``ids`` filled up to ``length``."""
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), F.greatest(length - F.size(ids), F.lit(0))))


def dynamic_padding(batches: DataFrame) -> DataFrame:
    """Rows with a batch_id, padded to the longest row of their batch."""
    longest = batches.groupBy("batch_id").agg(F.max(F.size("input_ids")).alias("longest"))
    rows = batches.join(longest, "batch_id")
    return rows.withColumn("input_ids", padded(F.col("input_ids"), F.col("longest"))).withColumn("attention_mask", padded(F.col("attention_mask"), F.col("longest"))).drop("longest")


def predict(rows: DataFrame, key: str, model: Model) -> DataFrame:
    """key and predicted_label of tokenised rows, in Arrow batches."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            width = max((len(x) for x in batch.input_ids), default=0)
            fill = lambda x: [*x, *[0] * (width - len(x))]  # noqa: B023, E731
            yield pd.DataFrame({"key": batch.key, "at": model([fill(x) for x in batch.input_ids], [fill(x) for x in batch.attention_mask])})

    kind = dict(rows.dtypes)[key]
    out = rows.select(F.col(key).alias("key"), "input_ids", "attention_mask").mapInPandas(run, f"key {kind}, at int")
    return out.select(F.col("key").alias(key), index_label(F.col("at")).alias("predicted_label"))


def learning_rate(step: Column, warmup: Column, total: Column, peak: float) -> Column:
    """Linear warm-up to ``peak``, then linear decay to 0."""
    rising = F.when(warmup > 0, step / warmup).otherwise(1.0)
    falling = F.greatest(F.lit(0.0), (total - step) / F.greatest(total - warmup, F.lit(1)))
    return F.lit(peak) * F.when(step < warmup, rising).otherwise(falling)
