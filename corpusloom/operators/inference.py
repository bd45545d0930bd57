"""Batched inference by a text model behind a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS, coerced
from corpusloom.functions.text import ratio, strip_ws, without_fences
from corpusloom.plans.shipping import ship

# The answer format and the headings that a prompt has.
FORMAT = 'Return valid JSON only in this format: {"predictions":[{"item_id":"1","label":"Saudi"}]}'
SUPPORT_HEADING = "Few-shot support examples:"
ITEMS_HEADING = "Items:"
ONCE = "Every item_id must appear exactly once."


class Provider(Protocol):
    """Answers (content, prompt tokens, completion tokens, latency in ms) to a prompt."""

    def __call__(self, developer_prompt: str, user_prompt: str) -> tuple[str, int, int, float]: ...


REGIONS = {"Saudi": "Saudi Arabia", "Egyptian": "Egypt", "Levantine": "the Levant", "Maghrebi": "North Africa west of Egypt"}
TASK = "You sort social media posts by where their Arabic comes from. Judge by words and endings that only one region uses, and not by what a post is about."


def developer_prompt(labels: list[str] = LABELS, task: str = TASK) -> str:
    """What the model is told once: the task (a parameter) and the label of each region."""
    choices = "; ".join(f"{x} for {REGIONS[x]}" if x in REGIONS else x for x in labels)
    return f"{task} Answer with one label for each post: {choices}."


def support_block(examples: DataFrame) -> DataFrame:
    """One row: the few-shot block of a prompt (few rows per label, bounded)."""
    order = F.array(*[F.lit(x) for x in LABELS])
    line = F.concat(F.lit('- label="'), F.col("label"), F.lit('", text="'), F.col("text"), F.lit('"'))
    items = examples.agg(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("label")).alias("a"), F.col("rank").alias("r"), line.alias("line")))).alias("x"))
    return items.select(F.when(F.size("x") > 0, F.concat(F.lit(f"\n{SUPPORT_HEADING}\n"), F.array_join("x.line", "\n"), F.lit("\n"))).otherwise("").alias("support"))


def prompts(batched: DataFrame, text: str, support: Column | None = None) -> DataFrame:
    """batch_id and user_prompt of rows with batch_id and item_id."""
    line = F.concat(F.col("item_id").cast("string"), F.lit("\t"), F.coalesce(text, F.lit("")))
    items = batched.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("item_id", line.alias("line")))).alias("x"))
    head = F.concat(F.lit("Classify "), F.size("x").cast("string"), F.lit(" Arabic short texts.\n"), F.lit(f"{FORMAT}\n{ONCE}\nEach label must be one of: {', '.join(LABELS)}.\n"))
    body = F.array_join("x.line", "\n")
    return items.select("batch_id", F.size("x").alias("n_items"), F.concat(head, support if support is not None else F.lit(""), F.lit(f"\n{ITEMS_HEADING}\n"), body).alias("user_prompt"))


def ask(prompted: DataFrame, make_provider: Callable[[], Provider], developer: str) -> DataFrame:
    """batch_id, content, prompt_tokens, completion_tokens and latency_ms of every prompt.

    Each partition makes its own provider; keys come from its environment.
    """
    ship(prompted.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for batch in batches:
            rows = [(b, *provider(developer, p)) for b, p in zip(batch.batch_id, batch.user_prompt, strict=True)]
            yield pd.DataFrame(rows, columns=["batch_id", "content", "prompt_tokens", "completion_tokens", "latency_ms"])

    schema = "batch_id long, content string, prompt_tokens long, completion_tokens long, latency_ms double"
    return prompted.select("batch_id", "user_prompt").mapInPandas(run, schema)


def answers(replies: DataFrame) -> DataFrame:
    """(batch_id, item_id, predicted_label) of every reply; the last answer of an item counts.

    Content that isn't such JSON, an item without id or a label that is none of
    the target labels is an error.
    """
    shape = "struct<predictions: array<struct<item_id: string, label: string>>>"
    parsed = F.from_json(without_fences(F.col("content")), shape)
    checked = F.when(parsed.predictions.isNull(), F.raise_error(F.lit("the reply has no list of predictions"))).otherwise(parsed.predictions)
    rows = replies.select("batch_id", F.posexplode(checked).alias("at", "x"))
    item = strip_ws(F.coalesce("x.item_id", F.lit("")))
    label = coerced(F.coalesce("x.label", F.lit("")))
    rows = rows.select(
        "batch_id", "at",
        F.when(item == "", F.raise_error(F.lit("a prediction has no item_id"))).otherwise(item).alias("item_id"),
        F.when(label.isNull(), F.raise_error(F.concat(F.lit("no such label: "), F.coalesce("x.label", F.lit(""))))).otherwise(label).alias("predicted_label"),
    )
    return rows.groupBy("batch_id", "item_id").agg(F.max_by("predicted_label", "at").alias("predicted_label"))


def answered(batched: DataFrame, found: DataFrame) -> DataFrame:
    """``batched`` rows with their predicted_label; a missing item is an error."""
    keyed = found.select("batch_id", F.col("item_id").cast("long").alias("item_id"), "predicted_label")
    joined = batched.join(keyed, ["batch_id", "item_id"], "left")
    missing = F.raise_error(F.concat(F.lit("the reply lacks item "), F.col("item_id").cast("string")))
    return joined.withColumn("predicted_label", F.when(F.col("predicted_label").isNotNull(), F.col("predicted_label")).otherwise(missing))


def latency(replies: DataFrame, n_rows: int) -> DataFrame:
    """Requests, total latency, and averages per request and per row."""
    sums = replies.agg(F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("total_ms"))
    return sums.withColumn("per_request_ms", ratio(F.col("total_ms"), F.col("n_requests"))).withColumn("per_row_ms", ratio(F.col("total_ms"), F.lit(n_rows)))
