"""Label space: four target labels, aliases of raw labels, and the macro map."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import strip_ws

# Target labels in report order, raw label aliases, macro labels.
LABELS = ["Saudi", "Egyptian", "Levantine", "Maghrebi"]
ALIASES = {"UAE": "UAE", "United_Arab_Emirates": "UAE"}
MACRO = {
    "Saudi_Arabia": "Saudi", "Egypt": "Egyptian",
    "Jordan": "Levantine", "Lebanon": "Levantine", "Palestine": "Levantine", "Syria": "Levantine",
    "Algeria": "Maghrebi", "Libya": "Maghrebi", "Morocco": "Maghrebi", "Tunisia": "Maghrebi",
}
LEVANTINE = ["Jordan", "Lebanon", "Palestine", "Syria"]
#: Confusions (true, predicted) that reports track.
TRACKED = [("Saudi", "Levantine"), ("Saudi", "Maghrebi"), ("Egyptian", "Maghrebi"), ("Egyptian", "Levantine")]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def normalized(label: Column) -> Column:
    """Trimmed raw label with its aliases mapped; null becomes ''."""
    trimmed = strip_ws(F.coalesce(label, F.lit("")))
    return F.coalesce(_lookup(ALIASES, trimmed), trimmed)


def macro(label: Column) -> Column:
    """Target label of a normalized raw label; null if out of scope."""
    return _lookup(MACRO, label)


def label_index(label: Column) -> Column:
    """Position of a target label from 0; null if it is none."""
    at = F.array_position(F.array(*[F.lit(x) for x in LABELS]), label)
    return F.when(at > 0, (at - 1).cast("int"))


def index_label(index: Column) -> Column:
    """Target label at a position; null for a null position."""
    return F.when(index.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in LABELS]), index + 1))


def label_dimension(spark: SparkSession) -> DataFrame:
    """(position, label) of the four target labels."""
    return spark.createDataFrame(list(enumerate(LABELS)), "position int, label string")


def tracked_dimension(spark: SparkSession) -> DataFrame:
    """(position, true_label, predicted_label) of the tracked confusions."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(TRACKED)], "position int, true_label string, predicted_label string")


def is_tracked(true: Column, predicted: Column) -> Column:
    """Whether a (true, predicted) pair is a tracked confusion."""
    return F.concat_ws(">", true, predicted).isin([">".join(p) for p in TRACKED])


def coerced(answer: Column) -> Column:
    """A model's answer as target label: exact, else by case, else contained; null if none."""
    trimmed = strip_ws(answer)
    out = F.lit(None).cast("string")
    for label in reversed(LABELS):
        out = F.when(F.lower(trimmed).contains(label.lower()), F.lit(label)).otherwise(out)
    for label in reversed(LABELS):
        out = F.when(F.lower(trimmed) == label.lower(), F.lit(label)).otherwise(out)
    return F.when(trimmed.isin(LABELS), trimmed).otherwise(out)
