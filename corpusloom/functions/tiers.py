"""Verdicts and display strings derived from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of the verdicts.
OOD_OK = "acceptable as OOD evaluation source"
HISTORICAL = "acceptable only as held-out historical evaluation"
NOT_YET = "not acceptable until deduplicated"
STABILITY = ["highly stable", "acceptable stability", "unstable, requires investigation"]


def overlap_tier(count: Column, percent: Column) -> Column:
    """Verdict on a candidate from its exact overlaps and their rounded percentage."""
    return F.when(count == 0, OOD_OK).when(percent <= 5, HISTORICAL).otherwise(NOT_YET)


def overlap_caveat(count: Column, percent: Column) -> Column:
    """Whether the verdict comes with a caveat: from 1 % on."""
    return (count > 0) & (percent >= 1)


def stability_tier(deviation: Column) -> Column:
    """Verdict on the spread of a metric across seeds."""
    return F.when(deviation < 0.005, STABILITY[0]).when(deviation <= 0.015, STABILITY[1]).otherwise(STABILITY[2])


def view_label(rows: Column, reference_rows: Column) -> Column:
    """Name of the evaluation view by its number of rows."""
    name = F.when(rows == reference_rows, F.lit("cleaned benchmark-safe dev")).otherwise(F.lit("original full-dev"))
    return F.concat(name, F.lit(" ("), rows.cast("string"), F.lit(" rows)"))


def mean_and_deviation(mean: Column, deviation: Column) -> Column:
    """Mean and deviation with four decimals."""
    return F.format_string("%.4f +/- %.4f", mean, deviation)


def improved(best: Column, value: Column, least: float, larger_is_better: bool = True) -> Column:
    """Whether ``value`` beats ``best`` by more than ``least``; the first value does."""
    gain = value - best if larger_is_better else best - value
    return best.isNull() | (gain > least)
