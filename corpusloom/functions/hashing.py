"""Wide hash keys built from the engine's own 64-bit hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seeds of the second and third word of a key.
SECOND, THIRD = 0x5EED2, 0x5EED3


def key128(value: Column, names: tuple[str, str] = ("k1", "k2")) -> list[Column]:
    """Two independent 64-bit words of ``value`` (string or array)."""
    return [
        F.xxhash64(value).alias(names[0]),
        F.xxhash64(F.lit(SECOND), value).alias(names[1]),
    ]


def check_word(value: Column) -> Column:
    """A third word, kept beside a 128-bit key so that a collision shows."""
    return F.xxhash64(F.lit(THIRD), value)


def unit(*values: Column) -> Column:
    """A reproducible number in [0, 1) from the hash of ``values``."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11).cast("double") * F.lit(2.0**-53)
