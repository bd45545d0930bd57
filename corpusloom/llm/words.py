"""Words of a text: longest runs of letters and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def word_set(text: Column) -> Column:
    """Sorted 64-bit hashes of the distinct lower-cased words; null gives none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(F.lower(w)))))
