"""Problem 1: records that are equal but for their formatting.

A text is reduced to its canonical form (no white space, no punctuation, lower
case; the pieces of a form sorted), hashed to 128 bits plus a check word, and
counted by a hash aggregate that combines on the map side.  The check word is
part of the grouping key, so two forms that collide in 128 bits stay apart and
``collisions`` can report them.

Defined cases: rows without an id and null, empty, blank and punctuation-only texts are no record of
any group; texts of any length are read whole; an empty table gives no row;
other columns are never read, so clashing names do no harm; ties for the first
record go to the smallest id, and a repeated id counts as often as it occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import check_word, key128
from corpusloom.llm.tables import fixed_rows
from corpusloom.plans.lineage import cut

IGNORED = r"[\p{P}\p{IsWhite_Space}]+"
CUTS = r"[|;\n]"
KEY = ["k1", "k2", "k3"]


def squeezed(text: Column) -> Column:
    """``text`` without white space and punctuation, in lower case."""
    return F.lower(F.regexp_replace(text, IGNORED, ""))


def canonical(text: Column, field_names: list[str]) -> Column:
    """Canonical form; the first letter tells forms (F) from running text (T).

    ``field_names`` are squeezed names of form fields, a small fixed list.
    """
    pieces = F.filter(F.split(text, CUTS, -1), lambda p: p.rlike(r"\P{IsWhite_Space}"))
    name = lambda p: squeezed(F.substring_index(p, ":", 1))
    value = lambda p: squeezed(F.substring(p, F.instr(p, ":") + 1, F.length(p)))
    known = lambda p: p.contains(":") & name(p).isin(field_names) if field_names else F.lit(False)
    form = (F.size(pieces) >= 2) & F.forall(pieces, known)
    parts = F.array_sort(F.transform(pieces, lambda p: F.concat(name(p), F.lit(":"), value(p))))
    plain = F.concat(F.lit("T"), squeezed(text))
    return F.when(text.contains(":") & text.rlike(CUTS), F.when(form, F.concat(F.lit("F"), F.array_join(parts, "|"))).otherwise(plain)).otherwise(plain)


def squeezed_names(form_fields: DataFrame) -> list[str]:
    """The squeezed names in form_fields (a fixed table of a dozen rows)."""
    rows = fixed_rows(form_fields.select(squeezed(F.col("field_name")).alias("n")).where("n <> ''"), ["n"])
    return sorted(r.n for r in rows)


def keyed(df: DataFrame, field_names: list[str], text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """record_id, key and ``extra`` columns of every row with a letter or digit.

    The narrow rows are kept: grouping and joining back read them, and each text is
    canonicalised once.
    """
    form = canonical(F.col(text), field_names)
    return cut(df.where(F.col("record_id").isNotNull() & F.col(text).rlike(r"[\p{L}\p{N}]")).select(
        "record_id", *(extra or []), *key128(form, ("k1", "k2")), check_word(form).alias("k3")
    ))


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct record: key, first_id and n_copies."""
    return rows.groupBy(*KEY).agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def members(rows: DataFrame) -> DataFrame:
    """``rows`` of groups with two or more records, with first_id and n_copies.

    The grouped side has one narrow row per group; on the other side a group may
    hold any share of the rows, which the adaptive skew join splits.
    """
    return rows.join(groups(rows).where("n_copies > 1"), KEY)


def copies(rows: DataFrame) -> DataFrame:
    """(first_id, copy_id) of every record that isn't the first of its group."""
    found = members(rows).where("record_id <> first_id")
    return found.select("first_id", F.col("record_id").alias("copy_id"))


def collisions(rows: DataFrame) -> DataFrame:
    """128-bit keys that more than one check word shares (normally none)."""
    return groups(rows).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1")


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of ``frames``."""
    return reduce(DataFrame.unionByName, frames)
