"""Problem 2: same or almost same records across splits, by a segment join.

A text is the sorted sequence of its distinct words (hashed to 64 bits; hash
order mixes frequent words among rare ones).  Between two such sequences of a
and b words the insertion-deletion distance d is the size of the symmetric
difference, so words in common / words in either > t holds exactly where
d * (1 + t) < (1 - t) * (a + b): the overlap search is an edit-distance join.

For an evaluation sequence of l words no partner is further than k(l), so it is
cut into k(l) + 1 segments and at least one of them stands unbroken in every
partner.  Training sequences give their substrings of the lengths that segments
of partners can have; both are joined on the substring's hash, at allowed
lengths and positions only.  Every sequence carries 64 parity bits of its words;
two sequences are at least as far apart as their bits, so the join itself drops
what is too far, and every candidate left is verified by banded dynamic
programming.  Texts with equal word sets are one class on each side, so a hot
text is a single row until the pairs are written out.

A segment that many evaluation sequences share (a template) is split into salts:
its evaluation rows are spread over them, its training rows repeated for each.

Defined cases: rows without an id and texts without words are in no pair; a threshold met exactly
is no pair; null source ids and such of blanks alone match nothing; texts of any length are compared
whole; a pair that both text and source id give comes out (and is counted) once; an empty side gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import key128
from corpusloom.llm.words import word_set
from corpusloom.plans.lineage import cut
from corpusloom.plans.shipping import ship

#: The threshold t as a fraction: similarity above 4/5.
T_NUM, T_DEN = 4, 5
#: Evaluation sequences of one salt of a segment, at least; the 65536th part of
#: all segments if that is more, so no more than 65536 segments have salts.
SALT_ROWS, SALT_KEYS = 1024, 65536
#: Salts of one segment, at most.
SALTS = 256
#: Cells of the dynamic programme that are held at once.
CELLS = 1 << 22


#: Base of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
PIECES = "h long, k1 long, n int, p int, s long"


def edits(l: int) -> int:
    """Largest distance of any partner of a sequence of ``l`` words."""
    return (l * (T_DEN - T_NUM) - 1) // T_NUM


def _pair_edits(a: Column, l: Column) -> Column:
    """Largest distance of a pair with ``a`` and ``l`` words."""
    return F.floor(((T_DEN - T_NUM) * (a + l) - 1) / (T_DEN + T_NUM)).cast("int")


def segments(l: int) -> list[tuple[np.ndarray, int]]:
    """(starts, size) of the k + 1 segments of ``l`` words; the last ones are longer by one."""
    m = edits(l) + 1
    size, longer = divmod(l, m)
    i = np.arange(m)
    starts = i * size + np.maximum(i - (m - longer), 0)
    return [(x, n) for x, n in ((starts[: m - longer], size), (starts[m - longer :], size + 1)) if len(x)]


@lru_cache(maxsize=4096)
def substrings(a: int) -> list[tuple[np.ndarray, int]]:
    """(starts, size) of the substrings of ``a`` words that a segment of a partner can equal."""
    partners = range(a * T_NUM // T_DEN + 1, -(-a * T_DEN // T_NUM))
    sizes = {n for l in partners for n in (l // (edits(l) + 1), -(-l // (edits(l) + 1)))}
    return [(np.arange(a - n + 1), n) for n in sorted(sizes) if n <= a]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def pieces(pick: Callable[[int], list[tuple[np.ndarray, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of PIECES for the pieces (starts, size) that ``pick`` names for each length.

    A piece's hash is that of a polynomial in its words, taken from running sums,
    so it costs the same for every size; rows of equal length are done together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w")
            values, starts = w.values.to_numpy(zero_copy_only=False).view(np.uint64), w.offsets.to_numpy()[:-1].astype(np.int64)
            sizes, key = np.diff(w.offsets.to_numpy()), batch.column("k1").to_numpy()
            for n in np.unique(sizes):
                r = np.flatnonzero(sizes == n)
                words = values[starts[r][:, None] + np.arange(n)]
                bits = np.left_shift(np.uint64(1), words & np.uint64(63))
                parity = np.bitwise_xor.reduce(bits, axis=1)
                sums = np.zeros((len(r), n + 1), np.uint64)
                np.cumsum(words * _powers(BASE, n), axis=1, out=sums[:, 1:])
                back = _powers(BASE_INVERSE, n)
                for at, size in pick(int(n)):
                    h = (sums[:, at + size] - sums[:, at]) * back[at] + np.uint64(size)
                    h = ((h ^ (h >> np.uint64(32))) * MIX).ravel()
                    each = lambda x: np.repeat(x, len(at))  # noqa: B023, E731
                    columns = [h.view(np.int64), each(key[r]), np.full(len(h), n, np.int32), np.tile(at, len(r)).astype(np.int32), each(parity).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "k1", "n", "p", "s"])

    return run


def _padded(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    """Sequences as rows of a matrix."""
    out = np.full((len(sizes), int(sizes.max(initial=0))), fill, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = values[np.repeat(starts, sizes) + places]
    return out


def _swept(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, width: int) -> np.ndarray:
    """Insertion-deletion distance of row pairs where it is at most ``width``, more elsewhere.

    One sweep over the antidiagonals i + j = s, for all pairs of the block at
    once, within ``width`` diagonals on either side.  A cell depends on its
    neighbours of s - 1 and on itself of s - 2, which have the other and the same
    parity, so one line of cells is enough.
    """
    big = np.int32(1 << 28)
    most_a, most_b = a.shape[1], b.shape[1]
    a, b = np.pad(a, ((0, 0), (1, 0)), constant_values=-1), np.pad(b, ((0, 0), (1, 0)), constant_values=-2)
    cells = np.full((len(la), 2 * width + 3), big)  # cell c is the diagonal j - i = c - 1 - width
    cells[:, width + 1] = 0
    answer = np.where((la == 0) & (lb == 0), 0, big)
    ends, rows = la + lb, np.arange(len(la))
    corner = np.clip(lb - la + width + 1, 0, 2 * width + 2)
    least = answer
    for s in range(1, int(ends.max()) + 1):
        lo, hi = max(-width, -s, s - 2 * most_a), min(width, s, 2 * most_b - s)
        lo, hi = lo + ((lo + s) & 1), hi - ((hi + s) & 1)
        if lo > hi:
            continue
        c, d = lo + width + 1, hi + width + 1
        best = np.minimum(cells[:, c - 1 : d : 2], cells[:, c + 1 : d + 2 : 2]) + 1
        i, j = (s - hi) // 2, (s + lo) // 2
        same = a[:, i : i + best.shape[1]][:, ::-1] == b[:, j : j + best.shape[1]]
        np.minimum(best, cells[:, c : d + 1 : 2], out=best, where=same)
        cells[:, c : d + 1 : 2] = best
        done = ends == s
        if done.any():
            answer = np.where(done & (np.abs(lb - la) <= width), cells[rows, corner], answer)
        if s % 64 == 0:
            least = best.min(axis=1)
        elif s % 64 == 1 and s > 1 and (np.minimum(least, best.min(axis=1)) > width).all():
            break  # nothing in the band can come back within it
    return answer


def banded(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the insertion-deletion distance of row pairs is at most ``k``.

    The band is doubled from 64 until it decides all pairs: a distance within the
    band is exact, and one beyond it exceeds the band.
    """
    near = np.zeros(len(la), bool)
    open_, width = np.flatnonzero(np.abs(la - lb) <= k), 64
    while len(open_):
        band = min(width, int(k[open_].max()))
        found = _swept(a[open_], la[open_], b[open_], lb[open_], band)
        near[open_[found <= k[open_]]] = True
        open_, width = open_[(found > band) & (k[open_] > band)], width * 2
    return near


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within their distance, in blocks of similar length and bounded cells."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = batch.column("we"), batch.column("wt")
        vx, vy = (c.values.to_numpy(zero_copy_only=False) for c in (x, y))
        sx, sy = (c.offsets.to_numpy()[:-1].astype(np.int64) for c in (x, y))
        lx, ly = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in (x, y))
        k = ((T_DEN - T_NUM) * (lx + ly) - 1) // (T_DEN + T_NUM)
        keep = np.zeros(len(k), bool)
        longest = np.maximum(lx, ly)
        order = np.argsort(longest, kind="stable")
        at = 0
        while at < len(order):
            # sizes within a quarter of each other, and no more cells than bounded
            most = max(int(longest[order[at]] * 5 // 4), 8)
            end = int(np.searchsorted(longest[order], most, "right"))
            end = min(end, at + max(1, CELLS // (2 * most)))
            r = order[at:end]
            keep[r] = banded(_padded(vx, sx[r], lx[r], -1), lx[r], _padded(vy, sy[r], ly[r], -2), ly[r], k[r])
            at = end
        yield batch.select(["e1", "e2", "t1", "t2"]).filter(pa.array(keep))


def classes(df: DataFrame, side: Column, extra: list[str] | None = None) -> DataFrame:
    """record_id, side (true: training), ``extra``, key and words; rows without id or words left out."""
    own = extra or []
    rows = df.where("record_id is not null").select("record_id", *own, side.alias("train"), word_set(F.col("text")).alias("w"))
    return rows.where("train is not null and size(w) > 0").select("record_id", *own, "train", *key128(F.col("w")), "w")


def salts(e: DataFrame) -> DataFrame:
    """(h, n_salts) of the segments that too many evaluation sequences share (at most SALT_KEYS)."""
    counts = e.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    often = cut(counts.where(F.col("n") >= SALT_ROWS))
    if often.isEmpty():
        return often.select("h", F.lit(1).alias("n_salts"))
    least = max(SALT_ROWS, -(-e.count() // SALT_KEYS))
    return often.where(F.col("n") >= least).select("h", F.least(F.lit(SALTS), F.ceil(F.col("n") / least)).cast("int").alias("n_salts"))


def class_pairs(rows: DataFrame) -> DataFrame:
    """(e1, e2, t1, t2) of the word sets of ``classes`` rows that are similar across the sides."""
    sets = cut(rows.groupBy("train", "k1", "k2").agg(F.first("w").alias("w")))
    e = sets.where("not train").select("k1", "w").mapInArrow(pieces(segments), PIECES)
    t = sets.where("train").select("k1", "w").mapInArrow(pieces(substrings), PIECES)
    e = e.select("h", F.col("k1").alias("e1"), F.col("n").alias("l"), F.col("p").alias("pe"), F.col("s").alias("es"))
    t = t.select("h", F.col("k1").alias("t1"), F.col("n").alias("a"), F.col("p").alias("pt"), "s")
    a, l, most = F.col("a"), F.col("l"), _pair_edits(F.col("a"), F.col("l"))
    shift = F.col("pt") - F.col("pe")
    near = (F.abs(a - l) <= most) & (shift * 2 >= -(most - a + l)) & (shift * 2 <= most + a - l)
    near &= F.bit_count(F.col("s").bitwiseXOR(F.col("es"))) <= most
    shared = salts(e)
    keys = ["h"]
    if not shared.isEmpty():
        few = F.broadcast(shared)
        n = F.coalesce("n_salts", F.lit(1))
        e = e.join(few, "h", "left").withColumn("salt", F.pmod(F.xxhash64("e1"), n).cast("int")).drop("n_salts")
        t = t.join(few, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("n_salts")
        keys = ["h", "salt"]
    pairs = e.join(t, keys).where(near).select("e1", "t1").distinct()
    we = sets.where("not train").select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("w").alias("we"))
    wt = sets.where("train").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("w").alias("wt"))
    checked = pairs.join(we, "e1").join(wt, "t1").select("e1", "e2", "t1", "t2", "we", "wt")
    return checked.mapInArrow(_verify, "e1 long, e2 long, t1 long, t2 long")


def _sides(rows: DataFrame, extra: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Evaluation and training rows with their class keys."""
    of = lambda test, name, p: rows.where(test).select(F.col("record_id").alias(name), F.col("k1").alias(f"{p}1"), F.col("k2").alias(f"{p}2"), *(extra or []))
    return of("not train", "e", "e"), of("train", "t", "t")


def similar(df: DataFrame, side: Column) -> DataFrame:
    """(e, t) record ids of evaluation and training records above the threshold."""
    ship(df.sparkSession)
    rows = classes(df, side)
    eid, tid = _sides(rows.drop("w"))
    return class_pairs(rows).join(eid, ["e1", "e2"]).join(tid, ["t1", "t2"]).select("e", "t")


def _source(df: DataFrame, side: Column) -> DataFrame:
    name = F.lower(F.regexp_replace("source_id", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))
    return df.select("record_id", side.alias("train"), name.alias("s")).where("record_id is not null and train is not null and s <> ''")


def same_source(df: DataFrame, side: Column) -> DataFrame:
    """(e, t) record ids with equal source_id, case and outer blanks ignored."""
    rows = _source(df, side)
    e = rows.where("not train").select(F.col("record_id").alias("e"), "s")
    return e.join(rows.where("train").select(F.col("record_id").alias("t"), "s"), "s").select("e", "t")


def link_counts(df: DataFrame, side: Column, by_source: bool) -> DataFrame:
    """(e, n): in how many pairs each evaluation record is, without writing the pairs.

    Training records are counted by class, by source id and by both first; pairs
    that both give are taken off once.
    """
    ship(df.sparkSession)
    name = F.lower(F.regexp_replace("source_id", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")) if by_source else F.lit(None).cast("string")
    rows = classes(df.withColumn("_s", F.when(name != "", name)), side, ["_s"])
    found = cut(class_pairs(rows))
    rows = rows.select("record_id", "train", "k1", "k2", F.col("_s").alias("s"))
    eid, tid = _sides(rows, ["s"])
    linked = found.join(tid.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")), ["t1", "t2"]).groupBy("e1", "e2").agg(F.sum("n").alias("n"))
    counts = [eid.join(linked, ["e1", "e2"]).select("e", "n")]
    if by_source:
        sources = _source(df, side)
        trained = sources.where("train").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        counts.append(sources.where("not train").select(F.col("record_id").alias("e"), "s").join(trained, "s").select("e", "n"))
        tn = tid.where("s is not null").groupBy("t1", "t2", "s").agg(F.count(F.lit(1)).alias("n"))
        en = eid.where("s is not null").select("e1", "e2", "s").distinct()
        both = found.join(en, ["e1", "e2"]).join(tn, ["t1", "t2", "s"]).groupBy("e1", "e2", "s").agg((-F.sum("n")).alias("n"))
        counts.append(eid.join(both, ["e1", "e2", "s"]).select("e", "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("e").agg(F.sum("n").alias("n"))
