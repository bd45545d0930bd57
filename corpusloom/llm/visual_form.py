"""Problem 6: one consistent form for texts that look the same.

A regular expression inside the JVM (the quick check) finds texts with an
unstable character: one that normalisation could change or combine, by the
Unicode properties of each character (``stable``).  Texts
without one are passed on as they are.  In the others only the unstable
segments, each with the character before and after it as context, are
normalised, and the results are spliced between the untouched stretches.

The form: wide, narrow and positional forms become the character itself;
canonical equivalents are composed (NFC); characters without ink or width go,
but for the joiner between two emoji; every space character is U+0020;
look-alike letters of Cyrillic, Greek and Armenian become the Latin letter;
Arabic keheh and Farsi yeh become kaf and yeh where a letter follows (there they
are drawn alike), a Farsi yeh that ends a word becomes the dotless one; Persian
digits drawn like the Arabic ones become these.  Hamza, dots, vowel marks,
tatweel, case, tabs and line ends stay.

Defined cases: null stays null, the empty text stays empty; a row without an id
is in no pair; texts of any length
are read whole; the form of a form is itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.hashing import key128
from corpusloom.plans.lineage import cut
from corpusloom.plans.shipping import ship

# Look-alike letters, each with the Latin letter it is drawn as.
CYRILLIC = "аАВеЕһНіІјЈКМоОрРсСѕЅТуУхХԁԛԚԝԜӏӀүҮѵѴ"
CYRILLIC_AS = "aABeEhHiIjJKMoOpPcCsSTyYxXdqQwWlIyYvV"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϹϳͿ"
GREEK_AS = "ABEZHIKMNOPTYXovcCjJ"
ARMENIAN = "օսոհցզՕՍ"
ARMENIAN_AS = "ounhgqOU"
# Persian digits drawn like the Arabic-Indic ones (not 4, 5, 6).
DIGITS = "۰۱۲۳۷۸۹"
DIGITS_AS = "٠١٢٣٧٨٩"
#: Tags of compatibility decompositions that stand for the same character.
SAME = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")

KEHEH, KAF, FARSI_YEH, YEH, DOTLESS = "\u06a9", "\u0643", "\u06cc", "\u064a", "\u0649"
JOINER = "\u200d"

# Code point ranges.
#: Without ink or width: default-ignorables, and controls but tab and line ends.
UNSEEN = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    (0xE0000, 0xE0FFF),
]
#: Space characters (Zs) but U+0020.
SPACES = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Arabic vowel marks: one is stable, the order of two may not be.
MARKS = (0x64B, 0x652)


def _class(ranges: list[tuple[int, int]], style: str) -> str:
    return "".join(f"{style.format(a)}-{style.format(b)}" for a, b in ranges)


_TABLE = str.maketrans(
    CYRILLIC + GREEK + ARMENIAN + DIGITS, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + DIGITS_AS
)
PY, JVM = "\\U{:08x}", "\\x{{{:x}}}"
_SPACE = re.compile(f"[{_class(SPACES, PY)}]")
_UNSEEN = re.compile(f"[{_class(UNSEEN, PY)}]")
_OTHER_UNSEEN = re.compile(f"(?!{JOINER})[{_class(UNSEEN, PY)}]")
_MARK = f"[{_class([MARKS], PY)}]"
#: Blocks whose characters are tried for stability; all others pass for unstable.
BLOCKS = [(0x00, 0x6FF), (0x2000, 0x2BFF), (0x1F000, 0x1FAFF)]
#: Shortest run of stable characters that the quick check names outside these blocks (it
#: is searched range by range; what it doesn't name is only looked at more closely).
LEAST_RUN, MAIN_BLOCKS = 16, [(0x00, 0xFF), (0x600, 0x6FF)]


def _pictured(ch: str) -> bool:
    return ch >= "\U0001f000" or (unicodedata.category(ch) == "So" and ch >= "\u2100")


def _joined(text: str) -> str:
    """Without joiners, but for those between two emoji."""
    return "".join(
        c for i, c in enumerate(text)
        if c != JOINER or (0 < i < len(text) - 1 and _pictured(text[i - 1]) and _pictured(text[i + 1]))
    )


def _plain(ch: str) -> str:
    shape = unicodedata.decomposition(ch)
    if not shape.startswith(SAME):
        return ch
    return "".join(_plain(chr(int(x, 16))) for x in shape.split()[1:])


def segment(text: str) -> str:
    """Canonical form of a segment that starts and ends at stable characters."""
    if JOINER in text:
        text = _joined(_OTHER_UNSEEN.sub("", text))
    else:
        text = _UNSEEN.sub("", text)
    text = "".join(map(_plain, _SPACE.sub(" ", text)))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE))


@lru_cache(maxsize=1)
def stable() -> list[tuple[int, int]]:
    """Ranges of characters that stay as they are, whatever stands beside them.

    That is the normalisation quick check: a character is stable if it is its own
    form (so its NFC quick check is Yes, and nothing of it is replaced), starts a
    segment (combining class 0) and never is the second of a composition (quick
    check Maybe).  Vowel marks are stable one by one, their combining classes
    being in order then.
    """
    second = {unicodedata.decomposition(chr(c)).split()[1] for c in range(0x3400) if " " in unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))}
    follows = {int(x, 16) for x in second} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))

    def fixed(c: int) -> bool:
        ch = chr(c)
        if MARKS[0] <= c <= MARKS[1]:
            return True
        if ch in (JOINER, KEHEH, FARSI_YEH) or unicodedata.combining(ch) or c in follows or unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            return False
        return segment(ch) == ch and unicodedata.is_normalized("NFC", ch)

    runs: list[list[int]] = []
    for a, b in BLOCKS:
        for c in range(a, b + 1):
            if fixed(c):
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
    return [(a, b) for a, b in runs if b - a + 1 >= LEAST_RUN or any(x <= a and b <= y for x, y in MAIN_BLOCKS)]


@lru_cache(maxsize=1)
def quick_check() -> str:
    """What makes a text unstable, as a regular expression of the JVM."""
    return f"[^{_class(stable(), JVM)}]|[{_class([MARKS], JVM)}]{{2}}"


@lru_cache(maxsize=1)
def segments() -> re.Pattern:
    """Unstable characters with their context: the character before and after, and the vowel marks between."""
    return re.compile(f"(?s:.)?{_MARK}*(?:(?:[^{_class(stable(), PY)}]|{_MARK}{{2}})+{_MARK}*(?s:.)?{_MARK}*)+")


def _arabic(text: str) -> str:
    """Keheh and Farsi yeh by what follows in the word, marks passed over."""
    out = list(text)
    for i, ch in enumerate(text):
        if ch in (KEHEH, FARSI_YEH):
            j = i + 1
            while j < len(text) and unicodedata.category(text[j]) == "Mn":
                j += 1
            inside = j < len(text) and "\u0620" <= text[j] <= "\u06d3" and text[j] != "\u0621" and unicodedata.category(text[j])[0] == "L"
            if ch == KEHEH:
                out[i] = KAF if inside else KEHEH
            else:
                out[i] = YEH if inside else DOTLESS
    return unicodedata.normalize("NFC", "".join(out))


def visual(text: str) -> str:
    """The form of a whole text: unstable segments normalised, the rest spliced in."""
    done = segments().sub(lambda m: segment(m[0]), text)
    return _arabic(done) if KEHEH in done or FARSI_YEH in done else done


@F.pandas_udf(T.StringType())
def _visual(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(visual, na_action="ignore")


def formed(df: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """``df`` with the visual form of ``text``; only unstable texts reach Python."""
    ship(df.sparkSession)
    unstable = F.col(text).rlike(quick_check())
    marked = df.withColumn("_closer", F.when(unstable, F.col(text)))
    return marked.withColumn(form, F.coalesce(_visual("_closer"), F.col(text))).drop("_closer")


def alike(df: DataFrame, text: str = "text") -> DataFrame:
    """(id_a, id_b) of records whose strings differ but whose forms are equal.

    Forms with a single string (plain copies, however many) leave before the
    join.  Strings are paired, not records: each pair of strings is then written
    out for the records that hold them, so copies of one string never meet.
    """
    held = df.where(F.col("record_id").isNotNull() & F.col(text).rlike(r"[\p{L}\p{N}]")).select("record_id", F.col(text).alias("text"))
    rows = cut(formed(held).select("record_id", *key128(F.col("form")), F.xxhash64("text").alias("raw")))
    varied = rows.groupBy("k1", "k2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("k1", "k2")
    kept = rows.join(varied, ["k1", "k2"], "left_semi")
    strings = kept.select("k1", "k2", "raw").distinct()
    first, second = strings.withColumnRenamed("raw", "raw_x"), strings.withColumnRenamed("raw", "raw_y")
    pairs = first.join(second, ["k1", "k2"]).where("raw_x < raw_y")
    x = kept.select("k1", "k2", F.col("raw").alias("raw_x"), F.col("record_id").alias("x"))
    y = kept.select("k1", "k2", F.col("raw").alias("raw_y"), F.col("record_id").alias("y"))
    found = pairs.join(x, ["k1", "k2", "raw_x"]).join(y, ["k1", "k2", "raw_y"])
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
