"""Text columns: cleaning, tokens, fingerprints and small derived values.

The regular expressions spell out Unicode classes, because the JVM's own word
and space classes are ASCII by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as Unicode text tools see them.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
# Patterns of the cleaning steps.
EMAIL = EDGE + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + EDGE
URL = rf"(?i)(?:https?://|www\.|pic\.twitter\.com/)[^{WS}]*"
URL_TOKEN = rf"(?<!{W})URL(?!{W})"
MENTION = rf"@{W}+"
USER_TOKEN = r"(?<![\p{L}\p{N}_<])USER(?![\p{L}\p{N}_>])"
VOWELS = r"[\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}]"
ELONGATED = r"([A-Za-z\x{621}-\x{64a}])\1{2,}"
#: Stands for an e-mail address while the other steps run.
HELD = chr(0xE000)


def strip_ws(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def squeeze_ws(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def hold_emails(text: Column) -> Column:
    """E-mail addresses replaced by the placeholder."""
    return F.regexp_replace(text, EMAIL, f" {HELD} ")


def drop_urls(text: Column) -> Column:
    """URLs and the literal token URL as a space."""
    return F.regexp_replace(F.regexp_replace(text, URL, " "), URL_TOKEN, " ")


def mask_mentions(text: Column) -> Column:
    """Mentions and the literal token USER as <USER>."""
    return F.regexp_replace(F.regexp_replace(text, MENTION, " <USER> "), USER_TOKEN, " <USER> ")


def drop_hash_signs(text: Column) -> Column:
    """Hash signs removed, the tag's words kept."""
    return F.replace(text, F.lit("#"), F.lit(""))


def fold_arabic(text: Column) -> Column:
    """Vowel marks and tatweel removed, alef forms and word-final alef maksura unified."""
    bare = F.regexp_replace(text, VOWELS, "")
    alef = F.translate(bare, "آأإٱ", "اااا")
    return F.regexp_replace(F.regexp_replace(alef, f"ى(?!{W})", "ي"), "ـ+", "")


def shorten_runs(text: Column) -> Column:
    """Letters repeated three times or more, twice."""
    return F.regexp_replace(text, ELONGATED, "$1$1")


def clean(text: Column) -> Column:
    """The whole cleaning chain; null gives ''.

    A text that already has the placeholder U+E000 loses it.
    """
    raw = F.replace(F.coalesce(text, F.lit("")), F.lit(HELD), F.lit(""))
    emails = F.regexp_extract_all(raw, F.lit(EMAIL), F.lit(0))
    body = squeeze_ws(shorten_runs(fold_arabic(drop_hash_signs(mask_mentions(drop_urls(hold_emails(raw)))))))
    back = F.zip_with(F.split(body, HELD, -1), emails, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.array_join(back, "")


def tokens(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, f"[{WS}]+", -1), lambda t: t != "")


def token_count(text: Column) -> Column:
    """Number of tokens."""
    return F.size(tokens(text))


def token_set(text: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(tokens(text))


def fingerprint(text: Column) -> Column:
    """SHA-1 of the text."""
    return F.sha1(text)


def row_fingerprint(*columns: Column) -> Column:
    """SHA-1 of all values joined by tabs, null as ''."""
    return F.sha1(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def percentage(part: Column, whole: Column) -> Column:
    """Percent with two decimals, 0 where whole is 0."""
    return F.round(ratio(part, whole) * 100, 2)


def jaccard(a: Column, b: Column) -> Column:
    """Words in common over words in either; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return ratio(common, F.size(a) + F.size(b) - common)


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the Jaccard similarity of two sets from their sizes."""
    return ratio(F.least(a, b), F.greatest(a, b))


def truncated(text: Column, limit: int = 160) -> Column:
    """White space squeezed; longer texts cut and marked by an ellipsis."""
    one = squeeze_ws(text)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, limit - 1), F.lit("…")))


def without_fences(text: Column) -> Column:
    """A model's answer without code fences and their language tag."""
    bare = F.regexp_replace(strip_ws(text), r"^`+|`+$", "")
    fenced = strip_ws(F.regexp_replace(bare, r"^json", ""))
    return F.when(strip_ws(text).startswith("```"), fenced).otherwise(strip_ws(text))


def support_score(text: Column) -> Column:
    """How well a text serves as a few-shot example."""
    n = token_count(text)
    arabic = F.regexp_count(text, F.lit(r"[\x{600}-\x{6ff}]"))
    points = lambda test, p: F.when(test, p).otherwise(0)
    return (
        points((n >= 3) & (n <= 8), 8) - F.abs(n - 5)
        + points(~text.contains("<USER>"), 4) + points(~text.contains("NUM"), 3)
        + points(~text.rlike("[A-Za-z]"), 3) + points(~text.rlike(r"[_:/\\]"), 2)
        + points(arabic >= F.greatest(F.lit(8), F.floor(F.length(text) / 2)), 2)
    )


def latin_count(text: Column) -> Column:
    """Number of Latin letters."""
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def basename(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a request; null if a price is unknown."""
    return prompt / 1e6 * price_in + completion / 1e6 * price_out


def warmup_steps(total: Column, share: Column) -> Column:
    """Whole warm-up steps of a schedule."""
    return F.floor(total * share).cast("long")


def steps_per_epoch(batches: Column, accumulated: Column) -> Column:
    """Optimizer steps of an epoch."""
    return F.ceil(batches / accumulated).cast("long")
