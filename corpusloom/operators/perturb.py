"""Seeded text perturbations for robustness tests (reconstructions).

Only reports of the perturbed runs are public, so the rules here are our own:
every choice comes from the hash of a key and a seed, so a run repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import squeeze_ws

VOWELS = ["ا", "و", "ي"]


def choice(key: Column, seed: str, n: int) -> Column:
    """A number from 0 to n - 1 from the SHA-1 of seed and key."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") % n


def typo_noise(text: Column, key: Column, edits: int = 3) -> Column:
    """``edits`` characters deleted or replaced, each at a seeded place in its part of the text."""
    def edit(state: Column, i: Column) -> Column:
        part = F.floor(F.length(state) / edits)
        draw = F.conv(F.substring(F.sha1(F.concat(F.lit("typo:"), i.cast("string"), F.lit(":"), key.cast("string"))), 1, 8), 16, 10).cast("long")
        at = (i * part + draw % F.greatest(part, F.lit(1)) + 1).cast("int")
        other = F.substr(state, (draw % F.greatest(F.length(state), F.lit(1)) + 1).cast("int"), F.lit(1))
        swapped = F.when(draw % 3 == 0, other).otherwise(F.lit(""))
        return F.when(part < 1, state).otherwise(F.concat(F.substr(state, F.lit(1), at - 1), swapped, F.substr(state, at + 1, F.length(state))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(edits - 1)), text, edit)


def elongation(text: Column, key: Column) -> Column:
    """The first long vowel repeated two to four times; no vowel, no change."""
    times = (choice(key, "elongation", 3) + 2).cast("int")
    at = F.length(F.regexp_extract(text, f"^[^{''.join(VOWELS)}]*", 0)) + 1
    vowel = F.substr(text, at, F.lit(1))
    return F.when(at <= F.length(text), F.concat(F.substr(text, F.lit(1), at - 1), F.repeat(vowel, times), F.substr(text, at + 1, F.length(text)))).otherwise(text)


def placeholder_noise(text: Column, key: Column) -> Column:
    """Perhaps a leading USER, perhaps a trailing URL."""
    user, url = choice(key, "user", 2) == 1, choice(key, "url", 2) == 1
    return F.concat(F.when(user, "USER ").otherwise(""), text, F.when(url, " URL").otherwise(""))


def punctuation_spacing(text: Column, key: Column) -> Column:
    """The first space widened by one to three spaces, perhaps a suffix of marks."""
    wide = F.repeat(F.lit(" "), (choice(key, "space", 3) + 2).cast("int"))
    at = F.instr(text, " ")
    spaced = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), wide, F.substr(text, at + 1, F.length(text)))).otherwise(text)
    mark = choice(key, "mark", 3)
    return F.concat(spaced, F.when(mark == 0, "!!").when(mark == 1, "...").otherwise(""))


FAMILIES = {"typo_noise": typo_noise, "elongation": elongation, "placeholder_noise": placeholder_noise, "punctuation_spacing": punctuation_spacing}


def too_aggressive(text: Column, perturbed: Column) -> Column:
    """Whether the perturbed text shares less than half of its length with the text."""
    return F.levenshtein(squeeze_ws(text), squeeze_ws(perturbed)) * 2 > F.greatest(F.length(text), F.lit(1))
