"""Problem 9: text statistics of every document, and which aren't natural prose.

Ten statistics are computed inside the JVM in one pass.  Natural prose is
described by their mean and covariance, for each language and class of length
(a share over few words scatters more).  Both are estimated robustly from all
documents: the first round takes documents with enough common words, later
rounds those within the distance bound of the model before.  A round is one
aggregate of sums and products; what comes back to the driver is one row for
each language and length class (at most 8 x 5).  Cells with few documents borrow
the sums of their length class, then of all.

The squared Mahalanobis distance splits into one term for each statistic; these
are reported, and a document beyond the bound isn't prose.

Defined cases: null, empty and blank texts have no statistics and are never
reported; a null, unknown or wrong lang is judged by the cell "und" or the one it
names; common words of all listed languages count, as lang may be wrong; texts
of any length are read whole; an empty table gives no row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import fixed_rows
from corpusloom.plans.lineage import cut

STATISTICS = [
    "common_share", "word_length", "symbol_share", "digit_share", "barren_share",
    "punctuated_lines", "listed_share", "line_words", "distinct_share", "tag_share",
]
#: Least standard deviation of each statistic (keeps cells of equal values sane).
FLOOR = [0.05, 0.12, 0.04, 0.05, 0.10, 0.15, 0.05, 0.25, 0.08, 0.08]
#: Squared distance that prose stays within: 98 % of chi-squared with 10 degrees.
BOUND = 21.16
#: Common words that the documents of the first round have at least.
FIRST_SHARE = 0.25
ROUNDS = 3
#: First word counts of the second and later length classes.
CLASSES = [8, 16, 32, 64]
#: Documents that a cell needs for a model of its own.
ENOUGH = 20
#: Words that a line needs for the lack of common words to count fully.
TELLING_WORDS = 20

WORD = r"[\p{L}\p{M}\p{N}]+"
LINE_END = r"\r\n|[\n\r\u0085\x{2028}\x{2029}]"
MARKED = r"^\p{IsWhite_Space}*(?:(?:[-–—*+•·»>›|]+|::|\p{L}?\p{N}{1,3}[-.):]+|\p{N}+\))\p{IsWhite_Space}|[|»›>]|\p{L}?\p{N}{1,3}-)"
ENDED = r"[.!?؟…:؛][\"”»)\p{IsWhite_Space}\p{So}]*$"
SYMBOL = r"[^\p{L}\p{M}\p{N}\p{IsWhite_Space}.,!?؟،؛:'\"()\x{200c}\x{200d}-]"
TAG = r"[#@][\p{L}\p{N}_]+|https?://\P{IsWhite_Space}+|(?<![\p{L}\p{N}_])(?:URL|USER|NUM|RT)(?![\p{L}\p{N}_])"


def _total(lines: str, value) -> Column:
    return F.aggregate(lines, F.lit(0.0), lambda s, x: s + value(x))


def statistics(df: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, cell, n_words and the ten statistics of every text that isn't blank.

    ``common_words`` is a fixed table of a few hundred rows.
    """
    listed = fixed_rows(common_words, ["lang", "word"], 100_000)
    words = sorted({r.word.lower() for r in listed if r.word})
    langs = sorted({r.lang for r in listed if r.lang})
    is_common = (lambda w: w.isin(words)) if words else (lambda w: F.lit(False))

    def line(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
        return F.struct(
            F.length(F.regexp_replace(text, r"\p{IsWhite_Space}+", "")).cast("double").alias("ink"), found.alias("w"),
            text.rlike(ENDED).alias("ended"), text.rlike(MARKED).alias("marked"),
        )

    rows = df.where(F.col("text").rlike(r"\P{IsWhite_Space}")).select(
        "doc_id", F.when(F.col("lang").isin(langs), F.col("lang")).otherwise("und").alias("cell"),
        F.transform(F.filter(F.split("text", LINE_END, -1), lambda t: t.rlike(r"\P{IsWhite_Space}")), line).alias("l"),
        F.regexp_count("text", F.lit(SYMBOL)).alias("symbols"), F.regexp_count("text", F.lit(r"\p{N}")).alias("digits"), F.regexp_count("text", F.lit(TAG)).alias("tags"),
    )
    counted = rows.select(
        "doc_id", "cell", "symbols", "digits", "tags",
        F.transform("l", lambda x: F.struct(x.ink.alias("ink"), F.size(x.w).alias("n"), F.size(F.filter(x.w, is_common)).alias("c"), x.ended.alias("ended"), x.marked.alias("marked"))).alias("l"),
        F.size(F.array_distinct(F.flatten("l.w"))).alias("n_distinct"),
    )
    n_lines = F.size("l")
    weight = lambda x: F.when(n_lines >= 3, 1.0).otherwise(F.pow(F.least(F.lit(1.0), x.n / TELLING_WORDS), F.lit(2.0)))
    sums = counted.select(
        "doc_id", "cell", "symbols", "digits", "tags", "n_distinct", n_lines.alias("n_lines"),
        _total("l", lambda x: x.ink).alias("ink"),
        _total("l", lambda x: x.n.cast("double")).alias("n_words"),
        _total("l", lambda x: x.c.cast("double")).alias("n_common"),
        _total("l", lambda x: F.when(x.c == 0, x.ink * weight(x)).otherwise(0.0)).alias("barren"),
        _total("l", lambda x: F.when((x.c == 0) & x.marked, x.ink).otherwise(0.0)).alias("listed"),
        _total("l", lambda x: x.ended.cast("double")).alias("ended"),
    )
    n, ink, lines = F.greatest("n_words", F.lit(1.0)), F.greatest("ink", F.lit(1.0)), F.greatest("n_lines", F.lit(1))
    return sums.select(
        "doc_id", "cell", F.col("n_words").cast("long").alias("n_words"),
        reduce(add, [(F.col("n_words") >= c).cast("int") for c in CLASSES]).alias("length_class"),
        (F.col("n_common") / n).alias("common_share"),
        F.least(F.log((F.col("ink") + 1) / (F.col("n_words") + 1)), F.lit(4.0)).alias("word_length"),
        (F.col("symbols") / ink).alias("symbol_share"),
        (F.col("digits") / ink).alias("digit_share"),
        (F.col("barren") / ink).alias("barren_share"),
        (F.col("ended") / lines).alias("punctuated_lines"),
        (F.col("listed") / ink).alias("listed_share"),
        F.least(F.log1p(F.col("n_words") / lines), F.lit(3.0)).alias("line_words"),
        (F.col("n_distinct") / n).alias("distinct_share"),
        (F.col("tags") / n).alias("tag_share"),
    )


def _moments(core: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Count, sums and sums of products of each cell, as one vector."""
    m = len(STATISTICS)
    sums = [F.count(F.lit(1)).cast("double")] + [F.sum(s) for s in STATISTICS]
    sums += [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])) for i in range(m) for j in range(i, m)]
    rows = core.groupBy("cell", "length_class").agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).collect()
    return {(r.cell, r.length_class): np.array([r[f"s{i}"] for i in range(len(sums))]) for r in rows}


def _model(moments: dict[tuple[str, int], np.ndarray], cells: list[str]) -> list[tuple]:
    """Mean and inverse covariance of every cell and length class."""
    m = len(STATISTICS)
    zero = np.zeros(1 + m + m * (m + 1) // 2)
    out = []
    for k in range(len(CLASSES) + 1):
        of_class = sum((v for (_, c), v in moments.items() if c == k), zero)
        for cell in cells:
            s = moments.get((cell, k), zero)
            for more in (of_class, sum(moments.values(), zero)):
                s = s if s[0] >= ENOUGH else more
            n = max(s[0], 1.0)
            mean, product = s[1 : m + 1] / n, np.zeros((m, m))
            product[np.triu_indices(m)] = s[m + 1 :] / n
            product = np.triu(product) + np.triu(product, 1).T
            spread = product - np.outer(mean, mean) + np.diag(np.square(FLOOR))
            inverse = np.linalg.inv(spread)
            out.append((cell, k, *map(float, mean), *map(float, inverse[np.triu_indices(m)])))
    return out


def _measured(stats: DataFrame, model: list[tuple]) -> DataFrame:
    """``stats`` with the term of each statistic (t_...) and their sum, the distance."""
    m = len(STATISTICS)
    names = ["cell", "length_class", *[f"m{i}" for i in range(m)], *[f"p{i}_{j}" for i in range(m) for j in range(i, m)]]
    kinds = ", ".join(f"{n} {'string' if n == 'cell' else 'int' if n == 'length_class' else 'double'}" for n in names)
    table = stats.sparkSession.createDataFrame(model, kinds)
    rows = stats.join(F.broadcast(table), ["cell", "length_class"])
    rows = rows.select(*stats.columns, *names[2 + m :], *[(F.col(s) - F.col(f"m{i}")).alias(f"d{i}") for i, s in enumerate(STATISTICS)])
    terms = [F.col(f"d{i}") * reduce(add, [F.col(f"p{min(i, j)}_{max(i, j)}") * F.col(f"d{j}") for j in range(m)]) for i in range(m)]
    rows = rows.select(*stats.columns, *[t.alias(f"t_{s}") for t, s in zip(terms, STATISTICS, strict=True)])
    return rows.withColumn("distance", reduce(add, [F.col(f"t_{s}") for s in STATISTICS]))


def measured(df: DataFrame, common_words: DataFrame) -> DataFrame:
    """Statistics, terms and squared distance of every text that isn't blank."""
    stats = cut(statistics(df, common_words))
    cells = sorted({r.lang for r in fixed_rows(common_words, ["lang"]) if r.lang} | {"und"})
    core = stats.where(F.col("common_share") >= FIRST_SHARE)
    for _ in range(ROUNDS):
        out = _measured(stats, _model(_moments(core), cells))
        core = out.where(F.col("distance") < BOUND)
    return out


def not_prose(df: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id of documents beyond the bound."""
    return measured(df, common_words).where(F.col("distance") >= BOUND).select("doc_id")
