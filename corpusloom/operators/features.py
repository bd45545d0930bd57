"""TF-IDF as relational algebra, and a linear classifier on top of it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS, label_index
from corpusloom.functions.text import tokens
from corpusloom.operators import softmax
from corpusloom.plans.shipping import ship

WORD = r"[\p{L}\p{N}_]+"
#: Texts whose terms are numbered at once, and terms (or tokens) that a task keeps at most.
AT_ONCE, KEPT = 4096, 1_000_000


def word_ngrams(text: Column, low: int = 1, high: int = 2) -> Column:
    """Word n-grams of ``low`` to ``high`` words; single characters are words."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return _ngrams(words, low, high, " ")


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside each token padded by one space on both sides.

    A padded token shorter than n is emitted once for that n and not for longer ones.
    """
    def grams(token: Column) -> Column:
        padded = F.concat(F.lit(" "), token, F.lit(" "))
        def of(n: Column) -> Column:
            last = F.greatest(F.length(padded) - n, F.lit(0))
            full = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(padded, i + 1, n))
            return F.when((n == low) | (F.length(padded) >= n), full).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(F.array(*[F.lit(n) for n in range(low, high + 1)]), of))
    return F.flatten(F.transform(tokens(text), grams))


def _ngrams(items: Column, low: int, high: int, separator: str) -> Column:
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(items) - n + 1)
        return F.when(F.size(items) >= n, F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), separator))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def term_counts(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf) of every row."""
    return rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame, least: int) -> DataFrame:
    """(term, df) of terms that at least ``least`` rows hold."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def tfidf(counts: DataFrame, frequencies: DataFrame, n_rows: int, key: str) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length per row."""
    idf = F.log((F.lit(1.0) + n_rows) / (F.col("df") + 1)) + 1
    raw = counts.join(frequencies, "term").withColumn("raw", (F.log(F.col("tf").cast("double")) + 1) * idf)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))  # the terms of one row
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


class Grams:
    """Terms of many texts as numbers, in a Python worker; the n-grams are those of ``word_ngrams`` and ``char_ngrams``.

    With ``known`` (words, characters) the terms found there have their place, characters after words, and others are left
    out; without it terms are numbered as they come.
    """

    def __init__(self, word_range: tuple[int, int], char_range: tuple[int, int], known: tuple[list[str], list[str]] | None = None) -> None:
        self.word_range, self.char_range, self.fixed = word_range, char_range, known is not None
        words, chars = known or ([], [])
        self.numbers = {"w:": dict(zip(words, range(len(words)))), "c:": dict(zip(chars, range(len(words), len(words) + len(chars))))}  # noqa: B905
        self.size = len(words) + len(chars)
        self.tokens: dict[str, np.ndarray] = {}

    def number(self, space: str, terms: list[str]) -> list[int]:
        """Numbers of terms, -1 for those left out."""
        numbers = self.numbers[space]
        if self.fixed:
            return [numbers.get(t, -1) for t in terms]
        out = []
        for t in terms:
            if (at := numbers.get(t)) is None:
                at = numbers[t] = self.size
                self.size += 1
            out.append(at)
        return out

    def token(self, token: str) -> np.ndarray:
        """Numbers of the character n-grams of one token, repeated ones repeated."""
        found = self.tokens.get(token)
        if found is None:
            padded, (low, high) = f" {token} ", self.char_range
            grams = [padded[i : i + n] for n in range(low, high + 1) if n == low or len(padded) >= n for i in range(max(len(padded) - n, 0) + 1)]
            found = np.array([x for x in self.number("c:", grams) if x >= 0], np.int64)
            if len(self.tokens) >= KEPT // 4:
                self.tokens.clear()
            self.tokens[token] = found
        return found

    def entries(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of the columns words and tokens, by row and term."""
        row, code, items = _flat(batch.column("words"))
        rows, terms = [], []
        low, high = self.word_range
        grams, strings = code, items
        for n in range(1, high + 1):
            if n > 1:  # a word after each gram of n - 1 words, in the same row
                whole = row[n - 1 :] == row[: len(row) - n + 1]
                pairs, grams_of = np.unique(grams[: len(whole)] * max(1, len(items)) + code[n - 1 :], return_inverse=True)
                needed = np.zeros(len(pairs), bool)
                needed[grams_of[whole]] = True
                strings = [f"{strings[p // len(items)]} {items[p % len(items)]}" if k else "" for p, k in zip(pairs.tolist(), needed.tolist(), strict=True)]
                grams = grams_of
            else:
                whole, needed = np.ones(len(row), bool), np.ones(len(items), bool)
            if n >= low:
                at = np.full(len(strings), -1, np.int64)
                at[needed] = self.number("w:", [s for s, k in zip(strings, needed.tolist(), strict=True) if k])
                rows.append(row[: len(whole)][whole])
                terms.append(at[grams[: len(whole)][whole]])
        row, code, items = _flat(batch.column("tokens"))
        each = [self.token(t) for t in items]
        sizes = np.array([len(x) for x in each], np.int64)
        starts, many = np.cumsum(sizes) - sizes, sizes[code]
        places = np.arange(many.sum()) + np.repeat(starts[code] - (np.cumsum(many) - many), many)
        rows.append(np.repeat(row, many))
        terms.append(np.concatenate([np.zeros(0, np.int64), *each])[places])
        row, term = np.concatenate(rows), np.concatenate(terms)
        size = max(1, self.size)
        both, tf = np.unique((row * size + term)[term >= 0], return_counts=True)
        return both // size, both % size, tf


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, code) of every item of string lists, and the string of every code; a null list is empty."""
    coded = pc.list_flatten(lists).dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(i, AT_ONCE)


#: The last vocabulary of this worker, by its name.
_last: dict[str, Grams] = {}


class Vectorizer:
    """Two TF-IDF spaces side by side (words, characters), fitted on training rows.

    The vocabulary goes to every executor: it has as many terms as the model of it has features, and that is there too.
    Terms of one space that occur in the same training rows, equally often, have equal columns, and a squared penalty gives
    them equal coefficients.  So k of them are one column, each with its weight by the root of k: penalty and scores stay the same.
    """

    def __init__(
        self, word_min_df: int = 2, char_min_df: int = 2, word_range: tuple[int, int] = (1, 2), char_range: tuple[int, int] = (3, 5), lowercase: bool = False
    ) -> None:
        self.word_range, self.char_range, self.lowercase = word_range, char_range, lowercase
        self.least = {"w:": word_min_df, "c:": char_min_df}
        self.n_rows = self.size = 0
        self.sent: Any = None

    def split(self, rows: DataFrame, text: str, *others: str | Column) -> DataFrame:
        """Other columns, and words and tokens of the text."""
        t = F.lower(text) if self.lowercase else F.col(text)
        return rows.select(*others, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"), tokens(t).alias("tokens"))

    def fit(self, rows: DataFrame, text: str, n: str) -> Vectorizer:
        """Learn the terms of ``rows``, each of which stands for ``n`` equal ones."""
        spark = rows.sparkSession
        ship(spark)
        word_range, char_range = self.word_range, self.char_range

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, sums = Grams(word_range, char_range), np.zeros((0, 3), np.int64)

            def found() -> Iterator[pa.RecordBatch]:
                for space, numbers in grams.numbers.items():
                    terms, at = list(numbers), np.fromiter(numbers.values(), np.int64, len(numbers))
                    for i in range(0, len(terms), 50_000):
                        part = terms[i : i + 50_000]
                        arrays = [pa.array(np.ascontiguousarray(c)) for c in sums[at[i : i + 50_000]].T]
                        yield pa.RecordBatch.from_arrays([pa.array([space] * len(part)), pa.array(part, pa.string()), *arrays], names=["space", "term", "df", "a", "b"])

            for batch in _slices(batches):
                row, term, tf = grams.entries(batch)
                sums = np.concatenate([sums, np.zeros((grams.size - len(sums), 3), np.int64)])
                order = np.argsort(term, kind="stable")
                row, term, tf = row[order], term[order], tf[order]
                starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
                if len(starts):
                    sums[term[starts], 0] += np.add.reduceat(batch.column("n").to_numpy()[row], starts)
                    for i, c in enumerate("ab", 1):
                        sums[term[starts], i] ^= np.bitwise_xor.reduceat(_mixed(batch.column(c).to_numpy()[row], tf), starts)
                if grams.size > KEPT:
                    yield from found()
                    grams, sums = Grams(word_range, char_range), np.zeros((0, 3), np.int64)
            yield from found()

        marks = [F.xxhash64(F.lit(x), F.monotonically_increasing_id()).alias(x) for x in "ab"]
        counts = self.split(rows, text, F.col(n).alias("n"), *marks).mapInArrow(run, "space string, term string, df long, a long, b long")
        counts = counts.groupBy("space", "term").agg(F.sum("df").alias("df"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        counts = counts.where(F.when(F.col("space") == "w:", F.col("df") >= self.least["w:"]).otherwise(F.col("df") >= self.least["c:"]))
        table = counts.toArrow().sort_by([("space", "descending"), ("term", "ascending")])  # words first
        self.n_rows = rows.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
        n_words = pc.sum(pc.equal(table["space"], "w:")).as_py() or 0
        df = table["df"].to_numpy()
        keys = [np.arange(len(df)) < n_words, df, table["a"].to_numpy(), table["b"].to_numpy()]
        order = np.lexsort(keys)
        new = np.any([np.append(True, k[order][1:] != k[order][:-1])[: len(df)] for k in keys], axis=0)
        columns = np.empty(len(df), np.int32)
        columns[order] = np.cumsum(new) - 1
        many = np.bincount(columns)
        self.size = len(many)
        idf = np.log((1.0 + self.n_rows) / (df + 1)) + 1
        self.sent = spark.sparkContext.broadcast((uuid4().hex, table["term"].combine_chunks(), idf, columns, 1 / np.sqrt(many), n_words, word_range, char_range))
        return self

    def blocks(self, rows: DataFrame, text: str, label: Column, n: str) -> DataFrame:
        """The vectors of ``rows`` as blocks for ``softmax.fit``."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                yield softmax.block(*_vectors(sent, batch), batch.column("label").to_numpy(), batch.column("n").to_numpy())

        return self.split(rows, text, label.alias("label"), F.col(n).cast("double").alias("n")).mapInArrow(run, softmax.BLOCK_SCHEMA)

    def predict(self, rows: DataFrame, key: str, text: str, target: str, coefficients: np.ndarray) -> DataFrame:
        """(key, predicted_label, true_label) of every row, rows without known terms included."""
        sent, model = self.sent, rows.sparkSession.sparkContext.broadcast(coefficients)
        labels = np.array(LABELS, object)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                best = softmax.logits(*_vectors(sent, batch), model.value).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(labels[best], pa.string()), batch.column("label")], names=[key, "predicted_label", "true_label"])

        split = self.split(rows, text, F.col(key).alias("key"), F.col(target).alias("label"))
        return split.mapInArrow(run, f"`{key}` {split.schema['key'].dataType.simpleString()}, predicted_label string, true_label string")


def _vectors(sent: Any, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of every row, their columns and weights: (1 + ln tf) * idf, of unit length per row and space."""
    name, terms, idf, columns, scale, n_words, word_range, char_range = sent.value
    if name not in _last:
        _last.clear()
        _last[name] = Grams(word_range, char_range, (terms[:n_words].to_pylist(), terms[n_words:].to_pylist()))
    row, term, tf = _last[name].entries(batch)
    weight = (np.log(tf) + 1) * idf[term]
    space = row * 2 + (term >= n_words)
    weight /= np.sqrt(np.bincount(space, weight * weight, 2 * batch.num_rows))[space]
    column = columns[term]
    size = max(1, len(scale))
    both, at = np.unique(row * size + column, return_inverse=True)
    row, column = both // size, both % size
    return np.bincount(row, minlength=batch.num_rows), column, np.bincount(at, weight, len(both)) * scale[column]


def _mixed(marks: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Marks of rows, spread anew for every tf."""
    x = marks.astype(np.uint64) + tf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Texts that Python works on in at least one partition for each core, whatever the files are."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def fit_predict(
    train: DataFrame, dev: DataFrame, key: str, text: str, target: str, c: float = 4.0, max_iter: int = 2000, vectorizer: Vectorizer | None = None
) -> DataFrame:
    """(key, predicted_label, true_label) of ``dev`` by a model of ``train``: multinomial logistic regression with the penalty 1 / (c * n).

    Equal texts of one label are one training row with their number; a label that is none of the targets is an error.
    """
    label = F.coalesce(label_index(F.col(target)), F.raise_error(F.lit("a training row has no target label")).cast("int"))
    rows = spread(train.select(F.col(text).alias("text"), label.alias("label")), "text", "label").groupBy("text", "label").agg(F.count(F.lit(1)).alias("n")).cache()
    vectors = (vectorizer or Vectorizer()).fit(rows, "text", "n")
    blocks = vectors.blocks(rows, "text", F.col("label"), "n").cache()
    coefficients = softmax.fit(blocks, vectors.size, len(LABELS), 1.0 / (c * vectors.n_rows), max_iter)
    blocks.unpersist()
    rows.unpersist()
    return vectors.predict(dev, key, text, target, coefficients)
