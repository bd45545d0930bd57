"""Problem 7: token ids of a byte-level BPE vocabulary, by backtracking.

The bytes of a piece are mapped to Latin-1, so that a pyahocorasick automaton
over the vocabulary finds the longest token at every position in one pass.  The
encoder walks through the piece taking the longest token; two tokens may stand
side by side only if merging their joint bytes gives just these two (memoised by
pair).  A token that doesn't fit gives way to the next shorter token at the same
place; when none is left, the position is dead and the token before it is taken
back.  A sequence in which all neighbours fit is the one that the merge rules
give, and each position dies once, so the work is linear in the piece.

Pieces (words, as the vocabulary's own pattern cuts them) recur, so their ids
are kept in a bounded dictionary in each worker.

Defined cases: null and empty texts give an empty list; strings of special
tokens are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.shipping import ship

#: Folder of the vocabulary files; every function takes another one.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that cuts text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a worker remembers: pieces up to a length, and pairs of tokens.
KEPT_PIECES, KEPT_LENGTH, KEPT_PAIRS = 1 << 17, 64, 1 << 20


class Encoder:
    """Encoder of one vocabulary, given as the bytes of its rank file."""

    def __init__(self, ranks_file: bytes) -> None:
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks_file.splitlines())}
        self.token = {r: t for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (r, len(token)))
        self.automaton.make_automaton()
        self.cut = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids by the merge rules themselves: lowest rank first (for short data)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens can be neighbours."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            data = self.token[token]
            self.shorter[token] = next((self.rank[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.rank), None)
        return self.shorter[token]

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        if data in self.rank:
            return (self.rank[data],)
        longest = [0] * len(data)
        for end, (r, n) in self.automaton.iter(data.decode("latin-1")):
            longest[end - n + 1] = r
        size = {}
        dead: set[int] = set()
        path: list[int] = []
        at, token = 0, longest[0]
        while at < len(data):
            while token is not None:
                size[token] = len(self.token[token])
                if at + size[token] not in dead and (not path or self.fits(path[-1], token)):
                    break
                token = self.next_shorter(token)
            if token is None:
                dead.add(at)
                back = path.pop()
                at -= size[back]
                token = self.next_shorter(back)
            else:
                path.append(token)
                at += size[token]
                token = longest[at] if at < len(data) else None
        return tuple(path)

    def extend(self, out: array, text: str) -> None:
        """Append the ids of ``text`` to ``out``."""
        pieces = self.pieces
        for p in self.cut(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= KEPT_LENGTH:
                    if len(pieces) >= KEPT_PIECES:
                        pieces.clear()
                    pieces[p] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        out = array("i")
        self.extend(out, text or "")
        return out.tolist()


@lru_cache(maxsize=2)
def encoder(ranks_file: bytes) -> Encoder:
    """The encoder of this worker."""
    return Encoder(ranks_file)


def load(folder: str = TOKENIZERS) -> bytes:
    """The rank file, read on the driver (under 1 MB, the same at every scale)."""
    return Path(folder, VOCABULARY).read_bytes()


def encoded(df: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids of every row of ``df``."""
    ship(df.sparkSession)
    file = load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for batch in batches:
            out, ends = array("i"), [0]
            for text in batch.column("text").to_pylist():
                if text:
                    own.extend(out, text)
                ends.append(len(out))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(out, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def counted(df: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source and n_tokens of every row of ``df``."""
    ship(df.sparkSession)
    file = load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for batch in batches:
            sizes = []
            for text in batch.column("text").to_pylist():
                out = array("i")
                if text:
                    own.extend(out, text)
                sizes.append(len(out))
            columns = [batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n_tokens"])

    return df.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long")
