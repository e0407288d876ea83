"""Benchmark decontamination by the q-gram lemma.

Texts and items are lower-cased and their white space made single spaces. An item is looked for whole; one longer than
``PIECE`` characters in pieces of that many, each half over the one before, so that a document with a good part of it is
found too. A piece of m characters that occurs with k = floor(m * ``RATE``) edits or fewer has at least m - q + 1 - k * q of its
q-grams there (q is 8, or less where an item's length needs it for a bound of 1 or more), all within k + 1 neighbouring diagonals. So shared q-grams are counted in bands of 2 (k + 1)
diagonals, each half over the one before; bands that reach the bound are verified by edit distance within
the band.

Items shorter than ``SHORTEST`` characters, null ones too, are never looked for: they would be found anywhere. Items
without an id are looked for as any other and share the null id in results. Null and empty texts hold nothing. A document and an item make one row at most, the occurrence with the fewest edits for its
length, then the first. Repeated documents are repeated rows; repeated items are looked for once under their least id.

The items go to every task in lots of at most ``LOT`` characters. There is one pass over the documents for each lot, so
a benchmark of any size is worked off in bounded memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import Index, bounded, nonempty, texts

Q, RATE, PIECE, SHORTEST = 8, 0.1, 100, 25
LOT = 4_000_000
NO_ID = -(1 << 63)
BLOCK = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)

RESULT = "doc_id long, item_id long, edits int, length int, similarity double, position long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = max(0, len(codes) - q + 1)
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(q):
        keys *= MIX
        keys += codes[i : i + n]
    return keys ^ (keys >> np.uint64(31))


class Pieces:
    """The pieces of a lot of items, and where each q-gram of them is."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, piece: int = PIECE):
        self.items, self.codes = [], []
        for item, text in items:
            codes = letters(text)
            starts = {*range(0, max(1, len(codes) - piece + 1), piece // 2), max(0, len(codes) - piece)}
            for start in sorted(starts):
                self.items.append(item)
                self.codes.append(codes[start : start + piece])
        self.items = np.array(self.items, dtype=np.int64)
        self.m = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.k = np.floor(self.m * rate).astype(np.int64)
        # The longest q-grams up to Q for which every piece's bound is 1 at least, so that none is missed.
        self.q = int(min(Q, (self.m // (self.k + 1)).min(initial=Q)))
        self.bound = self.m - self.q + 1 - self.k * self.q
        keys = [qgrams(c, self.q) for c in self.codes]
        of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        at = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.lexsort((at, of, keys))
        self.of, self.at = of[order], at[order]
        distinct, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.index = Index(distinct)
        self.maybe = np.zeros(1 << 20, dtype=bool)  # most q-grams of a text are settled here
        self.maybe[distinct >> np.uint64(44)] = True
        width = int(self.m.max(initial=1))
        self.padded = np.zeros((len(self.codes), width), dtype=np.uint32)
        for row, codes in zip(self.padded, self.codes, strict=True):
            row[: len(codes)] = codes

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and first diagonals of the bands that reach their bound in a text."""
        keys = qgrams(codes, self.q)
        places = np.flatnonzero(self.maybe[keys >> np.uint64(44)])
        found = self.index.find(keys[places])
        places, found = places[found >= 0], found[found >= 0]
        # Stretches with fewer hits than the least bound asks for can't hold any piece.
        reach, least = int((self.m + 2 * self.k + 2).max(initial=1)), int(self.bound.min(initial=1))
        if len(places) < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.searchsorted(places, places + reach) - np.searchsorted(places, places - reach)
        places, found = places[near >= least], found[near >= least]
        counts = self.count[found]
        total = int(counts.sum())
        hit = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if total else found, counts)
        hit = hit + np.arange(total)
        piece = self.of[hit]
        diagonal = np.repeat(places, counts) - self.at[hit] + int(self.m.max(initial=0))  # never negative
        step = self.k[piece] + 1
        band = diagonal // step
        span = len(codes) + int(self.m.max(initial=0)) + 2
        own = piece * span + band
        # Each hit lies in the band that begins in its stride and in the one that began a stride before.
        keys, tally = np.unique(np.concatenate([own, own - 1]), return_counts=True)
        piece, band = (keys + 1) // span, (keys + 1) % span - 1
        enough = tally >= self.bound[piece]
        piece, band = piece[enough], band[enough]
        return piece, band * (self.k[piece] + 1) - int(self.m.max(initial=0))

    def verify(self, codes: np.ndarray, piece: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fewest edits that turn each piece into a stretch of the text in its band, and where that ends.

        One row of the banded table per letter, all candidates side by side. Column x of row i is text place
        i + first - k + x.
        """
        k, m = self.k[piece], self.m[piece]
        most = int(k.max())
        width = 2 * (most + 1) + 2 * most + 1
        low = first - most
        beyond = 1 << 12
        cols = np.arange(width, dtype=np.int16)
        # The text under all cells of a candidate, -1 outside; cell (i, x) is at i + x.
        place = low[:, None] + np.arange(int(m.max()) + width)
        inside = (place >= 0) & (place < len(codes))
        under = np.where(inside, codes.astype(np.int32)[np.where(inside, place, 0)] if len(codes) else -1, -1)
        open_end = np.where((place >= 0) & (place <= len(codes)), 0, beyond).astype(np.int16)
        letters_of = self.padded[piece].astype(np.int32)
        table = open_end[:, :width].copy()
        for i in range(int(m.max())):
            letter = under[:, i : i + width]
            row = table + (letter != letters_of[:, i, None])
            row[letter < 0] = beyond
            row[:, :-1] = np.minimum(row[:, :-1], table[:, 1:] + np.int16(1))
            row -= cols
            np.minimum.accumulate(row, axis=1, out=row)  # letters of the text that the piece lacks
            row += cols
            np.maximum(row, open_end[:, i + 1 : i + 1 + width], out=row)
            table = np.where((i < m)[:, None], row, table)
        best = table.argmin(axis=1)
        return table[np.arange(len(piece)), best], low + m + best

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, edits, length of the piece, end) of the pieces in a normal text."""
        overlap = 2 * int((self.m + 2 * self.k + 2).max(initial=1))
        for start in range(0, max(1, len(text)), BLOCK):
            codes = letters(text[start : start + BLOCK + overlap])
            piece, first = self.candidates(codes)
            for at in range(0, len(piece), 2048):
                p, f = piece[at : at + 2048], first[at : at + 2048]
                edits, end = self.verify(codes, p, f)
                for i in np.flatnonzero(edits <= self.k[p]):
                    yield int(self.items[p[i]]), int(edits[i]), int(self.m[p[i]]), start + int(end[i])

    def best(self, text: str) -> dict[int, tuple[float, int, int, int]]:
        """For each item that is there: share of edits, end, edits, length."""
        found: dict[int, tuple[float, int, int, int]] = {}
        for item, edits, length, end in self.search(text):
            now = (edits / length, end, edits, length)
            found[item] = min(found.get(item, now), now)
        return found


_PIECES: dict[str, Pieces] = {}


def _lots(items: DataFrame, shortest: int, lot: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, normalized, in lots of bounded size; the driver holds one lot at a time."""
    known = items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    known = known.groupBy("text").agg(F.min("item_id").alias("item_id"))
    now, size = [], 0
    for row in known.orderBy("item_id").toLocalIterator():
        text = normal(row["text"])
        if len(text) < shortest:
            continue
        if now and size + len(text) > lot:
            yield now
            now, size = [], 0
        now.append((NO_ID if row["item_id"] is None else row["item_id"], text))
        size += len(text)
    if now:
        yield now


def _sent(docs: DataFrame, items: list[tuple[int, str]], rate: float, piece: int):
    key = uuid.uuid4().hex
    sent = bounded(docs.sparkSession).sparkContext.broadcast((items, rate, piece))

    def pieces() -> Pieces:
        if key not in _PIECES:
            _PIECES.clear()
            _PIECES[key] = Pieces(*sent.value)
        return _PIECES[key]

    return pieces


def leaks(
    docs: DataFrame, items: DataFrame, rate: float = RATE, piece: int = PIECE, shortest: int = SHORTEST, lot: int = LOT
) -> DataFrame:
    """The columns of RESULT: a row for each document of ``docs`` (doc_id, text) and item of ``items`` (item_id, text) in it."""

    def one(pieces) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in nonempty(batches):
                rows = [
                    (doc, None if item == NO_ID else item, edits, length, 1.0 - share, end)
                    for doc, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True)
                    for item, (share, end, edits, length) in sorted(pieces().best(normal(text)).items())
                ]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)]
                    yield pa.record_batch(columns, [c.split()[0] for c in RESULT.split(", ")])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, RESULT)

    found = [one(_sent(docs, some, rate, piece)) for some in _lots(items, shortest, lot)]
    empty = docs.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, found, empty) if found else empty


def clean(
    docs: DataFrame, items: DataFrame, rate: float = RATE, piece: int = PIECE, shortest: int = SHORTEST, lot: int = LOT
) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no item."""
    for some in _lots(items, shortest, lot):
        pieces = _sent(docs, some, rate, piece)

        def free(batches: Iterator[pa.RecordBatch], pieces=pieces) -> Iterator[pa.RecordBatch]:
            for batch in nonempty(batches):
                mask = [next(pieces().search(normal(t)), None) is None for t in texts(batch["text"])]
                yield batch.filter(pa.array(mask, pa.bool_()))

        docs = docs.mapInArrow(free, docs.schema)
    return docs
