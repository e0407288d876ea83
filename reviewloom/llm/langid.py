"""Language identification by partial matching of bytes (PPM), with frozen statistics.

For each language a tree of byte contexts of up to four bytes counts what followed. A byte's probability is
n / (T + D) in the longest context that was seen (T followers, D different ones); if the byte never followed
there, the escape D / (T + D) is paid and the context shortened by a byte; below the empty context every
byte has 1 / 256. Nothing is updated while scoring, so code lengths are exact sums over table entries. The
language with the shortest code wins, ties go to the first name; the score is its share of the probability.

Learning takes at most ``max_docs`` documents of each language and ``max_bytes`` bytes of them together, those
first by a hash of their id; the first is taken whole whatever its size, so that a language of long documents
alone is learned too. Rows of one id count as one document. Rows without text or language aren't learned from.
A null text, and one without a letter, is ``und`` with score 0. Repeated rows score alike; extra columns aren't
read. If nothing was learned, every text is ``und``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reviewloom.llm.common import Index, bounded, draw_order, nonempty, remainder, utf8

ORDER = 4
MAX_DOCS, MAX_BYTES = 300, 4 << 20
BLOCK = 1 << 19


def grams(raw: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes that end at each position from width - 1 on, as one number."""
    n = len(raw) - width + 1
    keys = np.zeros(max(0, n), dtype=np.uint64)
    for i in range(width):
        keys <<= np.uint64(8)
        keys |= raw[i : i + n] if n > 0 else keys
    return keys


class Tree:
    """Counts of one language: for each order the grams with their counts, the contexts with (T, D)."""

    def __init__(self, samples: list[bytes]):
        self.grams, self.contexts = [], []
        for order in range(ORDER + 1):
            keys = [grams(np.frombuffer(s, dtype=np.uint8), order + 1) for s in samples]
            keys, counts = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_counts=True)
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else counts
            kinds = np.diff(np.append(first, len(keys)))
            self.grams.append((keys, counts))
            self.contexts.append((contexts, totals, kinds))

    @staticmethod
    def _rows(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
        return at, (sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool))

    def escape(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """Bits paid for leaving each context; none where it was never seen."""
        known, totals, kinds = self.contexts[order]
        at, seen = self._rows(known, contexts)
        bits = np.zeros(len(contexts))
        bits[seen] = np.log2((totals[at[seen]] + kinds[at[seen]]) / kinds[at[seen]])
        return bits

    def cost(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each gram after the bytes before it."""
        if order < 0:
            return np.full(len(keys), 8.0)
        known, counts = self.grams[order]
        at, seen = self._rows(known, keys)
        bits = np.empty(len(keys))
        contexts, totals, kinds = self.contexts[order]
        of = np.searchsorted(contexts, keys[seen] >> np.uint64(8))
        bits[seen] = np.log2((totals[of] + kinds[of]) / counts[at[seen]])
        rest = keys[~seen]
        shorter = rest & np.uint64((1 << (8 * order)) - 1)
        bits[~seen] = self.escape(rest >> np.uint64(8), order) + self.cost(shorter, order - 1)
        return bits


class Model:
    """The trees of all languages in joint tables: one look-up of a gram gives its bits in each of them."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.names = sorted(samples)
        trees = [Tree(samples[name]) for name in self.names]
        self.tables, self.escapes = [], []
        for order in range(ORDER + 1):
            keys = np.unique(np.concatenate([t.grams[order][0] for t in trees]))
            self.tables.append((keys, np.stack([t.cost(keys, order) for t in trees], axis=1)))
            contexts = np.unique(np.concatenate([t.contexts[order][0] for t in trees]))
            self.escapes.append((contexts, np.stack([t.escape(contexts, order) for t in trees], axis=1)))

    def ready(self) -> Model:
        self.found = [(Index(k), np.vstack([c, np.zeros(c.shape[1])])) for k, c in self.tables]
        self.left = [(Index(k), np.vstack([c, np.zeros(c.shape[1])])) for k, c in self.escapes]
        return self

    def bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of each gram in each language."""
        if order < 0:
            return np.full((len(keys), len(self.names)), 8.0)
        index, costs = self.found[order]
        at = index.find(keys)
        bits = costs[at]
        off = np.flatnonzero(at < 0)
        if len(off):
            index, costs = self.left[order]
            keys = keys[off]
            bits[off] = costs[index.find(keys >> np.uint64(8))]
            bits[off] += self.bits(keys & np.uint64((1 << (8 * order)) - 1), order - 1)
        return bits

    def lengths(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths of the texts that lie end to end in ``raw``, a column for each language."""
        total = np.zeros((len(ends) - 1, len(self.names)))
        starts, sizes = ends[:-1], np.diff(ends)
        for order in range(ORDER):  # the first bytes have short contexts
            rows = np.flatnonzero(sizes > order)
            keys = np.zeros(len(rows), dtype=np.uint64)
            for i in range(order + 1):
                keys = keys << np.uint64(8) | raw[starts[rows] + i]
            total[rows] += self.bits(keys, order)
        of = np.repeat(np.arange(len(sizes)), sizes)
        for start in range(0, len(raw), BLOCK):
            stop = min(len(raw), start + BLOCK)
            lead = min(start, ORDER)
            keys = grams(raw[start - lead : stop], ORDER + 1)
            at = np.arange(start - lead + ORDER, stop)
            full = at - starts[of[at]] >= ORDER
            bits, rows = self.bits(keys[full], ORDER), of[at[full]]
            if len(rows):
                heads = np.flatnonzero(np.diff(rows, prepend=-1))
                total[rows[heads]] += np.add.reduceat(bits, heads, axis=0)
        return total


def sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """lang and text of the documents that are learned from; ``docs`` must have ``part``, the id's remainder."""
    size = F.octet_length("text")
    fit = docs.where((F.col("part") != 0) & F.col("lang").isNotNull() & (size > 0))
    sized = fit.groupBy("lang", "doc_id").agg(F.sum(size).alias("bytes"))
    order = draw_order(max_bytes)
    # A large language is ranked in blocks first, so that no task has to sort it whole.
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(256))
    blocks, whole = W.Window.partitionBy("lang", block).orderBy(*order), W.Window.partitionBy("lang").orderBy(*order)
    some = sized.withColumn("rank", F.row_number().over(blocks)).where(F.col("rank") <= max_docs)
    ranked = some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= max_docs)
    ids = ranked.withColumn("upto", F.sum("bytes").over(whole.rowsBetween(W.Window.unboundedPreceding, 0)))
    ids = ids.where((F.col("upto") <= max_bytes) | (F.col("rank") == 1))
    # max_docs ids for each language: small enough to go to every task.
    return fit.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi").select("lang", "text")


def learn(docs: DataFrame, divisor: int = 5, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model | None:
    rows = sample(docs.withColumn("part", remainder("doc_id", divisor)), max_docs, max_bytes).collect()
    texts: dict[str, list[bytes]] = {}
    for row in sorted(rows):
        texts.setdefault(row["lang"], []).append(row["text"].encode())
    return Model(texts) if texts else None


def has_letter(column: pa.Array, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    folded = raw | 0x20
    seen = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122))])
    found = seen[ends[1:]] > seen[ends[:-1]]
    for row in np.flatnonzero(~found):
        text = column[int(row)].as_py()
        found[row] = text is not None and any(c.isalpha() for c in text)
    return found


_MODELS: dict[str, Model] = {}


def predict(docs: DataFrame, model: Model | None, divisor: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    key = uuid.uuid4().hex  # workers keep what they built from it
    sent = bounded(docs.sparkSession).sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = sent.value.ready() if sent.value else None
        trained = _MODELS[key]
        for batch in nonempty(batches):
            raw, ends = utf8(batch["text"])
            letters = has_letter(batch["text"], raw, ends)
            if trained is None:
                names, share = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                bits = trained.lengths(raw, ends)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                share[~letters] = 0
                names = [trained.names[b] if k else "und" for b, k in zip(best, letters, strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(share, pa.float64()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", divisor) == 0).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
