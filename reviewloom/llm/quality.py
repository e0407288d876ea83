"""Quality of documents by a linear-chain conditional random field over their lines.

Each line is good or bad. A line's features are shares of its bytes and words (letters, symbols, repeats, ...),
with hinges at quantiles, of itself and of its neighbours before and after; a chain of two states joins the lines of
a document. The field is fitted by gradient ascent on whole-document likelihoods, the document's label standing
for each of its lines. A document's score is the mean of its lines' forward-backward marginals of being
good, weighted by line length.

The fit takes at most ``max_docs`` labelled documents and ``max_bytes`` bytes of them together, those first by a hash of
their id, and only ids whose crc32 isn't held out; the first document of each label is taken whole whatever its size, so
that a label of long documents alone is learned too. Rows of one id count as one document. Only text is scored: no
id, language or source.
Null and empty texts are one empty line. Repeated rows score alike. If several labels of one document differ, the
least counts; null labels don't. Without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reviewloom.llm.common import bounded, draw_order, nonempty, remainder, utf8

MAX_DOCS, MAX_BYTES = 4000, 24 << 20
ROUNDS, RATE, RIDGE = 250, 0.08, 1e-3
THRESHOLD = 0.7
QUANTILES = (0.5, 0.9, 0.98)
BLOCK = 1 << 20

# Kinds of bytes.
LETTER, DIGIT, SPACE, STOP, UPPER, WIDE, SYMBOL = (1 << i for i in range(7))
KIND = np.zeros(256, dtype=np.uint8)
KIND[33:127] = SYMBOL
KIND[[ord(c) for c in ".,;:!?'\"()-"]] = STOP
KIND[48:58] = DIGIT
KIND[97:123] = LETTER
KIND[65:91] = LETTER | UPPER
KIND[128:] = LETTER | WIDE
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
BASE = ("length", "letters", "digits", "spaces", "stops", "upper", "wide", "symbols", "word", "again", "near", "same")


def _segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the lines, without their line feeds, and the document of each."""
    feeds = np.flatnonzero(raw == 10)
    starts = np.concatenate([ends[:-1], feeds + 1])
    stops = np.concatenate([feeds, ends[1:]])
    # A feed's line belongs to the document it lies in; texts of no bytes come before others at their place.
    of_feed = np.searchsorted(ends, feeds, side="right") - 1
    docs = np.arange(len(ends) - 1)
    order = np.lexsort((starts, np.concatenate([docs, of_feed])))
    order_stops = np.lexsort((stops, np.concatenate([of_feed, docs])))
    return starts[order], stops[order_stops], np.concatenate([docs, of_feed])[order]


def line_features(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base features of each line, the lengths of the lines, and the document of each."""
    starts, stops, docs = _segments(raw, ends)
    size = (stops - starts).astype(np.float64)
    kinds = KIND[raw]
    share = []
    some = np.maximum(size, 1)
    for kind in (LETTER, DIGIT, SPACE, STOP, UPPER, WIDE, SYMBOL):
        sums = np.concatenate([[0], np.cumsum((kinds & kind) != 0, dtype=np.int64)])
        share.append((sums[stops] - sums[starts]) / some)
    # Words: runs of anything but white space; a hash of each by prefix sums modulo 2 ** 64.
    word = (kinds & SPACE) == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = starts[starts < len(raw)]
    first[edges] = word[edges]
    begins = np.flatnonzero(first)
    after = np.concatenate([begins[1:], [len(raw)]])
    hashes, until = word_hashes(raw, word, begins, after)
    line = np.searchsorted(starts, begins, side="right") - 1
    counts = np.bincount(line, minlength=len(starts)).astype(np.float64)
    lag = lambda k: (hashes[k:] == hashes[:-k]) & (line[k:] == line[:-k])
    again = np.bincount(line[1:][lag(1)], minlength=len(starts)) if len(begins) > 1 else np.zeros(len(starts))
    near = np.zeros(len(starts))
    for k in (2, 3, 4):
        if len(begins) > k:
            near += np.bincount(line[k:][lag(k)], minlength=len(starts))
    total = np.bincount(line, weights=(hashes >> np.uint64(12)).astype(np.float64), minlength=len(starts))
    same = np.zeros(len(starts))
    same[1:] = (total[1:] == total[:-1]) & (size[1:] == size[:-1]) & (docs[1:] == docs[:-1]) & (size[1:] > 0)
    many = np.maximum(counts, 1)
    columns = [np.log1p(size), *share, np.minimum(size / many, 40), again / many, near / many, same]
    return np.stack(columns, axis=1), size, docs


def word_hashes(raw: np.ndarray, word: np.ndarray, begins: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the word at each of ``begins``: its bytes weighted by their place in it."""
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(raw)]])))
    weighted = (raw.astype(np.uint64) + np.uint64(1)) * POWERS[place & 63] * word
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    mixed = (sums[after] - sums[begins]) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29)), after


POWERS = np.cumprod(np.full(64, 0x5851F42D4C957F2D, dtype=np.uint64), dtype=np.uint64)


def widened(base: np.ndarray, docs: np.ndarray, hinges: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features and hinges of each line, then those of the line before and the one after."""
    parts = [(base - mean) / scale]
    parts += [np.maximum(0, base - h) / scale for h in hinges]
    own = np.concatenate(parts, axis=1).clip(-8, 8)
    before, behind = np.zeros_like(own), np.zeros_like(own)
    inner = docs[1:] == docs[:-1]
    before[1:][inner] = own[:-1][inner]
    behind[:-1][inner] = own[1:][inner]
    lone = np.ones((len(base), 3))
    lone[1:, 1] = inner
    lone[:1, 1] = 0
    lone[:-1, 2] = inner
    lone[-1:, 2] = 0
    return np.concatenate([own, before, behind, lone], axis=1)


class Chains:
    """Lines of several documents laid out by step, longest documents first."""

    def __init__(self, docs: np.ndarray):
        _, first, counts = np.unique(docs, return_index=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        self.order, first, counts = order, first[order], counts[order]
        alive = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), side="left")
        self.steps = [first[:n] + t for t, n in enumerate(alive)]

    def marginals(self, node: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of node scores (bad 0, good ``node``) and pair scores: P(good) of each line, expected pairs, log Z of documents."""
        emit = np.stack([-np.logaddexp(0, node), -np.logaddexp(0, -node)], axis=1)
        emit = np.exp(emit)  # scaled so that both add up to 1
        move = np.exp(pair)
        ahead, norm = np.empty_like(emit), np.empty(len(node))
        for t, rows in enumerate(self.steps):
            now = emit[rows] if not t else emit[rows] * (ahead[self.steps[t - 1][: len(rows)]] @ move)
            norm[rows] = now.sum(axis=1)
            ahead[rows] = now / norm[rows][:, None]
        back, pairs = np.ones_like(emit), np.zeros((2, 2))
        for t in range(len(self.steps) - 2, -1, -1):
            rows, nexts = self.steps[t][: len(self.steps[t + 1])], self.steps[t + 1]
            seen = emit[nexts] * back[nexts] / norm[nexts][:, None]
            pairs += np.einsum("na,ab,nb->ab", ahead[rows], move, seen)
            back[rows] = seen @ move.T
        log_z = np.log(norm) + np.logaddexp(0, node)
        good = ahead[:, 1] * back[:, 1]
        return good / (good + ahead[:, 0] * back[:, 0]), pairs, log_z


class Field:
    def __init__(self, base: np.ndarray, docs: np.ndarray, labels: np.ndarray):
        """``labels``: 0 or 1 for each line, its document's."""
        self.hinges = np.quantile(base, QUANTILES, axis=0)
        self.mean, self.scale = base.mean(axis=0), base.std(axis=0) + 1e-3
        wide = self.wide(base, docs)
        chains = Chains(docs)
        same = docs[1:] == docs[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[:-1][same], labels[1:][same]), 1)
        n_docs = max(1, len(np.unique(docs)))
        theta = np.zeros(wide.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, ROUNDS + 1):
            good, pairs, _ = chains.marginals(wide @ theta[:-4], theta[-4:].reshape(2, 2))
            slope = np.concatenate([wide.T @ (labels - good), (seen - pairs).ravel()]) / n_docs - RIDGE * theta
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.pair = theta[:-4], theta[-4:].reshape(2, 2)

    def wide(self, base: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return widened(base, docs, self.hinges, self.mean, self.scale)

    def score(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        base, size, docs = line_features(raw, ends)
        node = np.empty(len(base))
        for start in range(0, len(base), 8192):  # a line more on either side for the neighbours
            stop, low, high = start + 8192, max(0, start - 1), min(len(base), start + 8193)
            wide = self.wide(base[low:high], docs[low:high])
            node[start:stop] = (wide @ self.weights)[start - low : start - low + 8192]
        good, _, _ = Chains(docs).marginals(node, self.pair)
        weight = size + 1
        return np.bincount(docs, weights=weight * good) / np.bincount(docs, weights=weight)


def learn(docs: DataFrame, labels: DataFrame, divisor: int = 4, held: int = 2, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Field | None:
    bounded(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", divisor) != held))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sized = texts.groupBy("doc_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    usable, order = marked.join(sized, "doc_id"), draw_order(max_bytes)
    # The first document of each label, then the first of all: few enough to go to every task.
    firsts = W.Window.partitionBy("quality").orderBy(*order)
    leads = usable.withColumn("turn", F.row_number().over(firsts) - 1).where(F.col("turn") == 0)
    drawn = usable.orderBy(*order).limit(max_docs).withColumn("turn", F.lit(1)).unionByName(leads)
    once = drawn.groupBy("doc_id", "quality", "bytes").agg(F.min("turn").alias("turn"))
    upto = F.sum("bytes").over(W.Window.orderBy("turn", *order).rowsBetween(W.Window.unboundedPreceding, 0))
    chosen = once.withColumn("upto", upto).where((F.col("upto") <= max_bytes) | (F.col("turn") == 0)).select("doc_id", "quality")
    schema = "doc_id long, quality int, n_line int, " + ", ".join(f"{n} double" for n in BASE)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            base, _, of = line_features(*utf8(batch["text"]))
            n_line = np.arange(len(of)) - np.searchsorted(of, of)
            columns = {
                "doc_id": batch["doc_id"].take(pa.array(of)),
                "quality": batch["quality"].take(pa.array(of)),
                "n_line": pa.array(n_line.astype(np.int32)),
            }
            yield pa.record_batch(columns | {n: pa.array(base[:, i]) for i, n in enumerate(BASE)})

    found = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(features, schema).toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("doc_id", "ascending"), ("n_line", "ascending")])
    ids = found["doc_id"].to_numpy()
    starts = found["n_line"].to_numpy() == 0  # repeated rows are documents of their own
    return Field(
        np.stack([found[n].to_numpy() for n in BASE], axis=1),
        np.cumsum(starts | np.diff(ids, prepend=-1).astype(bool)),
        found["quality"].to_numpy().astype(np.int64),
    )


def scores(field: Field | None, batch: pa.RecordBatch) -> np.ndarray:
    """The score of each text of a batch, worked out in blocks of about a megabyte."""
    raw, ends = utf8(batch["text"])
    if field is None:
        return np.full(batch.num_rows, 0.5)
    found, first = np.empty(batch.num_rows), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, side="right")) - 1)
        found[first:last] = field.score(raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last
    return found


def predict(docs: DataFrame, field: Field | None, divisor: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(field)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            found = scores(sent.value, batch)
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "score": pa.array(found),
                    "predicted": pa.array((found >= threshold).astype(np.int32)),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", divisor) == held).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, field: Field | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text the field takes for good; without a field, all of them."""
    if field is None:
        return docs
    sent = bounded(docs.sparkSession).sparkContext.broadcast(field)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            yield batch.filter(pa.array(scores(sent.value, batch) >= threshold))

    return docs.mapInArrow(good, docs.schema)
