"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every byte of a text starts one triplet (the byte, and those 3 and 8 further on; past the end they are
zero), which is hashed into one of 256 buckets. The digest holds the length on a logarithmic scale, how
the bucket quartiles relate, and for each bucket the quarter that its count lies in: 2 + 2 + 128 hex
digits. Two digests differ by the mean step between their buckets (a step from the lowest to the highest
quarter counts double) and a bounded share for length; the likeness is 1 less half of that, and 0 at least.
Equal texts have equal digests; the empty text has the digest of no counts.

``neighbours`` compares each text with an edited form of it and with the next one by doc_id. One shuffle by
ranges of doc_id puts neighbours side by side; a task gives on the first and the last text of its range only,
so that no task sees more. Null text is empty. Rows of equal doc_id follow each other in order of a hash of their text,
so that many of them are dealt to several tasks; null ids come first; the last row's next is the first row, and a single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reviewloom.llm.common import bounded, nonempty, text_digest, texts, written

BUCKETS = 256
OFFSETS = (3, 8)
LENGTH_STEPS, LENGTH_SHARE = 40, 0.5

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def triplet_counts(parts: list[bytes]) -> np.ndarray:
    """Bucket counts of each of the byte strings, a row each."""
    ends = np.cumsum([len(p) for p in parts])
    counts = np.empty((len(parts), BUCKETS), dtype=np.int64)
    first = 0
    while first < len(parts):  # blocks of about a megabyte stay in the caches
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + (1 << 20), side="right")))
        counts[first:last] = _block_counts(parts[first:last])
        first = last
    return counts


def _block_counts(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    if not len(raw):
        return np.zeros((len(parts), BUCKETS), dtype=np.int64)
    ends = np.cumsum(lengths)
    mixed = raw.astype(np.uint32) * np.uint32(0x9E3779B1)
    for offset, factor in zip(OFFSETS, (0x85EBCA77, 0xC2B2AE3D), strict=True):
        moved = np.zeros(len(raw), dtype=np.uint32)
        moved[: max(0, len(raw) - offset)] = raw[offset:]
        for back in range(1, offset + 1):  # these reach into the next text
            at = ends[lengths >= back] - back
            moved[at] = 0
        mixed += moved * np.uint32(factor)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(12)
    of = np.repeat(np.arange(len(parts)) * BUCKETS, lengths) + (mixed % np.uint32(BUCKETS))
    return np.bincount(of, minlength=len(parts) * BUCKETS).reshape(len(parts), BUCKETS)


class Digests:
    """Digests of several texts: quarter per bucket, length code, quartile code."""

    def __init__(self, parts: list[bytes]):
        counts = triplet_counts(parts)
        ranked = np.sort(counts, axis=1)
        q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        self.quarters = sum((counts > q[:, [i]]).astype(np.int8) for i in range(3))
        sizes = np.array([len(p) for p in parts], dtype=np.float64)
        self.length = np.minimum(255, np.rint(8 * np.log2(sizes + 1))).astype(np.int64)
        top = np.maximum(1, q[:, 2])
        self.ratio = (15 * q[:, 0] // top) * 16 + 15 * q[:, 1] // top

    def __getitem__(self, rows) -> Digests:
        some = Digests.__new__(Digests)
        some.quarters, some.length, some.ratio = self.quarters[rows], self.length[rows], self.ratio[rows]
        return some

    def hex(self) -> list[str]:
        q = self.quarters.astype(np.uint8).reshape(len(self.quarters), -1, 4)
        packed = q[:, :, 0] << 6 | q[:, :, 1] << 4 | q[:, :, 2] << 2 | q[:, :, 3]
        return [
            f"{n:02x}{r:02x}{row.tobytes().hex()}"
            for n, r, row in zip(self.length.tolist(), self.ratio.tolist(), packed, strict=True)
        ]

    def likeness(self, other: Digests) -> np.ndarray:
        step = np.abs(self.quarters - other.quarters)
        apart = (step + 3 * (step == 3)).sum(axis=1) / BUCKETS
        apart += LENGTH_SHARE * np.minimum(np.abs(self.length - other.length), LENGTH_STEPS) / LENGTH_STEPS
        return np.maximum(0.0, 1.0 - apart / 2)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compare(ids: list, own: list[str], nexts: list[str]) -> dict:
    """The result's columns for texts and their next ones."""
    changed = [edited(a, b).encode() for a, b in zip(own, nexts, strict=True)]
    a, b = Digests([t.encode() for t in own]), Digests(changed)
    c = Digests([t.encode() for t in nexts])
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in own], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(a.hex(), pa.string()),
        "edited_fingerprint": pa.array(b.hex(), pa.string()),
        "near_edited": pa.array(a.likeness(b)),
        "near_next": pa.array(a.likeness(c)),
    }


def _chained(ids: list, chain: list[str]) -> dict:
    """The same where the texts of ``chain`` (one more than ids) follow each other: each is digested once."""
    changed = [edited(x, y).encode() for x, y in zip(chain, chain[1:])]
    every, b = Digests([t.encode() for t in chain]), Digests(changed)
    a, c = every[:-1], every[1:]
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in chain[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(a.hex(), pa.string()),
        "edited_fingerprint": pa.array(b.hex(), pa.string()),
        "near_edited": pa.array(a.likeness(b)),
        "near_next": pa.array(a.likeness(c)),
    }


def neighbours(docs: DataFrame) -> DataFrame:
    """The columns of RESULT for every row of ``docs`` (doc_id, text)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in nonempty(batches):
            ids, own = batch["doc_id"].to_pylist(), texts(batch["text"])
            if held is None:
                yield _ends("first", part, ids[0], own[0])
            else:
                ids, own = [held[0], *ids], [held[1], *own]
            held = ids[-1], own[-1]
            if len(ids) > 1:
                n = len(ids) - 1
                yield pa.record_batch(
                    {
                        "kind": pa.array(["row"] * n),
                        "part": pa.array([part] * n, pa.int32()),
                        "text": pa.nulls(n, pa.string()),
                        **_chained(ids[:-1], own),
                    }
                )
        if held:
            yield _ends("last", part, *held)

    def _ends(kind: str, part: int, doc_id, text: str) -> pa.RecordBatch:
        none = {n: pa.nulls(1, t) for n, t in zip(NAMES[1:], TYPES, strict=True)}
        return pa.record_batch(
            {
                "kind": pa.array([kind]),
                "part": pa.array([part], pa.int32()),
                "text": pa.array([text]),
                "doc_id": pa.array([doc_id], pa.int64()),
                **none,
            }
        )

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            yield pa.record_batch(
                _compare(batch["doc_id"].to_pylist(), texts(batch["text"]), texts(batch["next_text"]))
            )

    bounded(docs.sparkSession)
    ranged = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), text_digest("text").alias("digest")
    )
    ranged = ranged.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").drop("digest")
    walked = written(ranged.mapInArrow(walk, f"kind string, part int, text string, {RESULT}"))
    # Two rows for each task that had any.
    firsts = walked.where("kind = 'first'").select("part", F.col("text").alias("next_text"))
    order = W.Window.orderBy("part")
    whole = order.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    follows = walked.where("kind = 'last'").select(
        F.col("part").alias("from_part"),
        F.coalesce(F.lead("part").over(order), F.min("part").over(whole)).alias("part"),
    )
    lasts = walked.where("kind = 'last'").select(F.col("part").alias("from_part"), "doc_id", "text")
    seams = lasts.join(follows, "from_part").join(firsts, "part").select("doc_id", "text", "next_text")
    return walked.where("kind = 'row'").select(*NAMES).unionByName(seams.mapInArrow(join_up, RESULT))


NAMES = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
