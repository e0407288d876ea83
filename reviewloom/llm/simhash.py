"""Near duplicates by 64-bit SimHash, linked through an inverted index over byte positions.

A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are runs of ``words`` words
joined by a space (a shorter text is one shingle), repeats included. A bit of the fingerprint is set if more
than half of the shingles' XXH64 (seed 42) have it. Texts without words, null ones too, have fingerprint zero.

Fingerprints that differ in two bits at most share at least six of their eight bytes, so at least two of the
four byte pairs. The index therefore lists each distinct fingerprint under its six combinations of two byte
pairs with their values. Lists above ``LIST`` entries are dealt anew by two more of the remaining bytes;
as fingerprints are distinct, such a list has 65,536 entries at most. Within a list the shared positional bytes
of each pair are tallied, pairs with six or more are kept and verified by their differing bits. A list gives
on a spanning forest of its links, never its pairs; no link between different components is lost. Copies
are one entry with the least doc_id. Components come from ``components``.

Rows with a null id are linked like others; a component's id is its least id that isn't null. Repeated rows
come out as often as they came in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reviewloom.llm.common import bounded, nonempty, row_key, text_digest, utf8, written
from reviewloom.llm.components import components

WORDS, BITS, SEED = 3, 2, 42
LIST = 2048
PAIRS = list(combinations(range(4), 2))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(data: bytes, words: int = WORDS) -> np.ndarray:
    found = data.translate(LOWER).split()  # splits at space, \t, \n, \v, \f, \r
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    stops = list(accumulate(map(len, found), lambda a, n: a + 1 + n))
    spans = zip([0, *[s + 1 for s in stops]], stops[words - 1 :] or stops[-1:])
    h64 = xxhash.xxh64_intdigest
    return np.array([h64(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        block = hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the text's hash of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            raw, ends = utf8(batch["text"])
            fps = np.array(
                [majority(shingle_hashes(raw[a:b].tobytes(), words)) for a, b in zip(ends, ends[1:])],
                dtype=np.uint64,
            )
            yield pa.record_batch(
                {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": pa.array(fps.view(np.int64))}
            )

    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", text_digest("text").alias("text_hash"))
    return rows.mapInArrow(count, "doc_id long, text_hash long, fp long")


def _byte_pair(column: str, number: int) -> Column:
    return F.shiftrightunsigned(column, 16 * number).bitwiseAND(0xFFFF)


def lists(fps: DataFrame, longest: int = LIST) -> DataFrame:
    """(list, fp): the index lists with at least two of the distinct fingerprints ``fps``."""
    keys = [
        F.struct(
            F.lit(i).alias("at"),
            (F.shiftleft(_byte_pair("fp", a), 16).bitwiseOR(_byte_pair("fp", b))).alias("value"),
        )
        for i, (a, b) in enumerate(PAIRS)
    ]
    listed = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.at", "key.value")
    sizes = listed.groupBy("at", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sized = listed.join(sizes, ["at", "value"])
    short = sized.where(F.col("n") <= longest).select("at", "value", F.lit(-1).alias("more"), "fp")

    # Two of the four bytes that a long list's entries need not share.
    def rest(index: int) -> list[Column]:
        others = [n for n in range(4) if n not in PAIRS[index]]
        single = [F.shiftrightunsigned(_byte_pair("fp", n), 8 * k).bitwiseAND(0xFF) for n in others for k in (0, 1)]
        return [
            (F.lit(j * 65536) + F.shiftleft(single[x], 8).bitwiseOR(single[y])).cast("int")
            for j, (x, y) in enumerate(combinations(range(4), 2))
        ]

    which = F.array(*[F.array(*rest(i)) for i in range(len(PAIRS))])[F.col("at")]
    long = sized.where(F.col("n") > longest).select("at", "value", F.explode(which).alias("more"), "fp")
    return short.unionByName(long)


def forest(groups: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group of equal ``groups`` (sorted)."""
    n = len(fps)
    root = np.arange(n)
    ends = np.searchsorted(groups, groups, side="right")
    alive, lag = np.arange(n), 0
    while True:
        lag += 1
        alive = alive[alive + lag < ends[alive]]
        if not len(alive):
            break
        at = alive[root[alive] != root[alive + lag]]
        differ = fps[at] ^ fps[at + lag]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        at = at[tally >= 8 - bits]
        at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= bits]
        for i in at.tolist():
            a, b = i, i + lag
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(at):
            while not np.array_equal(root, root[root]):
                root = root[root]
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def links(fps: DataFrame, bits: int = BITS, longest: int = LIST) -> DataFrame:
    """(u, v): links that connect whatever differs in ``bits`` bits or fewer."""
    if bits > BITS:
        raise ValueError(f"the lists hold only pairs of up to {BITS} differing bits together")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _then_none(nonempty(batches)):
            if batch is not None:
                group = np.concatenate([held_group, batch["list"].to_numpy(zero_copy_only=False)])
                fp = np.concatenate([held_fp, batch["fp"].to_numpy(zero_copy_only=False)])
                stop = int(np.searchsorted(group, group[-1]))  # the last list may go on
                held_group, held_fp = group[stop:], fp[stop:]
                group, fp = group[:stop], fp[:stop]
            else:
                group, fp = held_group, held_fp
            if len(fp) > 1:
                u, v = forest(group, fp.view(np.uint64), bits)
                yield pa.record_batch({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    # Different lists with one hash meet only in being tallied together.
    dealt = lists(fps, longest).select(F.xxhash64("at", "value", "more").alias("list"), "fp")
    return dealt.repartition("list").sortWithinPartitions("list").mapInArrow(walk, "u long, v long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def classes(docs: DataFrame, words: int = WORDS, bits: int = BITS, longest: int = LIST) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id of every row of ``docs`` (doc_id, text).

    ``root`` is the fingerprint that stands for the component, which has one even where no row has an id.
    """
    rows = written(fingerprints(docs, words))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    stars = components(links(nodes.select("fp"), bits, longest)).select(
        F.col("u").alias("fp"), F.col("v").alias("root")
    )
    rooted = nodes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_each(docs: DataFrame, words: int = WORDS, bits: int = BITS, longest: int = LIST) -> DataFrame:
    """The rows of ``docs``, all their columns, that have the least id of their component; of rows alike in id and text, one."""
    return one_row_each(docs, classes(docs, words, bits, longest))


def one_row_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the least id of each ``root`` of ``found`` (doc_id, text_hash, root), one of rows alike."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = found.groupBy("root").agg(first.alias("one")).select(
        *[c.alias(n) for n, c in row_key(F.col("one.doc_id"), F.col("one.text_hash")).items()]
    )
    names = docs.columns
    rows = docs.withColumns(row_key("doc_id", text_digest("text"))).join(kept, ["__rid", "__th"], "left_semi")
    # Rows alike in id and text may differ in the other columns; the least of them as JSON stays.
    copy = F.row_number().over(W.Window.partitionBy("__rid", "__th").orderBy(F.to_json(F.struct(*names))))
    return rows.withColumn("__copy", copy).where("__copy = 1").select(*names)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
