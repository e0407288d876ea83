"""Removal of byte strings that occur more than once in the corpus, by suffix arrays of shards.

A byte goes if a ``WIDTH``-byte window that covers it starts anywhere else too, in the same text or another.

*Sharding.* Equal windows must meet in one shard. Each window has a key that its bytes alone decide: the least hash of its
``GRAM``-byte strings. Neighbouring windows mostly have their least hash at the same place and form a run with one
key (a run of one place never holds a window twice, as its least string would lie at two places). About one run
starts every 85 bytes. A key that only one run has can't hold a repeat; such runs, nearly all of a clean corpus,
are never heard of again. Runs that are alike in all their bytes are counted, not compared. Where all runs of a
key are alike, every window of theirs is a repeat. Where they differ, one text of each kind goes to the shard of the key.

*In a shard* (``SHARD`` bytes of whole keys) a suffix array over the texts is built by Larsson and Sadakane's refinement,
and Kasai's common prefixes of at least ``WIDTH`` bytes between neighbours are the repeats.

*Across shards.* A key with more than ``RUNS`` kinds of runs is dealt over several shards. Each gives on the fingerprints of its
windows, sorted; merge groups, each with its own part of the fingerprints, search every shard's list in those before it by
halving. A group has a window once for each shard.

Windows are judged on the input. Null text is empty; texts shorter than the window keep all. Rows that are alike in id and text
are copies of each other, so their long enough windows all repeat. Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reviewloom.llm.common import bounded, nonempty, row_key, text_digest, utf8, written
from reviewloom.llm.suffix_arrays import repeated_windows, words_at

WIDTH, GRAM = 200, 32
SHARD, RUNS = 1 << 20, 4096
BLOCK = 1 << 16
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on."""
    h = words_at(raw) * A
    h ^= h >> np.uint64(32)
    width = 8
    for factor in (B, C):
        h = h[:-width] * factor + h[width:]
        width *= 2
    h = h[: len(raw) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= D
    h ^= h >> np.uint64(32)
    return h


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


class Runs:
    """Cuts texts into runs of windows."""

    def __init__(self, width: int = WIDTH):
        self.width, self.span = width, width - GRAM + 1
        n = BLOCK + width
        self.power, self.inverse = _powers(int(B), n), _powers(pow(int(B), -1, 1 << 64), n)

    def block(self, raw: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """First windows, numbers of windows, keys and hashes of the runs; ``valid`` has a flag per window."""
        h = gram_hashes(raw)
        m = least(h, self.span)
        new = np.ones(len(m), dtype=bool)
        new[1:] = (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1]) | ~valid[:-1]
        new &= valid
        first = np.flatnonzero(new)
        stop = np.ones(len(m), dtype=bool)
        stop[:-1] = new[1:] | ~valid[1:]
        last = np.flatnonzero(stop & valid)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.power[: len(h)], dtype=np.uint64)])
        digest = (sums[last + self.span] - sums[first]) * self.inverse[first]
        digest = (digest ^ (digest >> np.uint64(31))) * A + (last - first).astype(np.uint64)
        return first, last - first + 1, m[first], digest

    def cut(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, first window in it, number of windows, key and hash of every run of the texts in ``raw``."""
        sizes = np.diff(ends)
        windows = np.maximum(sizes - self.width + 1, 0)
        # A flag per position: does a window fit between it and its text's end?
        change = np.zeros(len(raw) + 1, dtype=np.int8)
        full = windows > 0
        np.add.at(change, ends[:-1][full], 1)
        np.add.at(change, (ends[:-1] + windows)[full], -1)
        valid = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
        found = []
        for start in range(0, max(0, len(raw) - self.width + 1), BLOCK):
            piece = raw[start : start + BLOCK + self.width - 1]
            first, count, key, digest = self.block(piece, valid[start : start + len(piece) - self.width + 1])
            found.append((first + start, count, key, digest))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        first, count, key, digest = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.searchsorted(ends, first, side="right") - 1
        return text, first - ends[text], count, key, digest


def runs(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, run, __rid, __th, at): ``at`` is 512 times the first window plus the number of windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Runs(width)
        for batch in nonempty(batches):
            text, first, count, key, digest = cutter.cut(*utf8(batch["text"]))
            take = pa.array(text)
            yield pa.record_batch(
                {
                    "key": pa.array(key.view(np.int64)),
                    "run": pa.array(digest.view(np.int64)),
                    "__rid": batch["__rid"].take(take),
                    "__th": batch["__th"].take(take),
                    "at": pa.array(first * 512 + count),
                }
            )

    return rows.select("__rid", "__th", "text").mapInArrow(cut, "key long, run long, __rid long, __th int, at long")


def run_texts(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, run, n, salt, shards, bytes) of the runs named in ``rows``: __rid, __th, text, __wanted and any more columns."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            raw, ends = utf8(batch["text"])
            wanted = batch["__wanted"]
            runs_of = wanted.flatten()
            of = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            at = runs_of.field("at").to_numpy()
            begin = ends[of] + (at >> 9)
            size = (at & 511) - 1 + width
            texts = [raw[a : a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist())]
            columns = {c: runs_of.field(c) for c in ("key", "run", "n", "salt", "shards")}
            yield pa.record_batch(columns | {"bytes": pa.array(texts, pa.binary())})

    return rows.mapInArrow(fetch, "key long, run long, n long, salt int, shards int, bytes binary")


def packed_ranges(found: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """For each run, its stretches of found windows as 512 * first + number."""
    ends = np.cumsum(counts)
    edge = np.zeros(len(found), dtype=bool)
    edge[(ends - counts)[counts > 0]] = True
    first = np.flatnonzero(found & (edge | ~np.concatenate([[False], found[:-1]])))
    stop = np.flatnonzero(found & np.concatenate([edge[1:] | ~found[1:], [True]])[: len(found)]) + 1
    of = np.searchsorted(ends, first, side="right")
    out: list[list[int]] = [[] for _ in counts]
    for run, a, b in zip(of.tolist(), (first - (ends - counts)[of]).tolist(), (stop - (ends - counts)[of]).tolist()):
        out[run].append(a * 512 + b - a)
    return out


def fingerprints(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window of a text."""
    raw = np.frombuffer(text, dtype=np.uint8)
    h = gram_hashes(raw)
    span, two = width - GRAM + 1, []
    for base in (int(C), int(D)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)])
        n = len(raw) - width + 1
        value = (sums[span : span + n] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n)
        two.append(value ^ (value >> np.uint64(32)))
    return two[0], two[1]


def judge(texts: DataFrame, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """(key, run, ranges, shards, salt, w1, w2, place): ranges of repeated windows, and for keys of several shards every
    window for the merge, as those of other shards may equal it; ``place`` is below zero for one known to repeat."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in nonempty(batches):
            for row in batch.to_pylist():
                if size >= shard and (row["key"], row["salt"]) != (held[-1]["key"], held[-1]["salt"]):
                    yield from one(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield from one(held)

    def one(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found, ranked = repeated_windows([r["bytes"] for r in rows], width)
        counts = np.array([len(r["bytes"]) - width + 1 for r in rows], dtype=np.int64)
        found |= np.repeat([r["n"] > 1 for r in rows], counts)
        ranges = packed_ranges(found, counts)
        yield pa.record_batch(
            {
                "key": pa.array([r["key"] for r in rows], pa.int64()),
                "run": pa.array([r["run"] for r in rows], pa.int64()),
                "ranges": pa.array(ranges, pa.list_(pa.int64())),
                "shards": pa.nulls(len(rows), pa.int32()),
                "salt": pa.nulls(len(rows), pa.int32()),
                "w1": pa.nulls(len(rows), pa.int64()),
                "w2": pa.nulls(len(rows), pa.int64()),
                "place": pa.nulls(len(rows), pa.int32()),
            }
        )
        offset = np.cumsum(counts) - counts
        for i, row in enumerate(rows):
            if row["shards"] > 1:
                w1, w2 = fingerprints(row["bytes"], width)
                n = len(w1)
                yield pa.record_batch(
                    {
                        "key": pa.array([row["key"]] * n, pa.int64()),
                        "run": pa.array([row["run"]] * n, pa.int64()),
                        "ranges": pa.nulls(n, pa.list_(pa.int64())),
                        "shards": pa.array([row["shards"]] * n, pa.int32()),
                        "salt": pa.array([row["salt"]] * n, pa.int32()),
                        "w1": pa.array(w1.view(np.int64)),
                        "w2": pa.array(w2.view(np.int64)),
                        "place": pa.array(np.where(found[offset[i] : offset[i] + n], -1 - np.arange(n), np.arange(n)), pa.int32()),
                    }
                )

    dealt = texts.repartition("key", "salt").sortWithinPartitions("key", "salt", "run")
    return dealt.mapInArrow(
        sort, "key long, run long, ranges array<long>, shards int, salt int, w1 long, w2 long, place int"
    )


def merged(windows: DataFrame) -> DataFrame:
    """(key, run, ranges) of the windows that another shard of their key has too.

    A merge group holds each of its windows once for a shard, however many runs have it; the verdict goes back by a join.
    """

    def search(table: pa.Table) -> pa.Table:
        w1, w2 = (table[c].to_numpy().view(np.uint64) for c in ("w1", "w2"))
        salt = table["salt"].to_numpy()
        both = np.empty(len(w1), dtype=[("a", np.uint64), ("b", np.uint64)])
        both["a"], both["b"] = w1, w2
        names, known = np.unique(both, return_inverse=True)  # one number for both halves keeps their order
        order = np.lexsort((known, salt))
        cuts = np.flatnonzero(np.diff(salt[order], prepend=-1, append=-1))
        before = np.zeros(0, dtype=np.int64)  # sorted windows of the shards so far
        seen = np.zeros(len(names), dtype=bool)
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = known[order[a:b]]
            at = np.searchsorted(before, own)
            hit = at < len(before)
            hit[hit] = before[at[hit]] == own[hit]
            seen[own[hit]] = True
            before = np.union1d(before, own)
        found = np.ascontiguousarray(names[seen]["a"]), np.ascontiguousarray(names[seen]["b"])
        key = table["key"].slice(0, 1).to_pylist() * len(found[0])
        return pa.table({"key": pa.array(key, pa.int64())} | {n: pa.array(w.view(np.int64)) for n, w in zip(("w1", "w2"), found)})

    every = windows.where("w1 IS NOT NULL").select("key", "salt", "shards", "run", "w1", "w2", "place")
    part = F.pmod(F.xxhash64("w1", "w2"), F.col("shards")).alias("part")
    once = every.select("key", part, "salt", "w1", "w2").distinct()
    shared = once.groupBy("key", "part").applyInArrow(search, "key long, w1 long, w2 long")
    place = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).cast("long")
    hits = every.join(shared, ["key", "w1", "w2"]).select("key", "run", (place * 512 + 1).alias("at"))
    return hits.groupBy("key", "run").agg(F.collect_list("at").alias("ranges"))


def spans(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, longest: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """``docs`` with __rid and __th, and (__rid, __th, __ranges): windows that repeat, as 512 * first + number."""
    bounded(docs.sparkSession)
    rows = docs.withColumns(row_key("doc_id", text_digest("text")))
    cut = runs(rows, width)
    keys = cut.groupBy("key").agg(F.count("*").alias("n"), F.min("run").alias("low"), F.max("run").alias("high"))
    keys = keys.where("n > 1").select("key", (F.col("low") != F.col("high")).alias("differ"))
    # Written, so that the join is one that Spark splits where a key is hot. Rows alike in id and text have their places once.
    met = written(cut.join(written(keys), "key"))
    met = met.groupBy("key", "differ", "run", "__rid", "__th", "at").agg(F.count("*").alias("copies"))
    met = written(met)
    kinds = met.where("differ").groupBy("key", "run").agg(
        F.min(F.struct("__rid", "__th", "at")).alias("one"), F.sum("copies").alias("n")
    )
    long = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > longest)
    kinds = kinds.join(long, "key", "left")
    shards = F.coalesce(F.ceil(F.col("kinds") / longest), F.lit(1)).cast("int")
    kinds = kinds.select("key", "run", "n", "one", shards.alias("shards"))
    kinds = kinds.withColumn("salt", F.pmod(F.xxhash64("run"), F.col("shards")).cast("int"))
    wanted = kinds.groupBy("one.__rid", "one.__th").agg(
        F.collect_list(F.struct("key", "run", "n", "salt", "shards", "one.at")).alias("__wanted")
    )
    # Of rows alike in id and text, one gives its runs; the join has brought them together already.
    texts = rows.select("__rid", "__th", "text").join(wanted, ["__rid", "__th"]).dropDuplicates(["__rid", "__th"])
    judged = written(judge(run_texts(texts, width), width, shard))
    verdict = judged.where("ranges IS NOT NULL AND size(ranges) > 0").select("key", "run", "ranges")
    verdict = verdict.unionByName(merged(judged))
    # What was found of a kind of run goes to its places in groups of some thousand ids, so that a run which very many
    # texts have meets its verdict in many tasks.
    verdict = verdict.groupBy("key", "run").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    places = met.where("differ").select("key", "run", F.shiftright("__rid", 12).alias("some"), "__rid", "__th", "at")
    told = places.select("key", "run", "some").distinct().join(verdict, ["key", "run"])
    group = W.Window.partitionBy("key", "run", "some")
    both = places.unionByName(told, allowMissingColumns=True)
    both = both.withColumn("ranges", F.first("ranges", ignorenulls=True).over(group))
    differ = both.where("at IS NOT NULL AND ranges IS NOT NULL").select(
        "__rid", "__th", F.transform("ranges", lambda r: r + F.shiftright("at", 9) * 512).alias("ranges")
    )
    every = met.where("NOT differ").select("__rid", "__th", F.array("at").alias("ranges")).unionByName(differ)
    return rows, every.groupBy("__rid", "__th").agg(F.flatten(F.collect_list("ranges")).alias("__ranges"))


def covered(size: int, ranges: list | np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The removed runs of a text, a row of begin and end each."""
    if not len(ranges):
        return np.zeros((0, 2), dtype=np.int64)
    at = np.asarray(ranges, dtype=np.int64)
    begin = at >> 9
    end = begin + (at & 511) - 1 + width
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return np.stack([begin[new], end[np.concatenate([new[1:], [True]])]], axis=1)


def _kept(raw: np.ndarray, cuts: np.ndarray) -> bytes:
    edges = np.concatenate([[0], cuts.ravel(), [len(raw)]]).reshape(-1, 2)
    return b"".join(raw[a:b].tobytes() for a, b in edges.tolist())


def report(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, longest: int = RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""

    def judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            rows = []
            for text, cuts in removed(batch, width):
                gone = int((cuts[:, 1] - cuts[:, 0]).sum())
                rows.append((len(text), gone, len(cuts), hashlib.sha256(_kept(text, cuts)).hexdigest()))
            sizes, gone, n, digest = zip(*rows, strict=True)
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "n_spans": pa.array(n, pa.int64()),
                    "kept_sha256": pa.array(digest),
                }
            )

    rows, found = spans(docs.select(F.col("doc_id").cast("long"), "text"), width, shard, longest)
    return rows.join(found, ["__rid", "__th"], "left").mapInArrow(
        judge_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def removed(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of each text of a batch, and its removed runs."""
    raw, ends = utf8(batch["text"])
    for i, ranges in enumerate(batch["__ranges"]):
        text = raw[ends[i] : ends[i + 1]]
        yield text, covered(len(text), ranges.values.to_numpy() if ranges.is_valid else [], width)


def stripped(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, longest: int = RUNS) -> DataFrame:
    """``docs``, all columns, with the repeats taken out of ``text`` (and ``n_chars`` to match, if it is there).

    A character of which a part goes, goes. Texts without repeats stay as they are, null ones too.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            texts = batch["text"].to_pylist()
            for i, (text, cuts) in enumerate(removed(batch, width)):
                if len(cuts):
                    texts[i] = _kept(text, cuts).decode("utf-8", "ignore")
            columns = {n: batch[n] for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                sizes = [None if t is None else len(t) for t in texts]
                changed = pa.array(sizes, pa.int64()).cast(columns["n_chars"].type)
                columns["n_chars"] = changed
            yield pa.record_batch([columns[n] for n in names], names)

    names = docs.columns
    rows, found = spans(docs, width, shard, longest)
    return rows.join(found, ["__rid", "__th"], "left").mapInArrow(strip, docs.schema)
