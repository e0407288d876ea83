"""Alignment of two tokenizers over a corpus: which tokens of the one lie over which tokens of the other, and how often.

Every text, with a space before it, is cut by a byte-level vocabulary (A) and by a vocabulary of pieces (B). Offsets in
bytes where tokens of both end cut it into groups; an A and a B token whose bytes overlap are linked. The count of a
pair of ids is the number of links of it in the whole corpus.

1. The ids of every text are written once; nothing is tokenized twice.
2. The distinct pairs get minimal perfect hashes, shard by shard, with each index's pair for verification.
3. Every task counts its links in a dense vector indexed by hash. The vectors are cut into shards and summed as a tree;
   a shard of which a task has seen little goes as the indexes seen.
4. The texts are aligned again, and each link's count is looked up by hash.

The tables of hashes are broadcast in lots of at most ``lot`` pairs, each with a pass of its own over the written ids, so
what a worker holds is bounded however many pairs there are. The highest counts of B's ids are one number for each
entry of its vocabulary.

Texts that are null, empty, or whose tokens' bytes don't give the text back have no tokens. Special strings in texts are
plain text. No token of either vocabulary lies over a single space between two other characters, which is proven of their
entries; very long texts are cut there for the libraries. Rows keep what they are; repeated rows count as often as they come.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import bounded, nonempty, texts, written
from reviewloom.llm.perfect_hash import Table, built, shard_of
from reviewloom.llm.tokens import LETTERS

#: Pairs of a shard, about; pairs whose hashes a worker holds at once; salts of the first sum of the tree.
SHARD, LOT, FAN = 1 << 13, 1 << 22, 16
#: Characters of a text that go to a library at once, and bytes of text or ids in one piece of work.
PORTION, RESULT_BYTES = 1 << 20, 1 << 20
#: A space before which, and behind which, another character stands; Python's white space is the widest there is.
CUT = re.compile(r"(?<=\S) (?=[^\s▁])")


class Vocabularies:
    """Both tokenizers, from the contents of their files, with the bytes of every token."""

    def __init__(self, byte_level: str, pattern: str, pieces: bytes):
        content = json.loads(byte_level)
        special = {t["content"] for t in content["added_tokens"]}
        byte_of = {letter: byte for byte, letter in enumerate(LETTERS)}
        vocabulary = content["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in name): i for name, i in vocabulary.items() if name not in special}
        # Merging by the rank of what comes out is merging by the list where the list is in that order.
        pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        made = [vocabulary["".join(pair)] for pair in pairs]
        if any(a >= b for a, b in zip(made, made[1:])) or len(made) + 256 != len(ranks):
            raise ValueError("the merges are not in the order of their tokens")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes = tuple(np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.flat_b = np.frombuffer(b"".join(self.bytes_b), dtype=np.uint8)
        self.first_b = np.cumsum(self.sizes[1]) - self.sizes[1]
        inside = any(re.search(r"\S ", t.decode("utf-8", "replace")) for x in (self.bytes_a, self.bytes_b) for t in x)
        whole = not inside and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b")
        self.portion = PORTION if whole else None

    def portions(self, text: str) -> list[str]:
        """``text`` in portions; the space at a cut goes, as each portion gets one before it."""
        found, start = [], 0
        while self.portion is not None and len(text) - start > self.portion:
            cut = CUT.search(text, start + self.portion)
            if cut is None:
                break
            found.append(text[start : cut.start()])
            start = cut.end()
        return [*found, text[start:] if start else text]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both for each text; none where their bytes aren't the text's."""
        none, found = np.zeros(0, dtype=np.uint32), []
        parts = [self.portions(t) if t else [] for t in texts]
        # One vocabulary after the other, as each needs the processor's memory for itself.
        every_a = [_numbers([self.a.encode_ordinary(" " + p) for p in some]) for some in parts]
        every_b = [_numbers([self.b.encode(p) for p in some]) for some in parts]
        for text, a, b in zip(texts, every_a, every_b):
            want = np.frombuffer(b" " + text.encode("utf-8"), dtype=np.uint8)
            # A's tokens are the bytes of pieces of the text in their order, so only their number can differ.
            same = self.sizes[0][a].sum() == len(want) and np.array_equal(self.joined_b(b, len(want)), want)
            found.append((a, b) if same else (none, none))
        return found

    def joined_b(self, ids: np.ndarray, size: int) -> np.ndarray | None:
        """The bytes of B's tokens end to end; none if they aren't ``size`` bytes."""
        sizes = self.sizes[1][ids]
        ends = np.cumsum(sizes)
        if ends[-1:].sum() != size:
            return None
        return self.flat_b[np.repeat(self.first_b[ids] - ends + sizes, sizes) + np.arange(size)]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The same as little-endian 32 bits."""
        a, b = (x.astype("<u4").tobytes() for x in self.ids([text])[0])
        return a, b


def _numbers(lists: list[list[int]]) -> np.ndarray:
    return np.frombuffer(array("I", lists[0] if len(lists) == 1 else chain.from_iterable(lists)), dtype=np.uint32)


class Aligned:
    """The links of some texts, from their ids end to end and the numbers of ids of each."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], a: list[np.ndarray], b: list[np.ndarray]):
        """``sizes``: the bytes of every token of A and of B."""
        self.a, self.b = (np.concatenate([np.zeros(0, np.uint16), *x]) for x in (a, b))
        self.ends_a, self.ends_b = np.cumsum(sizes[0][self.a]), np.cumsum(sizes[1][self.b])
        # No token is empty: where a token of A ends is marked by 1, where one of B ends by 2.
        marks = np.zeros(int(max(self.ends_a[-1:].sum(), self.ends_b[-1:].sum())) + 1, dtype=np.uint8)
        marks[self.ends_a] = 1
        marks[self.ends_b] += 2
        ends = np.flatnonzero(marks != 0)  # each stretch between two ends lies in one A and one B token: a link
        own = marks[ends]
        at_a, at_b = (np.cumsum(x, dtype=np.int64) - x for x in (own & 1, own >> 1))
        both = np.flatnonzero(own == 3)  # where both end: the groups, up to which there are as many ids
        self.shared, self.upto_a, self.upto_b = ends[both], at_a[both] + 1, at_b[both] + 1
        self.link_b = self.b[at_b]
        self.pairs = self.a[at_a].astype(np.int64) * len(sizes[1]) + self.link_b
        self.texts_a = np.cumsum([0, *map(len, a)])
        self.texts_b = np.cumsum([0, *map(len, b)])
        # The links of text i are those from links[i] on, the groups those from groups[i] on.
        stops = np.concatenate([[0], self.ends_a])[self.texts_a]
        self.links = np.searchsorted(ends, stops, side="right")
        self.groups = np.searchsorted(self.shared, stops, side="right")

    def sums(self, values: np.ndarray) -> np.ndarray:
        """``values`` of the links, summed for each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.links[1:]] - total[self.links[:-1]]

    def spelled(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` for each text: its groups with the ids of A and of B."""
        ends_a, ends_b = self.upto_a, self.upto_b
        size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        # Places of the ids where each group has its A ids, then its B ids.
        place_a = np.arange(len(self.a)) + np.repeat(ends_b - size_b, size_a)
        place_b = np.arange(len(self.b)) + np.repeat(ends_a, size_b)
        ids, mark = np.empty(len(self.a) + len(self.b), dtype=np.int64), np.zeros(len(self.a) + len(self.b), dtype=np.int8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[ends_a - 1]], mark[place_b[ends_b - 1]] = 1, 2
        stops = self.texts_a + self.texts_b
        mark[stops[1:][np.diff(stops) > 0] - 1] = 3
        codes, (letters, lengths) = ids * 4 + mark, _spelled()
        text = letters[codes].view(np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths[codes], dtype=np.int64)])[stops]
        kinds = pa.large_string(), pa.py_buffer(offsets), pa.py_buffer(text[text != 0])
        return pa.Array.from_buffers(kinds[0], len(stops) - 1, [None, *kinds[1:]]).cast(pa.string())


@cache
def _spelled() -> tuple[np.ndarray, np.ndarray]:
    """Ids below 2**16 as decimals, each with each mark behind it: eight bytes, zeros behind, and how many are none."""
    spelled = np.array([f"{i}{mark}" for i in range(1 << 16) for mark in (",", "|", ";", "")], dtype="S8")
    return spelled.view(np.uint64), np.strings.str_len(spelled)


_KNOWN: dict[str, Vocabularies] = {}
_TABLES: dict[str, tuple] = {}


def _kept(store: dict, key: str, make):
    """What this worker has under ``key``; one is remembered."""
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2") for x in column.to_pylist()]


def _slices(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of a megabyte or two of ``columns``, one row at least."""
    size = sum(_lengths(batch[c]) for c in columns)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // RESULT_BYTES, prepend=0))
    for a, b in zip([0, *cut], [*cut, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def tokenized(docs: DataFrame, key: str, sent) -> DataFrame:
    """row (a number of its own), doc_id, a, b (ids as little-endian 16 bits) of every row, written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _kept(_KNOWN, key, lambda: Vocabularies(*sent.value))
        for batch in nonempty(batches):
            for some in _slices(batch, ("text",)):
                pairs = [[x.astype("<u2").tobytes() for x in both] for both in known.ids(texts(some["text"]))]
                a, b = (pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1))
                columns = {"doc_id": some["doc_id"], "a": a, "b": b}
                yield pa.record_batch(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(cut, "doc_id long, a binary, b binary")
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def hashed(tokens: DataFrame, sizes, shard: int) -> tuple[DataFrame, int]:
    """(shard, sizes, words, pairs) of the distinct pairs' hashes, written, and the number of shards."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in nonempty(batches):
            for some in _slices(batch, ("a", "b")):
                seen = np.union1d(seen, Aligned(sizes.value, _ids(some["a"]), _ids(some["b"])).pairs)
                if len(seen) > LOT:
                    yield pa.record_batch({"pair": seen})
                    seen = seen[:0]
        yield pa.record_batch({"pair": seen})

    pairs = written(tokens.select("a", "b").mapInArrow(distinct, "pair long").distinct())
    shards = max(1, -(-pairs.count() // shard))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            pair = batch["pair"].to_numpy()
            yield pa.record_batch({"shard": pa.array(shard_of(pair, shards), pa.int32()), "pair": pair})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, p) for batch in nonempty(batches) for s, p in zip(*(c.to_pylist() for c in batch.columns)))
        for number, some in groupby(rows, key=lambda r: r[0]):
            sizes, words, ordered = built(np.array([p for _, p in some], dtype=np.int64))
            yield pa.record_batch(
                {
                    "shard": pa.array([number], pa.int32()),
                    "n": pa.array([len(ordered)], pa.int32()),
                    "sizes": pa.array([sizes.tobytes()], pa.binary()),
                    "words": pa.array([words.tobytes()], pa.binary()),
                    "pairs": pa.array([ordered.tobytes()], pa.binary()),
                }
            )

    dealt = pairs.mapInArrow(deal, "shard int, pair long").repartition("shard").sortWithinPartitions("shard", "pair")
    return written(dealt.mapInArrow(build, "shard int, n int, sizes binary, words binary, pairs binary")), shards


def lots(hashes: DataFrame, lot: int) -> list[list[int]]:
    """The shards, dealt into lots of at most ``lot`` pairs (one shard at least)."""
    found, size = [[]], 0
    for number, n in hashes.select("shard", "n").orderBy("shard").toLocalIterator():
        if found[-1] and size + n > lot:
            found.append([])
            size = 0
        found[-1].append(number)
        size += n
    return [x for x in found if x]


def _table(rows: list, shards: int) -> Table:
    arrays = lambda name, kind: [np.frombuffer(bytes(r[name]), dtype=kind) for r in rows]
    return Table(shards, [r["shard"] for r in rows], arrays("sizes", np.int64), arrays("words", np.uint64), arrays("pairs", np.int64))


def added(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(shard, n, at, counts) summed over equal ``by``, in one pass over sorted rows: a task holds one vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in nonempty(batches) for r in batch.to_pylist())
        for group, some in groupby(rows, key=lambda r: [r[c] for c in by]):
            total = None
            for row in some:
                total = np.zeros(row["n"], dtype=np.int64) if total is None else total
                counts = np.frombuffer(row["counts"], dtype=np.int64)
                if row["at"] is None:
                    total += counts
                else:
                    total[np.frombuffer(row["at"], dtype=np.int32)] += counts
            salt = group[1] if len(by) > 1 else 0
            yield _vector(group[0], salt, total)

    dealt = vectors.repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(add, "shard int, salt int, n int, at binary, counts binary")


def _vector(shard: int, salt: int, counts: np.ndarray) -> pa.RecordBatch:
    """A dense vector, or the indexes it has where that is shorter."""
    at = np.flatnonzero(counts).astype(np.int32)
    few = 3 * len(at) < 2 * len(counts)
    return pa.record_batch(
        {
            "shard": pa.array([shard], pa.int32()),
            "salt": pa.array([salt], pa.int32()),
            "n": pa.array([len(counts)], pa.int32()),
            "at": pa.array([at.tobytes() if few else None], pa.binary()),
            "counts": pa.array([(counts[at] if few else counts).tobytes()], pa.binary()),
        }
    )


def counted(tokens: DataFrame, hashes: DataFrame, shards: int, some: list[int], sizes) -> DataFrame:
    """(shard, n, at, counts) of the shards ``some``: the number of links of each pair, by index."""
    rows = hashes.where(F.col("shard").isin(some)).orderBy("shard").collect()  # a lot
    name, lot = uuid.uuid4().hex, tokens.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _kept(_TABLES, name, lambda: _table(lot.value, shards))
        counts = np.zeros(len(table), dtype=np.int64)
        for batch in nonempty(batches):
            for part in _slices(batch, ("a", "b")):
                at = table.find(Aligned(sizes.value, _ids(part["a"]), _ids(part["b"])).pairs)
                counts += np.bincount(at[at >= 0], minlength=len(table))
        salt = TaskContext.get().partitionId() % FAN  # the same when the task runs again
        for number, a, b in zip(table.numbers, table.starts, table.starts[1:]):
            if counts[a:b].any():
                yield _vector(number, salt, counts[a:b])

    vectors = tokens.select("a", "b").mapInArrow(count, "shard int, salt int, n int, at binary, counts binary")
    return added(added(vectors, ["shard", "salt"]), ["shard"])


def highest(counts: DataFrame, n_b: int) -> np.ndarray:
    """The highest count of each B id, from (pairs, at, counts)."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_b, dtype=np.int64)
        for batch in nonempty(batches):
            for row in batch.to_pylist():
                np.maximum.at(found, np.frombuffer(row["pairs"], dtype=np.int64) % n_b, _dense(row))
        b = np.flatnonzero(found)
        yield pa.record_batch({"b": pa.array(b, pa.int32()), "most": pa.array(found[b])})

    found = np.zeros(n_b, dtype=np.int64)
    rows = counts.select("n", "pairs", "at", "counts").mapInArrow(most, "b int, most long")
    for b, n in rows.groupBy("b").agg(F.max("most")).collect():  # as many as the vocabulary has entries
        found[b] = n
    return found


def _dense(row: dict) -> np.ndarray:
    counts = np.frombuffer(bytes(row["counts"]), dtype=np.int64)
    if row["at"] is None:
        return counts
    full = np.zeros(row["n"], dtype=np.int64)
    full[np.frombuffer(bytes(row["at"]), dtype=np.int32)] = counts
    return full


def looked_up(tokens: DataFrame, rows: list, shards: int, most: np.ndarray, sizes) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every text, for the pairs of ``rows`` alone."""
    name = uuid.uuid4().hex
    lot = tokens.sparkSession.sparkContext.broadcast(([r.asDict() for r in rows], most))

    def make() -> tuple[Table, np.ndarray, np.ndarray]:
        found, best = lot.value
        return _table(found, shards), np.concatenate([np.zeros(0, np.int64), *map(_dense, found)]), best

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, best = _kept(_TABLES, name, make)
        counts = np.append(counts, 0)  # pairs of other lots: index -1
        for batch in nonempty(batches):
            for some in _slices(batch, ("a", "b")):
                aligned = Aligned(sizes.value, _ids(some["a"]), _ids(some["b"]))
                found = counts[table.find(aligned.pairs)]
                top = (found > 0) & (found == best[aligned.link_b])
                columns = {
                    "n_a": np.diff(aligned.texts_a), "n_b": np.diff(aligned.texts_b), "n_groups": np.diff(aligned.groups),
                    "n_links": np.diff(aligned.links), "n_best": aligned.sums(top), "count_sum": aligned.sums(found),
                }
                columns = {n: pa.array(v, pa.int64()) for n, v in columns.items()}
                yield pa.record_batch({"row": some["row"], "doc_id": some["doc_id"], **columns, "groups": aligned.spelled()})

    names = ", ".join(f"{n} long" for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return tokens.select("row", "doc_id", "a", "b").mapInArrow(look, f"{names}, groups string")


def align(docs: DataFrame, byte_level: str, pattern: str, pieces: str, shard: int = SHARD, lot: int = LOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of ``docs`` (doc_id, text).

    ``byte_level`` and ``pieces`` are paths of a byte-level BPE file of the tokenizers library and of a sentencepiece model,
    read by the driver alone. n_best: links whose count is the highest of their B id; count_sum: the counts of the
    links, summed; groups: ``a1,a2|b1;a3|b2,b3``, the ids of each group.
    """
    spark = bounded(docs.sparkSession)
    with open(byte_level, encoding="utf-8") as file, open(pieces, "rb") as model:
        contents = file.read(), pattern, model.read()
    known = Vocabularies(*contents).sizes
    if max(map(len, known)) > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    sizes, n_b = spark.sparkContext.broadcast(known), len(known[1])
    tokens = tokenized(docs, uuid.uuid4().hex, spark.sparkContext.broadcast(contents))
    hashes, shards = hashed(tokens, sizes, shard)
    dealt = lots(hashes, lot)
    summed = None
    for some in dealt:
        part = counted(tokens, hashes, shards, some, sizes)
        summed = part if summed is None else summed.unionByName(part)
    if summed is None:  # no link anywhere
        return looked_up(tokens, [], shards, np.zeros(n_b, np.int64), sizes).drop("row")
    counts = written(hashes.join(summed.select("shard", "at", "counts"), "shard"))
    most = highest(counts, n_b)
    parts = [
        looked_up(tokens, counts.where(F.col("shard").isin(some)).orderBy("shard").collect(), shards, most, sizes)
        for some in dealt
    ]
    found = parts[0]
    if len(parts) > 1:  # a link has its count in one of the lots
        sums = [p.select("row", "n_best", "count_sum") for p in parts[1:]]
        rest = sums[0]
        for more in sums[1:]:
            rest = rest.unionByName(more)
        rest = rest.groupBy("row").agg(F.sum("n_best").alias("__best"), F.sum("count_sum").alias("__sum"))
        found = found.join(rest, "row").withColumns({"n_best": F.col("n_best") + F.col("__best"), "count_sum": F.col("count_sum") + F.col("__sum")})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
