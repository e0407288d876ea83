"""Compression of vectors into codes: each of ``parts`` parts becomes the number of its nearest codebook entry.

A component x becomes the integer floor(scale * x). Codebooks start as the parts of the vectors with the least ids and
move ``rounds`` times to the componentwise floor(sum / count) of the parts nearest to them; an entry that is nearest to
none stays. All arithmetic is exact, so a rerun on any cluster gives the same codes.

The nearest entry is found through memoised grid cells. A part lies in a coarse cell of ``cell`` integers a side; cells are
looked up by their hash and verified by their coordinates. For a new cell the least and the greatest distance of
every entry to its box are worked out once: an entry whose least distance is above another's greatest one is nowhere
nearest in the box. The others are remembered with the cell, and only they are compared with the part itself. What
a worker remembers is bounded and belongs to one codebook.

Rows whose vector is null, is empty, or holds null or non-finite components are left out, and so are those whose length
isn't that of the kept vector with the least id. A length that ``parts`` does not divide is filled up with zeros. Integers
beyond 32 bits become the nearest 32-bit ones, errors beyond 64 bits the greatest 64-bit one. Vectors with equal ids, or
with none (last), go by their components; repeated rows count as often as they come.

The table is read once and kept as integers in the shared folder; every round reads that. A task hands on sums by entry
and component, whose number the codebooks bound, and only the codebooks pass through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import bounded, nonempty, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CELL = 128
#: Cells of a part that a worker remembers at most, and rows it works on at once.
REMEMBERED, ROWS = 1 << 16, 4096
#: Up to this size sums of squares over a part fit 64 bits; larger ones are worked out in Python's own integers.
NARROW = 1 << 24
MOST = 2**63 - 1


def integers(column: pa.Array, scale: int) -> list[bytes | None]:
    """floor(scale * x) of each vector as 32-bit integers, None for a vector that is left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * scale)
    whole = np.clip(np.nan_to_num(scaled), -(2**31), 2**31 - 1).astype("<i4")
    # A product that overflows is finite as a component.
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(sizes)
    return [whole[e - n : e].tobytes() if n and wrong[e] == wrong[e - n] else None for n, e in zip(sizes, ends)]


def prepared(vectors: DataFrame, ids: str, vector: str, carried: list[str], scale: int) -> DataFrame:
    """__id, __ints (little-endian 32-bit integers) and the carried columns of the vectors that stay, written."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            ints = pa.array(integers(batch["__vector"], scale), pa.binary())
            stays = ints.is_valid()
            columns = {"__id": batch["__id"], "__ints": ints} | {n: batch[n] for n in carried}
            yield pa.record_batch(columns).filter(stays)

    rows = vectors.select(F.col(ids).alias("__id"), F.col(vector).alias("__vector"), *carried)
    schema = rows.select("__id", F.lit(b"").alias("__ints"), *carried).schema
    return written(rows.mapInArrow(convert, schema))


def matrix(column: pa.Array, length: int, parts: int) -> np.ndarray:
    """Vectors of one length as (rows, parts, width), filled up with zeros."""
    width = -(-length // parts)
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, length)
    out = np.zeros((len(raw), parts * width), dtype=np.int64)
    out[:, :length] = raw
    return out.reshape(-1, parts, width)


class Grid:
    """The nearest entries of one set of codebooks, by remembered cells."""

    def __init__(self, books: np.ndarray, cell: int):
        self.books, self.cell = books, cell  # (parts, entries, width)
        self.narrow = not books.size or int(np.abs(books).max()) <= NARROW
        self.known: list[dict[int, tuple[bytes, np.ndarray]]] = [{} for _ in books]
        odd = np.random.default_rng(0).integers(0, 1 << 63, books.shape[2], dtype=np.uint64)
        self.odd = odd * np.uint64(2) + np.uint64(1)

    def undominated(self, part: int, cells: np.ndarray) -> np.ndarray:
        """(cells, entries): whether an entry can be nearest anywhere in the box of a cell."""
        low = (cells * self.cell)[:, None, :]
        high = low + (self.cell - 1)
        entries = self.books[part][None]
        least = np.maximum(np.maximum(low - entries, entries - high), 0)
        most = np.maximum(np.abs(entries - low), np.abs(entries - high))
        least, most = (least * least).sum(axis=2), (most * most).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def candidates(self, part: int, rows: np.ndarray) -> np.ndarray:
        """(rows, entries): the entries to compare each row with."""
        cells = rows // self.cell
        hashes = (cells.view(np.uint64) * self.odd).sum(axis=1, dtype=np.uint64)
        names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        own = cells[first]
        if not np.array_equal(own[which], cells):  # two cells with one hash
            own, which = np.unique(cells, axis=0, return_inverse=True)
            return self.undominated(part, own)[which.ravel()]
        known = self.known[part]
        if len(known) + len(names) > REMEMBERED:
            known.clear()
        keys, places = names.tolist(), [c.tobytes() for c in own]
        found = [known.get(k) for k in keys]
        new = [i for i, (f, p) in enumerate(zip(found, places, strict=True)) if f is None or f[0] != p]
        if new:
            for i, mask in zip(new, self.undominated(part, own[new]), strict=True):
                found[i] = known[keys[i]] = (places[i], mask)
        return np.stack([f[1] for f in found])[which]

    def nearest(self, part: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first nearest entry of each row, and its squared distance."""
        if not self.narrow or int(np.abs(rows).max()) > NARROW:
            apart = rows.astype(object)[:, None, :] - self.books[part].astype(object)[None]
            every = (apart * apart).sum(axis=2)
            best = np.array([min(range(len(r)), key=r.__getitem__) for r in every.tolist()], dtype=np.int64)
            return best, every[np.arange(len(rows)), best]
        at, entry = np.nonzero(self.candidates(part, rows))
        apart = rows[at] - self.books[part][entry]
        far = (apart * apart).sum(axis=1)
        starts = np.searchsorted(at, np.arange(len(rows)))
        least = np.minimum.reduceat(far, starts)
        first = np.minimum.reduceat(np.where(far == least[at], entry, len(self.books[part])), starts)
        return first, least

    def assign(self, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray]]]:
        """Pieces of ``rows`` (rows, parts, width), the code of each row (rows, parts) and its distances by part."""
        for start in range(0, len(rows), ROWS):
            piece = slice(start, min(start + ROWS, len(rows)))
            found = [self.nearest(p, np.ascontiguousarray(rows[piece, p])) for p in range(rows.shape[1])]
            yield piece, np.stack([f[0] for f in found], axis=1), [f[1] for f in found]


_GRIDS: dict[str, Grid] = {}


def _grid(key: str, books: np.ndarray, cell: int) -> Grid:
    """The worker's grid of these codebooks; one is remembered."""
    if key not in _GRIDS:
        _GRIDS.clear()
        _GRIDS[key] = Grid(books, cell)
    return _GRIDS[key]


def moved(rows: DataFrame, books: np.ndarray, length: int, cell: int) -> np.ndarray:
    """The codebooks after one round over ``rows`` (__ints)."""
    parts, entries, width = books.shape
    key = uuid.uuid4().hex

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = _grid(key, books, cell)
        sums = np.zeros(books.shape, dtype=np.int64)  # 32-bit integers of up to 2**31 rows
        counts = np.zeros((parts, entries), dtype=np.int64)
        for batch in nonempty(batches):
            x = matrix(batch["__ints"], length, parts)
            for piece, codes, _ in grid.assign(x):
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, starts = np.unique(codes[order, p], return_index=True)
                    sums[p, used] += np.add.reduceat(x[piece, p][order], starts, axis=0)
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        slot = np.flatnonzero(np.repeat(counts.ravel(), width))
        n = np.repeat(counts.ravel(), width)[slot]
        yield pa.record_batch({"slot": pa.array(slot, pa.int32()), "n": pa.array(n), "s": pa.array(sums.ravel()[slot])})

    every = rows.select("__ints").mapInArrow(tally, "slot int, n long, s long")
    total = every.groupBy("slot").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    after = books.copy().ravel()
    for slot, n, s in total.collect():  # parts * entries * width rows at most
        after[slot] = int(s) // n
    return after.reshape(books.shape)


@dataclass(frozen=True)
class Compressed:
    """``rows``: the kept vectors' id and carried columns, ``code`` (the entries in part order, a byte each) and ``error``
    (squared distances summed over the parts). ``books``: the final entries by part, entry and component."""

    rows: DataFrame
    books: np.ndarray


def compress(
    vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding", carried: tuple[str, ...] = (), parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, cell: int = CELL,
) -> Compressed:
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number is a byte")
    bounded(vectors.sparkSession)
    carried = [c for c in carried if c not in ("code", "error")]
    rows = prepared(vectors, ids, vector, carried, scale)
    first = [F.col("__id").asc_nulls_last(), F.hex("__ints")]
    start = rows.orderBy(*first).select("__ints").head(1)
    length = len(start[0][0]) // 4 if start else 0
    rows = rows.where(F.octet_length("__ints") == 4 * length)
    seeds = [bytes(r[0]) for r in rows.orderBy(*first).select("__ints").head(entries)]
    books = matrix(pa.array(seeds, pa.binary()), length, parts) if seeds else np.zeros((0, parts, 1), np.int64)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    for _ in range(rounds if seeds else 0):
        after = moved(rows, books, length, cell)
        if np.array_equal(after, books):
            break  # further rounds change nothing
        books = after
    key = uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = _grid(key, books, cell)
        for batch in nonempty(batches):
            codes, errors = [], []
            for _, code, far in grid.assign(matrix(batch["__ints"], length, parts)):
                codes += [c.tobytes() for c in code.astype(np.uint8)]
                errors += [min(sum(e), MOST) for e in zip(*[f.tolist() for f in far], strict=True)]
            columns = {ids: batch["__id"]} | {n: batch[n] for n in carried}
            columns |= {"code": pa.array(codes, pa.binary()), "error": pa.array(errors, pa.int64())}
            yield pa.record_batch(columns)

    shape = rows.select(F.col("__id").alias(ids), *carried, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    return Compressed(rows.mapInArrow(encode, shape.schema), books)


def label_errors(rows: DataFrame, label: str = "label", spread_by: str = "vec_id") -> DataFrame:
    """``rows`` with label_error, the errors summed over equal labels (nulls together).

    A hot label's rows stay in many tasks: they are summed in each task first, and get the sum back by salted keys.
    """
    salts = 16
    sums = rows.groupBy(F.col(label).alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum"))
    most = F.lit(MOST).cast("decimal(38,0)")
    sums = sums.withColumn("label_error", F.least("__sum", most).cast("long")).drop("__sum")
    sums = sums.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts)))))
    salt = F.pmod(F.xxhash64(spread_by, "code"), F.lit(salts)).cast("int")
    rows = rows.withColumn("__own", salt)
    met = rows.join(sums, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__own") == F.col("__salt")))
    return met.drop("__label", "__own", "__salt")


def codebook_text(books: np.ndarray) -> str:
    """All entries' components as decimal integers, by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def codes_sql() -> str:
    """The same in DuckDB: every part is compared with every entry of its codebook, round by round."""
    nearest = """
n{r} AS MATERIALIZED (
  SELECT rid, part, min_by(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT x.rid, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c USING (part, pos) GROUP BY ALL)
  GROUP BY ALL)"""
    move = """
c{after} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce((s - ((s % n) + n) % n) // n, c.v)::bigint AS v
  FROM c{r} c LEFT JOIN (
    SELECT part, entry, pos, sum(v)::hugeint AS s, count(*)::hugeint AS n FROM x JOIN n{r} USING (rid, part) GROUP BY ALL) m
  USING (part, entry, pos))"""
    rounds = "".join(f",{nearest.format(r=r)},{move.format(r=r, after=r + 1)}" for r in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
flat AS (
  SELECT rid, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS width FROM kept),
x AS MATERIALIZED (
  SELECT rid, i // width AS part, i % width AS pos, floor({SCALE}.0::double * e::double)::bigint AS v FROM flat),
c0 AS MATERIALIZED (SELECT part, rid AS entry, pos, v FROM x WHERE rid < {ENTRIES}){rounds},
{nearest.format(r=ROUNDS).strip()},
coded AS (
  SELECT rid, string_agg(printf('%02x', entry::int), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM n{ROUNDS} GROUP BY rid),
books AS (SELECT sha256(string_agg(v::varchar, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), books"""
