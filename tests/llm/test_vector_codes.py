import hashlib
import math

import numpy as np
import pytest

from reviewloom.llm import vector_codes
from reviewloom.llm.queries import REGISTRY

SCHEMA = "vec_id long, embedding array<float>, label int, code string, extra string"


def brute(rows, parts=8, entries=16, rounds=6):
    """[(vec_id, code, error, label)], books; in Python's own integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(r[0], [math.floor(4096 * float(np.float32(x))) for x in r[1]], r[2]) for r in kept]
    packed = lambda v: np.array(v, dtype="<i4").tobytes()
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, packed(r[1])))
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    width = -(-len(whole[0][1]) // parts) if whole else 0
    cut = [[(v + [0] * parts * width)[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            near = [best(p, c[p]) for c in cut]
            books[p] = [
                [sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [c[p] for c, n in zip(cut, near) if n == e]) else books[p][e]
                for e in range(len(books[p]))
            ]
    out = []
    for (i, _, label), c in zip(whole, cut, strict=True):
        code = [best(p, c[p]) for p in range(parts)]
        out.append((i, bytes(code), sum(far(c[p], books[p][e]) for p, e in enumerate(code)), label))
    return out, books


def vectors(seed, n, size, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, spread, (5, size))
    found = centres[r.integers(0, 5, n)] + r.normal(0, spread / 8, (n, size))
    return [[float(np.float32(x)) for x in v] for v in found]


def agree(spark, rows, **more):
    df = spark.createDataFrame([(*r, "c", "x") for r in rows], SCHEMA).repartition(3)
    got = vector_codes.compress(df, carried=("label", "code"), **more)
    want, books = brute(rows, **{k: v for k, v in more.items() if k != "cell"})
    assert got.books.tolist() == books or not books[0]
    bag = sorted((repr(r.vec_id), bytes(r.code), r.error, repr(r.label)) for r in got.rows.collect())
    assert bag == sorted((repr(i), c, e, repr(x)) for i, c, e, x in want)
    return got


def test_odd_rows(spark):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors(1, 60, 16))]
    nan, inf = float("nan"), float("inf")
    rows += [(-1, None, 1), (-2, [], 1), (-3, [nan] + [0.0] * 15, 1), (-4, [None] + [0.0] * 15, 1), (-5, [-inf] + [0.0] * 15, 1)]
    rows += [(70, [0.0] * 3, 1), (None, rows[0][1], None), (None, rows[5][1], 2), (3, rows[9][1], 1), (4, rows[4][1], 1), (4, rows[4][1], 1)]
    agree(spark, rows)
    agree(spark, rows, cell=7)
    agree(spark, rows[:5])  # fewer vectors than entries
    agree(spark, [(i, v, 1) for i, v in enumerate(vectors(2, 40, 11))], parts=4, entries=5, rounds=3)


def test_nothing_to_compress(spark):
    for rows in ([], [(1, None, 1, "c", "x"), (2, [], None, "c", "x")]):
        got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), carried=("label",))
        assert got.rows.count() == 0 and got.rows.columns == ["vec_id", "label", "code", "error"]
        assert vector_codes.label_errors(got.rows).count() == 0


def test_large_components(spark):
    rows = [(i, [x * 3e4 for x in v], 1) for i, v in enumerate(vectors(3, 30, 8))]
    agree(spark, rows, entries=4)
    huge = vector_codes.compress(spark.createDataFrame([(i, [s * 3e38] * 8, 1, "", "") for i, s in ((1, 1.0), (2, -1.0))], SCHEMA), entries=1)
    assert [r.error for r in huge.rows.collect()] == [vector_codes.MOST] * 2


def test_ties_go_to_the_first_entry(spark):
    rows = [(0, [0.0] * 8, 1), (1, [2.0] * 8, 1), (2, [1.0] * 8, 1), (3, [1.0] * 8, 1)]
    got = agree(spark, rows, entries=2, rounds=0)
    assert {r.vec_id: bytes(r.code) for r in got.rows.collect()}[2] == bytes(8)


@pytest.mark.parametrize("cell", [1, 50, 4096])
def test_cells_keep_every_nearest_entry(cell, monkeypatch):
    r = np.random.default_rng(cell)
    books = r.integers(-3000, 3000, (2, 16, 4))
    rows = np.concatenate([r.integers(-4000, 4000, (500, 2, 4)), books.transpose(1, 0, 2), np.zeros((3, 2, 4), np.int64)])
    monkeypatch.setattr(vector_codes, "REMEMBERED", 40)
    grid = vector_codes.Grid(books, cell)
    for _ in range(2):
        for part in range(2):
            code, far = grid.nearest(part, np.ascontiguousarray(rows[:, part]))
            every = ((rows[:, part, None] - books[part][None]) ** 2).sum(axis=2)
            assert np.array_equal(code, every.argmin(axis=1)) and np.array_equal(far, every.min(axis=1))
    grid.odd = np.zeros(4, np.uint64)  # all cells have one hash
    assert np.array_equal(grid.nearest(0, np.ascontiguousarray(rows[:, 0]))[1], ((rows[:, 0, None] - books[0][None]) ** 2).sum(axis=2).min(axis=1))


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, books = brute(rows)
    text = ",".join(str(x) for part in books for entry in part for x in entry)
    digest, sums = hashlib.sha256(text.encode()).hexdigest(), {}
    for _, _, e, label in want:
        sums[label] = sums.get(label, 0) + e
    got = REGISTRY["op12_vector_codes"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted((i, c.hex(), e, sums[label], digest) for i, c, e, label in want)
