import random

import numpy as np
import pytest

from reviewloom.llm import decontaminate as d


def least_edits(piece, text):
    row = np.zeros(len(text) + 1, dtype=int)
    letters = np.array(list(text))
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(piece, 1):
        now = np.empty_like(row)
        now[0] = i
        now[1:] = np.minimum(row[:-1] + (letters != c), row[1:] + 1)
        row = np.minimum.accumulate(now - steps) + steps
    return int(row.min())


def prose(r, n):
    return " ".join("".join(r.choice("abcdeist") for _ in range(r.randrange(2, 8))) for _ in range(n))


def edited(r, text, n):
    for _ in range(n):
        x, kind = r.randrange(len(text)), r.randrange(3)
        text = text[:x] + ("" if kind == 0 else r.choice("abcxyz")) + text[x + (kind < 2) :]
    return text


@pytest.mark.parametrize("block", [1 << 18, 97])
def test_search_against_whole_tables(monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK", block)
    r = random.Random(5)
    items = [(i, d.normal(prose(r, r.choice([6, 12, 25, 60])))) for i in range(12)]
    pieces = d.Pieces(items)
    for _ in range(120):
        item, text = r.choice(items)
        body = edited(r, text, r.randrange(0, len(text) // 8 + 2))
        doc = d.normal(f"{prose(r, r.randrange(0, 40))} {body} {prose(r, r.randrange(0, 40))}")
        got = pieces.best(doc)
        for i, _ in items:
            own = np.flatnonzero(pieces.items == i)
            edits = {int(p): least_edits("".join(map(chr, pieces.codes[p])), doc) for p in own}
            fits = [e / pieces.m[p] for p, e in edits.items() if e <= pieces.k[p]]
            assert (i in got) == bool(fits)
            if fits:
                assert got[i][0] == pytest.approx(min(fits))


def test_rows(spark, documents):
    r = random.Random(9)
    items = [(i, prose(r, 20)) for i in range(6)]
    items += [(6, items[0][1]), (7, None), (8, "too short"), (9, ""), (None, prose(r, 20)), (10, prose(r, 200))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = [
        (1, items[0][1].upper().replace(" ", "\n ")), (2, prose(r, 300)), (3, None), (4, ""), (5, items[3][1][:-2]),
        (None, items[1][1]), (6, "long " * 90_000 + items[2][1] + " tail" * 90_000), (7, items[4][1]), (7, items[4][1]),
        (8, items[-1][1][300:700]), (9, "too short"), (10, items[2][1] + " and " + items[3][1]),
    ]
    docs = documents(rows)
    for lot in (4_000_000, 150):
        got = sorted((repr(x.doc_id), x.item_id) for x in d.leaks(docs, bench, lot=lot).collect())
        want = [(1, 0), (5, 3), (None, 1), (6, 2), (7, 4), (7, 4), (8, 10), (10, 2), (10, 3)]
        assert got == sorted((repr(a), b) for a, b in want)
        clean = d.clean(docs, bench, lot=lot)
        assert clean.columns == docs.columns and sorted(x.doc_id for x in clean.collect()) == [2, 3, 4, 9]
    assert d.leaks(documents([]), bench).count() == 0
    assert d.leaks(docs, bench.limit(0)).count() == 0 and d.clean(docs, bench.limit(0)).count() == len(rows)


def test_query_finds_every_exact_passage(spark, sf_dir):
    from reviewloom.llm.queries import REGISTRY

    docs = {r.doc_id: d.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: d.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(i, j) for i, t in docs.items() for j, x in items.items() if len(x) >= d.SHORTEST and x in t}
    got = {(r.doc_id, r.item_id): r for r in REGISTRY["op2_decontamination"](spark, sf_dir).collect()}
    assert exact and exact <= set(got) and all(got[k].edits == 0 for k in exact)


def test_no_occurrence_within_the_budget_is_missed():
    rng = random.Random(8)
    for m in range(25, 65):
        item = "".join(rng.choice("abcdefghij ") for _ in range(m)).replace("  ", "xy").strip().ljust(m, "z")
        pieces = d.Pieces([(1, item)])
        k = int(pieces.k[0])
        assert pieces.bound.min() >= 1
        # Edits spread evenly leave the shortest runs of letters untouched.
        edited = list(item)
        for i in range(k):
            edited[(i + 1) * m // (k + 1) - 1] = "#"
        found = list(pieces.search("some text before " + "".join(edited) + " and after"))
        assert found and min(edits for _, edits, _, _ in found) <= k, (m, k)


def test_items_without_an_id(spark):
    text = "what is the capital of the country where the river ends"
    items = spark.createDataFrame([(None, text), (None, text[::-1]), (4, "another question which no document has in it")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so: {text}?"), (2, text[::-1]), (3, "nothing of the kind")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in d.leaks(docs, items).collect())
    assert got == [(1, None, 0), (2, None, 0)]
    assert [r.doc_id for r in d.clean(docs, items).collect()] == [3]
