import random
import re

import numpy as np
import pytest
import xxhash

from reviewloom.llm import simhash
from reviewloom.llm.components import components


def fingerprint(text, words=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(values, bits=2):
    """For each value, the first index that it is connected with."""
    found = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits and found[i] != found[j]:
                a, b = sorted((found[i], found[j]))
                found = [a if f == b else f for f in found]
    return found


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO", "a b c", "É\x0bé\x0c x y z w", "x " * 3000, "a\x00b c d e"])
def test_fingerprints(text):
    assert simhash.majority(simhash.shingle_hashes(text.encode())) == fingerprint(text)


def near(seed, n, spread):
    """Fingerprints in clouds around a few centres."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(4)]
    return sorted({r.choice(centres) ^ sum(1 << r.randrange(spread) for _ in range(r.randrange(4))) for _ in range(n)})


@pytest.mark.parametrize("longest", [2048, 3])
def test_links_lose_no_component(spark, longest):
    values = near(1, 150, 64) + near(2, 150, 20)
    values = sorted({*values, 0, 1, 3, 7, 2**63, 2**64 - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.links(fps, longest=longest)
    for row in links.collect():
        assert ((row.u ^ row.v) & (2**64 - 1)).bit_count() <= 64
    stars = {r.u: r.v for r in components(links).collect()}
    got = [stars.get(v, v) for v in signed]
    want = connected(values)
    classes = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == label) for label in labels}
    assert classes(got) == classes(want)


def test_forest_is_no_larger_than_its_group():
    fps = np.arange(256, dtype=np.uint64)  # all within eight bits: one component by steps
    u, v = simhash.forest(np.zeros(256, np.int64), fps)
    assert len(u) == 255


def test_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


TEXTS = ["the quick brown fox jumps over the lazy dog again", "The Quick brown fox jumps over the lazy dog again", "", None, " ", "one", "two words", "x y " * 4000]


def test_odd_rows(documents):
    rows = [(10 - i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (10, TEXTS[0]), (None, "alone with no id")]
    got = simhash.classes(documents(rows)).collect()
    assert len(got) == len(rows)
    values = [fingerprint(t) for _, t in rows]
    want = connected(values)
    least = lambda i: min((rows[j][0] for j in range(len(rows)) if want[j] == want[i] and rows[j][0] is not None), default=None)
    expected = sorted((repr(rows[i][0]), f"{values[i]:016x}", repr(least(i))) for i in range(len(rows)))
    assert sorted((repr(r.doc_id), f"{r.fp & (2**64 - 1):016x}", repr(r.component_id)) for r in got) == expected
    kept = simhash.one_each(documents(rows))
    assert kept.columns == documents(rows).columns
    ids = sorted(repr(r.doc_id) for r in kept.collect())
    assert ids == sorted({repr(least(i)) for i in range(len(rows))})
    assert simhash.classes(documents([])).count() == 0 and simhash.one_each(documents([])).count() == 0


def test_rows_alike_in_id_and_text_leave_the_same_one(spark):
    rows = [(1, "a b c d", s) for s in ("q", "p", "r")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        assert [r.source for r in simhash.one_each(docs).collect()] == ["p"]


def test_query_against_brute_force(spark, sf_dir):
    from reviewloom.llm.queries import REGISTRY

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    values = [fingerprint(t) for _, t in docs]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in REGISTRY["op8_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {d[0]: (f"{v:016x}", docs[c][0]) for d, v, c in zip(docs, values, connected(values))}
