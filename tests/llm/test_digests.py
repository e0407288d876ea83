import hashlib

import numpy as np
import pytest
import xxhash

from reviewloom.llm import digests


def want(rows):
    """(doc_id, n_chars, edited hash) in order, the plain way."""
    digest = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    texts = [t or "" for _, t in rows]
    out = []
    for (doc, _), own, after in zip(rows, texts, texts[1:] + texts[:1]):
        quarter = len(own) // 4
        changed = own[: len(own) - quarter] + after[:quarter]
        a, b, c = (digests.Digests([t.encode()]) for t in (own, changed, after))
        out.append(
            (doc, len(own), hashlib.sha256(changed.encode()).hexdigest(), a.hex()[0], b.hex()[0],
             float(a.likeness(b)[0]), float(a.likeness(c)[0]))
        )
    return out


ROWS = [
    (5, "one two three four five six seven eight"), (1, "é" * 41), (2, ""), (3, None), (9, "ab"), (4, "漢字かな" * 20),
    (7, "same"), (7, "same"), (7, "other"), (7, None), (6, "long words " * 5000), (None, "no id"), (None, "none either"), (8, "x" * 3),
]


def key(row):
    return tuple((x is None, x or 0) if isinstance(x, int | None) else (False, x) for x in row)


@pytest.mark.parametrize("partitions", [1, 4])
def test_neighbours(spark, documents, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = [tuple(r) for r in digests.neighbours(documents(ROWS)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(got, key=key) == sorted(want(ROWS), key=key)


def test_small_tables(documents):
    assert digests.neighbours(documents([])).count() == 0
    row = digests.neighbours(documents([(1, "alone here")])).first()
    assert (row.near_edited, row.near_next) == (digests.Digests([b"alone hereal"[:10]])[[0]].likeness(
        digests.Digests([digests.edited("alone here", "alone here").encode()]))[0], 1.0)


def test_digests_of_one_text_do_not_depend_on_others():
    parts = [b"", b"a", b"abcdefghi", b"abc" * 900, b"\x00" * 20, bytes(range(256)) * 30_000]
    together = digests.Digests(parts).hex()
    assert together == [digests.Digests([p]).hex()[0] for p in parts]
    assert len(set(together)) == len(parts)


def test_an_edit_is_nearer_than_another_text(spark, sf_dir):
    from reviewloom.llm.queries import REGISTRY

    rows = REGISTRY["op3_fingerprints"](spark, sf_dir).collect()
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows if r.near_next < 1) >= 0.99 * sum(r.near_next < 1 for r in rows)
