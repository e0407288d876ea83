import math
import re

import pytest

from reviewloom.llm import mixing


def shares(sizes, budget=1.5, epochs=2):
    """Targets by sharing what is left again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, stopped = budget * sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        weights = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / weights for s in open_}
        above = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not above:
            return {s: float(epochs * sizes[s]) if s in stopped else share[s] for s in names}
        stopped |= above


def run(documents, rows, block=mixing.BLOCK):
    return mixing.mix(mixing.sized(documents(rows)), block).collect()


def check(rows, got, slack):
    sizes, by = {}, {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = shares(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        by[r.source] = by.get(r.source, 0) + r.taken
    for source, taken in by.items():
        assert abs(taken - want[source]) <= slack


ROWS = [(i, "w " * (i % 37), None, ["a", "b", "é", "Z", None][i % 5 if i % 3 else 0]) for i in range(400)]


def test_targets_and_taken(documents):
    check(ROWS, run(documents, ROWS), 3 * mixing.BLOCK)
    check(ROWS, run(documents, ROWS, 5), 15)


def test_reruns_agree(documents):
    plain = lambda rows: sorted((r.doc_id, r.size, r.taken) for r in rows)
    assert plain(run(documents, ROWS)) == plain(run(documents, list(reversed(ROWS))))


def test_odd_rows(documents):
    rows = [(None, "a b c\x0bd", None, "s"), (1, None, None, "s"), (2, "", None, None), (3, "word " * 70_000, None, "t"), (3, "word " * 70_000, None, "t"), (4, "x", None, "t"), (4, "x", None, "u")]
    check(rows, run(documents, rows), 3 * mixing.BLOCK)
    assert run(documents, []) == []
    nothing = run(documents, [(1, "", None, "a"), (2, None, None, "b")])
    assert [(r.target, r.taken) for r in nothing] == [(0, 0), (0, 0)]


def test_schedule_spreads_every_source(spark, documents):
    sizes = mixing.sized(documents(ROWS))
    sources = mixing.targets(sizes)
    slots = sorted((r.slot, r.sid, r.rank) for r in mixing.schedule(sources, 4).collect())
    share = {r.sid: r.hi - r.lo for r in sources.collect()}
    assert [s for s, _, _ in slots] == list(range(len(slots)))
    seen: dict = {}
    for slot, sid, rank in slots:
        assert rank == seen.get(sid, 0)
        seen[sid] = rank + 1
        for s, n in seen.items():  # every beginning of the schedule is near the shares
            assert abs(n - share[s] * (slot + 1)) <= 3 + math.log2(slot + 1) / 2


def test_rows_keep_their_columns_and_go_where_nothing_is_taken(documents):
    rows = ROWS + [ROWS[7], ROWS[7]]
    docs = documents(rows)
    got = mixing.mixed(docs)
    assert got.columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken", "taken_by_turn"]
    all_of_them = mixing.mix(mixing.sized(docs)).collect()
    gone = [r for r in all_of_them if r.size > 0 and r.taken == 0]
    assert gone and len(gone) < len(rows) / 2
    kept = got.collect()
    assert len(kept) == len(rows) - len(gone)
    assert sum(r.taken for r in kept) == sum(r.taken for r in all_of_them)
    for r in kept:
        assert len(r.taken_by_turn) == 2 and sum(r.taken_by_turn) == r.taken
        assert all(0 <= t <= r.size for t in r.taken_by_turn) and (r.taken or not r.size)
    texts = {repr((r.doc_id, r.text, r.source)) for r in docs.collect()}
    assert all(repr((r.doc_id, r.text, r.source)) in texts for r in kept)
