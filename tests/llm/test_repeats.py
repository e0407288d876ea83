import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import repeats
from reviewloom.llm.suffix_arrays import repeated_windows, suffix_order


def brute(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays():
    r = random.Random(3)
    for alphabet in (b"ab", b"a", b"ab\x00", bytes(range(256))):
        for n in (0, 1, 2, 9, 60, 300):
            text = bytes(r.choice(alphabet) for _ in range(n))
            assert suffix_order(np.frombuffer(text, np.uint8)).tolist() == sorted(range(n), key=lambda i: text[i:])


def test_repeated_windows():
    r = random.Random(4)
    for _ in range(100):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 60))) for _ in range(8)]
        width = r.choice([3, 5, 9])
        seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
        want = [seen[t[i : i + width]] > 1 for t in texts for i in range(len(t) - width + 1)]
        assert repeated_windows(texts, width)[0].tolist() == want
    assert repeated_windows([], 5)[0].tolist() == []


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_runs_meet_and_cover_all_windows(monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    r = random.Random(6)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 199, 200, 201, 700)] + [b"ab" * 400, b"x" * 600]
    texts.append(texts[4])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    text, first, count, key, run = repeats.Runs().cut(raw, np.cumsum([0, *map(len, texts)]))
    of, runs = {}, {}
    for t, f, c, k, d in zip(text.tolist(), first.tolist(), count.tolist(), key.tolist(), run.tolist()):
        assert c < 512 and runs.setdefault((k, d), texts[t][f : f + c + 199]) == texts[t][f : f + c + 199]
        for w in range(f, f + c):
            assert (t, w) not in of
            of[t, w] = k
            assert texts[t][w : w + 200] not in [texts[t][x : x + 200] for x in range(f, f + c) if x != w]
    assert set(of) == {(t, w) for t, x in enumerate(texts) for w in range(len(x) - 199)}
    keys: dict = {}
    for (t, w), k in of.items():
        assert keys.setdefault(texts[t][w : w + 200], k) == k


def corpus(r):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(70), prose(55)
    texts = [f"{prose(r.randrange(0, 90))} {passage} {prose(r.randrange(0, 90))}" for _ in range(40)]
    texts += [f"{passage[:150]} {passage[-250:]}{prose(20)}", other * 3, prose(400), prose(20), "a" * 900, "a" * 199]
    texts += ["é" * 150, "é" * 100, "the end " * 200, None, "", texts[3], texts[3], prose(30_000)]
    texts += [t[:400] + "X" + t[401:] for t in texts[:6]]
    return [(i if i % 11 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("shard", "longest"), [(2 << 20, 4096), (3000, 4)])
def test_rows_against_brute_force(documents, shard, longest):
    rows = corpus(random.Random(8))
    rows += [rows[5], rows[5]]
    got = repeats.report(documents(rows), shard=shard, longest=longest).collect()
    want = brute([(t or "").encode() for _, t in rows], 200)
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *w)) for (i, _), w in zip(rows, want))


def test_stripped_rows(documents):
    rows = corpus(random.Random(8))
    docs = documents(rows)
    got = repeats.stripped(docs)
    assert got.columns == docs.columns
    kept = sorted(repr(r.text) for r in got.collect())
    want = brute([(t or "").encode() for _, t in rows], 200)
    assert len(kept) == len(rows) and kept.count("None") == 1
    clean = [t for (_, t), w in zip(rows, want) if not w[1]]
    assert all(repr(t) in kept for t in clean)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_many_repeated_rows_have_their_ranges_once(spark, documents):
    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    rows = [(1, text)] * 3000 + [(2, "new " + text[:900] + " end"), (3, "x" * 150)]
    docs = documents(rows)
    found = repeats.spans(docs)[1].collect()
    assert len(found) == 2 and max(len(f["__ranges"]) for f in found) < len(text) / 10
    got = Counter((r.doc_id, r.n_removed) for r in repeats.report(docs).collect())
    assert got == {(1, len(text)): 3000, (2, 900): 1, (3, 0): 1}


def test_empty_table(documents):
    assert repeats.report(documents([])).count() == 0
    assert repeats.stripped(documents([])).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    from reviewloom.llm.queries import REGISTRY

    docs = sorted((r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(tuple(r) for r in REGISTRY["op5_suffix_array_dedup"](spark, sf_dir).collect())
    assert got == [(i, *w) for (i, _), w in zip(docs, brute([t for _, t in docs], 200))]
