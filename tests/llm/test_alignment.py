import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewloom.llm import alignment, perfect_hash
from reviewloom.llm.queries import REGISTRY
from reviewloom.llm.tokens import LETTERS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE_LEVEL = Tokenizer.from_file(A)
BYTE_LEVEL.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
BYTE_OF = {letter: byte for byte, letter in enumerate(LETTERS)}


def tokens(text):
    """(id, bytes) of both, none where they don't give the text back."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE_OF[c] for c in BYTE_LEVEL.id_to_token(i))) for i in BYTE_LEVEL.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()))
    same = all(b"".join(t for _, t in x) == (" " + text).encode() for x in (a, b))
    return (a, b) if same else ([], [])


def spans(found):
    at, out = 0, []
    for i, token in found:
        out.append((i, at, at + len(token)))
        at += len(token)
    return out


def brute(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every text, by walking over the bytes."""
    every, total = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(text))
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if max(a[i][1], b[j][1]) < min(a[i][2], b[j][2]):
                links.append((a[i][0], b[j][0]))
            i, j = (i + (a[i][2] <= b[j][2]), j + (b[j][2] <= a[i][2]))
        total.update(links)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        sides = [iter(a), iter(b)]
        groups = []
        for cut in cuts:
            own = [[], []]
            for ids, side in zip(own, sides, strict=True):
                for i, _, end in side:
                    ids.append(str(i))
                    if end == cut:
                        break
            groups.append("|".join(map(",".join, own)))
        every.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return [
        (n_a, n_b, n, len(links), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links), groups)
        for n_a, n_b, n, links, groups in every
    ]


ODD = [
    "", None, " ", "  two  spaces ", "the cat sat on the mat", "the cat sat on the mat", "<s> [INST] </s> <|endoftext|>", "a\x00b\r\n\tc",
    "▁already ▁marked", "é漢字🙂👩‍👩‍👧 ½", "x" * 300, "don't we'll I'D 12345", "unbelievable antidisestablishmentarianism " * 40,
]


def rows_of(df):
    return sorted((repr(r.doc_id), *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")]) for r in df.collect())


@pytest.mark.parametrize("shard, lot", [(alignment.SHARD, alignment.LOT), (8, 30)])
def test_rows(documents, shard, lot, monkeypatch):
    rows = [*enumerate(ODD), (None, "the cat"), (4, ODD[4]), (4, ODD[4])]
    got = alignment.align(documents(rows), A, public_tokenizers.PATTERN, B, shard, lot)
    want = sorted((repr(i), *w) for (i, _), w in zip(rows, brute([t for _, t in rows]), strict=True))
    assert rows_of(got) == want
    assert any(w[1] == 0 and w[0] == "8" for w in want)  # a mark of its own doesn't come back


def test_no_links(documents):
    for rows in ([], [(1, ""), (2, None), (2, "▁")]):
        got = alignment.align(documents(rows), A, public_tokenizers.PATTERN, B)
        assert [r[1:] for r in rows_of(got)] == [(0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_portions_change_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "PORTION", 7)
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        known = alignment.Vocabularies(a.read(), public_tokenizers.PATTERN, b.read())
    for text in [t for t in ODD if t] + ["a  b   c d\n e f  \n g " * 9, "1 2 ' 's x 'll \u3000 y\u00a0 z \x1c q \u0308 r " * 5]:
        a, b = (np.array([i for i, _ in x], dtype="<u4").tobytes() for x in tokens(text))
        assert known.encode(text) == (a, b)
    assert len(known.portions(ODD[-1])) == 80


def test_merges_out_of_order_are_refused():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        content, pieces = json.load(a), b.read()
    content["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        alignment.Vocabularies(json.dumps(content), public_tokenizers.PATTERN, pieces)


def test_perfect_hash():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(r.integers(0, 1 << 40, n))
        shards = 1 + len(keys) // 300
        own = perfect_hash.shard_of(keys, shards)
        parts = [perfect_hash.built(keys[own == s]) for s in range(shards)]
        table = perfect_hash.Table(shards, list(range(shards)), *map(list, zip(*parts, strict=True)))
        assert sorted(table.find(keys).tolist()) == list(range(len(keys))) == list(range(len(table)))
        others = np.setdiff1d(r.integers(0, 1 << 40, 3000), keys)
        assert (table.find(others) == -1).all()
        some = [s for s in range(shards) if s % 2]
        half = perfect_hash.Table(shards, some, *[[p[i] for s, p in enumerate(parts) if s % 2] for i in range(3)])
        assert ((half.find(keys) >= 0) == np.isin(own, some)).all()
    with pytest.raises(ValueError):
        perfect_hash.built(np.array([7, 7]))


def test_remembered_pairs_are_not_searched_again(monkeypatch):
    r = np.random.default_rng(6)
    keys = np.unique(r.integers(0, 1 << 40, 40))
    parts = [[x] for x in perfect_hash.built(keys)]
    asked = r.choice(np.append(keys, [0, 5, 1 << 41]), 4000)
    place = {int(k): i for i, k in enumerate(parts[2][0])}
    want = [place.get(int(k), -1) for k in asked]
    for bits in (1, 16):  # many keys at one place, and each at its own
        monkeypatch.setattr(perfect_hash, "PLACES", bits)
        table = perfect_hash.Table(1, [0], *parts)
        assert all(table.find(asked[i : i + 700]).tolist() == want[i : i + 700] for i in range(0, 4000, 700))
    assert perfect_hash.Table(1, [], [], [], []).find(np.array([0, 7])).tolist() == [-1, -1]
    monkeypatch.setattr(perfect_hash.Table, "_searched", None)
    assert table.find(asked).tolist() == want


def test_written_ids_take_two_bytes(spark, documents):
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        sent = spark.sparkContext.broadcast((a.read(), public_tokenizers.PATTERN, b.read()))
    rows = [(i, t) for i, t in enumerate(ODD) if t]
    got = {r.doc_id: (np.frombuffer(r.a, "<u2").tolist(), np.frombuffer(r.b, "<u2").tolist()) for r in alignment.tokenized(documents(rows), "two bytes", sent).collect()}
    assert got == {i: tuple([n for n, _ in x] for x in tokens(t)) for i, t in rows}


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    want = sorted((i, *w[:-1], digest(w[-1])) for (i, _), w in zip(docs, brute([t for _, t in docs]), strict=True))
    got = REGISTRY["op11_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == want
