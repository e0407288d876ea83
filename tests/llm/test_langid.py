import numpy as np
import pytest

from reviewloom.llm import langid


def code_length(text: bytes, samples: list[bytes]) -> float:
    """Escape by escape, from plain counts."""
    bits = 0.0
    for i in range(len(text)):
        for order in range(min(i, langid.ORDER), -2, -1):
            if order < 0:
                bits += 8
                break
            context = text[i - order : i]
            followers = [s[j + order] for s in samples for j in range(len(s) - order) if s[j : j + order] == context]
            if not followers:
                continue
            total, kinds, own = len(followers), len(set(followers)), followers.count(text[i])
            bits += np.log2((total + kinds) / (own or kinds))
            if own:
                break
    return bits


def test_code_lengths_are_exact():
    samples = {"a": [b"abracadabra", b"aab"], "b": [b"the other then", b"x"], "c": [b"\x00\xff\x00\xff"]}
    model = langid.Model(samples).ready()
    texts = [b"", b"a", b"abra", b"the cat", b"\x00\xff", b"zzzz", b"abracadabra the other"]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    got = model.lengths(raw, np.cumsum([0, *map(len, texts)]))
    for row, text in zip(got, texts):
        assert row == pytest.approx([code_length(text, samples[n]) for n in model.names])


def test_blocks_give_the_same_lengths(monkeypatch):
    model = langid.Model({"a": [b"abracadabra" * 5], "b": [b"then other" * 4]}).ready()
    raw = np.frombuffer(b"abrathenacadother" * 40, dtype=np.uint8)
    ends = np.array([0, 3, 3, 100, 680])
    whole = model.lengths(raw, ends)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert model.lengths(raw, ends) == pytest.approx(whole)


ROWS = [(i, f"the cat and the dog {i}", "en", "x") for i in range(40)] + [
    (100 + i, f"el gato y el perro {i}", "es", "y") for i in range(40)
]


def test_odd_rows(documents):
    odd = [(500, None, "en"), (501, "", "en"), (502, "123 ... \n", None), (503, "漢字", None), (None, "the dog", None), (504, "the cat " * 60_000, None), (504, "the cat", None), (504, "the cat", None)]
    docs = documents(ROWS + odd)
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == len(ROWS) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[502].score == 0
    assert by[503].lang_pred in ("en", "es") and by[None].lang_pred == "en" and by[504].lang_pred == "en"
    assert all(r.lang_pred == ("en" if r.doc_id < 100 else "es") for r in got if r.doc_id is not None and r.doc_id < 200)
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "some text", None), (2, None, "en")])
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(docs)).collect()} == {"und"}
    empty = documents([])
    assert langid.predict(empty, langid.learn(empty)).count() == 0


def test_held_out_rows_are_not_learned_from(documents):
    docs = documents([(i, "held text", "zz") for i in range(60)])
    from reviewloom.llm.common import remainder

    held = docs.where(remainder("doc_id", 5) == 0)
    assert held.count() > 0 and langid.learn(held) is None


def test_held_out_accuracy(spark, sf_dir):
    from reviewloom.llm.queries import REGISTRY

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = REGISTRY["op10_language_id"](spark, sf_dir).where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 10 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_the_sample_is_bounded_in_bytes_but_has_every_language(documents):
    from reviewloom.llm.common import remainder

    long = [(1000 + i, "un perro y " * (500 + i), "es") for i in range(8)]
    docs = documents([(i, f"the cat {i:04}", "en") for i in range(200)] + [(7, "the same id", "en")] * 3 + long)
    parted = docs.withColumn("part", remainder("doc_id", 5))
    rows = langid.sample(parted, max_docs=50, max_bytes=300).collect()
    taken = {name: [r.text for r in rows if r.lang == name] for name in ("en", "es")}
    assert sum(map(len, taken["en"])) <= 300 and len(taken["en"]) > 10
    fits = [r.text for r in parted.where("part != 0 and lang = 'es'").collect()]
    assert taken["es"] == [min(fits, key=len)]
    assert langid.sample(parted, max_docs=50).where("lang = 'en'").count() >= 50
