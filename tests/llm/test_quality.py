import itertools

import numpy as np
import pytest

from reviewloom.llm import quality


def test_marginals_against_all_labellings():
    r = np.random.default_rng(1)
    docs = np.repeat([0, 1, 2, 5], [3, 1, 5, 2])
    node, pair = r.normal(size=len(docs)), r.normal(size=(2, 2))
    good, pairs, log_z = quality.Chains(docs).marginals(node, pair)
    want_pairs = np.zeros((2, 2))
    for doc in (0, 1, 2, 5):
        rows = np.flatnonzero(docs == doc)
        total, marginal, moves = 0.0, np.zeros(len(rows)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(rows)):
            score = sum(node[i] * y for i, y in zip(rows, labels)) + sum(pair[a, b] for a, b in zip(labels, labels[1:]))
            weight = np.exp(score)
            total += weight
            marginal += weight * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                moves[a, b] += weight
        assert good[rows] == pytest.approx(marginal / total)
        assert log_z[rows].sum() == pytest.approx(np.log(total))
        want_pairs += moves / total
    assert pairs == pytest.approx(want_pairs)


def base_of(texts):
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    return quality.line_features(raw, np.cumsum([0, *[len(t.encode()) for t in texts]]))


def test_lines_of_texts():
    texts = ["", "ab 12\n\nX!", "\n", "", "", "é é é", "a\n", ""]
    base, size, docs = base_of(texts)
    lines = [(d, line) for d, t in enumerate(texts) for line in t.split("\n")]
    assert docs.tolist() == [d for d, _ in lines]
    assert size.tolist() == [len(x.encode()) for _, x in lines]
    for row, (_, line) in zip(base, lines):
        raw = line.encode()
        digits = sum(48 <= b < 58 for b in raw) / max(1, len(raw))
        words = line.split()
        again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
        assert row[quality.BASE.index("digits")] == pytest.approx(digits)
        assert row[quality.BASE.index("again")] == pytest.approx(again)


def test_features_do_not_depend_on_neighbouring_texts():
    texts = ["some words here\nsome words here\nthe the the", "", "x" * 5000, "a b c d e f\n\n\n", "one\ntwo"]
    whole, _, docs = base_of(texts)
    for i, t in enumerate(texts):
        assert whole[docs == i] == pytest.approx(base_of([t])[0])


@pytest.fixture(scope="module")
def tables(spark, documents):
    good = [(i, f"Plain words about topic {i}.\nAnother line of them, number {i * 7}.") for i in range(300)]
    bad = [(1000 + i, f"w{i}### x{i}*** %%%\n$$$ y{i}&&& &&&") for i in range(100)]
    odd = [(5000, None), (5001, ""), (None, "Plain words again."), (5002, "word " * 80_000), (5003, "### $$$ " * 20_000), (5003, "### $$$ " * 20_000), (5004, "\n" * 1000)]
    labels = [(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(100)] + [(5001, None, 0), (None, 0, 0), (3, 1, 1)]
    return documents(good + bad + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(odd)


def test_odd_rows(tables):
    docs, labels, n_odd = tables
    got = quality.predict(docs, quality.learn(docs, labels)).collect()
    assert len(got) == 400 + n_odd and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == 1 for i in range(300)) and all(by[1000 + i].predicted == 0 for i in range(100))
    assert by[5000].score == by[5001].score


def test_kept_rows_have_all_columns(tables):
    docs, labels, _ = tables
    kept = quality.keep(docs, quality.learn(docs, labels))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(300))


def test_without_labels(tables, documents, spark):
    docs, labels, _ = tables
    assert quality.learn(docs, labels.limit(0)) is None
    assert {r.score for r in quality.predict(documents([(1, "a"), (2, None)]), None).collect()} == {0.5}
    assert quality.predict(documents([]), quality.learn(docs, labels)).count() == 0


def test_held_out_labels_are_not_learned_from(tables, spark):
    docs, labels, _ = tables
    from reviewloom.llm.common import remainder

    assert quality.learn(docs, labels.where(remainder("doc_id", 4) == 2)) is None


def test_held_out_accuracy(spark):
    from reviewloom.llm.queries import REGISTRY

    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = REGISTRY["op9_quality_classifier"](spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


def test_without_a_field_nothing_is_rejected(tables):
    docs, labels, _ = tables
    field = quality.learn(docs, labels.where("quality is null"))
    assert field is None and quality.keep(docs, field).count() == docs.count()


def test_labels_without_documents_take_no_places(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(4000, 4040)])
    labels = spark.range(4040).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    assert quality.learn(docs, labels, max_docs=5) is not None


def test_a_label_of_long_documents_alone_is_learned(spark, documents):
    good = [(i, f"Plain words about topic {i}.\nAnother line of them, number {i * 7}.") for i in range(60)]
    bad = [(1000 + i, f"w{i}### x{i}*** %%%\n$$$ y{i}&&& &&&\n" * 400) for i in range(3)]
    docs = documents(good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    field = quality.learn(docs, labels, max_docs=20, max_bytes=2_000)
    got = {r.doc_id: r.predicted for r in quality.predict(docs, field).collect()}
    assert all(got[i] == 1 for i, _ in good) and all(got[i] == 0 for i, _ in bad)
