import corpus_pipeline
from reviewloom.llm import decontaminate
from reviewloom.llm.common import read


def test_stages_in_order(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[: len(columns)] == columns
        docs = corpus_pipeline.written(docs)
        sizes.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "decontamination", "mix"]
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] and sizes[4] >= sizes[5] > 0
    assert all(r.taken == sum(r.taken_by_turn) and (r.taken > 0 or r.size == 0) for r in docs.collect())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]


def test_run_is_the_stages_in_turn(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)
    items = [decontaminate.normal(r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    texts = [decontaminate.normal(r.text) for r in rows]
    assert not any(i in t for i in items if len(i) >= decontaminate.SHORTEST for t in texts)
    passages = [t[i : i + 200] for r in rows for t in [r.text.encode()] for i in range(len(t) - 199)]
    before = len(passages)
    assert before and len(set(passages)) >= 0.98 * before  # what is new lies over a cut


def test_empty_documents(spark, documents, sf_dir):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
