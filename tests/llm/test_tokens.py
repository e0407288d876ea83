import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CONTENT = open(PATH, encoding="utf-8").read()
WHOLE = tokens.whole_tokens(LIBRARY)
COUNTER = tokens.Counter(CONTENT, public_tokenizers.PATTERN, WHOLE)

ODD = [
    "", " ", "  ", "\n\n a\t\tb  ", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "it's we'll I'D",
    "é è ñ 漢字 🙂👩‍👩‍👧 \u200b\u00a0x\u2028y", "x" * 500, "1234567 ½ ٣", "\r\n\r\n", "a\x00b", "Ġ Ċ <s>",
]


def size(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_odd_texts():
    for text in ODD:
        assert COUNTER.count(text) == size(text), repr(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert COUNTER.count(text) == size(text)


def test_every_shortcut_is_one_token():
    assert len(WHOLE) > 40_000
    for text in WHOLE[::97]:
        assert len(LIBRARY.model.tokenize(tokens.spelled(text))) == 1


def test_memory_of_merges_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    counter = tokens.Counter(CONTENT, public_tokenizers.PATTERN, WHOLE)
    text = " ".join(f"zq{i}xv" for i in range(40))
    assert counter.count(text) == size(text)
    assert len(counter.merged) <= 5


def test_rows(spark, documents):
    texts = [*ODD, "the cat " * 2000]
    rows = [*enumerate(texts), (None, None), (0, "again"), (0, "again")]
    got = tokens.token_counts(documents(rows), PATH, public_tokenizers.PATTERN).collect()
    want = sorted(
        (-1 if i is None else i, len((t or "").encode()), size(t or ""), size(t or "") > 1024) for i, t in rows
    )
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert tokens.token_counts(documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_library(spark, sf_dir):
    from reviewloom.llm.queries import REGISTRY

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in REGISTRY["op1_token_counts"](spark, sf_dir).collect()}
    assert got == {i: size(t) for i, t in texts.items()}
