"""Token counts of texts under a byte-level BPE vocabulary.

A pre-token is split by the vocabulary's own pattern, and the merges never cross its ends. Which strings
of the vocabulary encode alone as one token is found out once, on the driver, by encoding every one of
them; the table has one entry per vocabulary string at most. A pre-token in that table counts one
without any merge. Only the rest goes through the merges, and each worker remembers a bounded number
of those.

Null and empty texts have no tokens. A special string inside a text is one token and ends the pre-tokens
around it, as the library has it by default. Rows keep their number and need no order, so repeated ids
and extra columns do no harm.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from reviewloom.llm.common import bounded, nonempty, texts, utf8

#: Pre-tokens off the shortcut that a worker remembers at most.
REMEMBERED = 200_000
LIMIT = 1024


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others are numbered from 256 upwards.
    """
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, rank = [], 0
    for byte in range(256):
        letters.append(chr(byte if byte in kept else 256 + rank))
        rank += byte not in kept
    return letters


LETTERS = byte_letters()


def spelled(text: str) -> str:
    return "".join([LETTERS[b] for b in text.encode("utf-8")])


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """The texts that are one token when encoded alone, each of them tried."""
    bytes_of = {letter: byte for byte, letter in enumerate(LETTERS)}
    proven = []
    for name in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(bytes_of[c] for c in name).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # a part of a character is no pre-token
        if text and len(tokenizer.model.tokenize(name)) == 1:
            proven.append(text)
    return proven


class Counter:
    def __init__(self, vocabulary: str, pattern: str, whole: list[str]):
        self.model = Tokenizer.from_str(vocabulary).model
        specials = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.split = regex.compile(pattern).findall
        self.whole = dict.fromkeys(whole, 1)
        self.merged: dict[str, int] = {}

    def rest(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            n = len(self.model.tokenize(spelled(piece)))
            if len(piece) < 100:
                self.merged[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            pieces = self.split(part)
            known = list(map(self.whole.get, pieces))
            total += known.count(1)
            if None in known:
                total += sum(self.rest(p) for p, k in zip(pieces, known, strict=True) if k is None)
        return total


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, read by the driver alone.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    whole = whole_tokens(Tokenizer.from_str(content))
    key = uuid.uuid4().hex  # workers keep what they built from it
    sent = bounded(docs.sparkSession).sparkContext.broadcast((content, pattern, whole))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = Counter(*sent.value)
        for batch in nonempty(batches):
            ends = utf8(batch["text"])[1]
            n = [counter.count(t) for t in texts(batch["text"])]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].cast(pa.int64()),
                    "n_bytes": pa.array(ends[1:] - ends[:-1], pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
