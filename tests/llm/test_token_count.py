from __future__ import annotations

import random

import pytest

from kmerlake.llm import token_count as C
from tests.llm.data import documents, edge_rows, frame

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def own():
    path = C.vocabulary(NAME)
    return C.Tokenizer(path, C.char_kinds(path))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(C.vocabulary(NAME))
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


SIGNS = [*"abst'reldvm  \n\t\r.!,19é日ß😀²½", "  ", "'s", "'re", "'ll", " '", "<|endoftext|>", "<|endof", "\u0300", "\u00a0", "\u2028", "\x1c", "\x85", "\u3000", "aaaa", "    ", "ing", "The", "\x00", "\ufeff"]


def test_random_texts(own, library):
    rng = random.Random(8)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, 50))) for _ in range(8000)]
    assert own.counts(texts) == library(texts)


def test_long_texts(own, library):
    texts = ["a" * 3000, "ab" * 2000, " " * 5000, "'" * 500, "日本" * 3000, "\n \n" * 900, "x <|endoftext|>" * 300, "é" * 4000]
    assert own.counts(texts) == library(texts)


def test_parts_and_chunks_change_nothing(own, library, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(3000)) for _ in range(5)]
    want = library(texts)
    monkeypatch.setattr(C, "CHUNK", 7)
    monkeypatch.setattr(C, "GROUP", 100)
    assert own.counts(texts) == want


def test_states_are_compiled_anew_when_full(own, library, monkeypatch):
    texts = [r[1] for r in documents()]
    monkeypatch.setattr(own.merger, "keep", 50)
    assert own.counts(texts) == library(texts)


def test_every_kind_of_sign(own, library):
    """Each sign of the first two planes, between letters, digits and signs."""
    texts = [f"a{c}a 1{c}1 !{c}! {c} {c}{c}" for c in map(chr, [*range(0, 0xD800, 3), *range(0xE000, 0x20000, 37)])]
    assert own.counts(texts) == library(texts)


def test_other_files_are_refused():
    path = C.vocabulary("word_bpe_49k.json")
    with pytest.raises(ValueError):
        C.Tokenizer(path, C.char_kinds(C.vocabulary(NAME)))


def test_query(spark, library):
    rows = documents() + edge_rows()
    out = C.count_tokens(frame(spark, rows, True)).collect()
    want = sorted(str((r[0], len((r[1] or "").encode()), n, n > 512)) for r, n in zip(rows, library([r[1] or "" for r in rows])))
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in out) == want
    assert C.count_tokens(frame(spark, [])).collect() == []
