from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.llm import lang_id as L
from tests.llm.data import edge_rows, frame

SYLLABLES = {"xx": ["ka", "ro", "mi", "tu", "les"], "yy": ["sch", "ung", "ber", "ich", "eit"], "zz": ["ão", "qué", "ção", "lhe", "nho"]}


def made(rng, n=300):
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text, lang, "s", 0))
    return rows


def test_held_out_accuracy(spark):
    rows = made(random.Random(1))
    df = frame(spark, rows, True)
    out = L.predict(df.select("doc_id", "text"), L.fit(df.filter(L.in_training(df["doc_id"])))).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    lang = {r[0]: r[2] for r in rows}
    assert len(held) > 30 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_fold_is_the_contract_s(spark):
    df = frame(spark, made(random.Random(2), 100))
    train = {r["doc_id"] for r in df.filter(L.in_training(df["doc_id"])).collect()}
    assert train == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 0}


def test_prototypes_are_bundles(spark):
    """The distributed sums are those of the texts' own vectors."""
    rows = made(random.Random(3), 40) + edge_rows()
    got = L.fit(frame(spark, rows))
    for lang in {r[2] for r in rows} - {None}:
        want = sum(v / np.linalg.norm(v) for r in rows if r[2] == lang and (v := L.bundle(r[1])) is not None)
        if isinstance(want, int):  # a language without a letter has no prototype
            assert lang not in got
            continue
        assert np.allclose(got[lang], want / np.linalg.norm(want), atol=1e-5)


def test_bundle_by_definition():
    """A text's vector, letter by letter."""
    text = "Ab, ÇZ!"
    slots, vectors = L._letters()
    s = [0, *(int(slots[ord(c)]) for c in "ab"), 0, *(int(slots[ord(c)]) for c in "çz"), 0]
    want = sum(np.roll(vectors[a], 2).astype(int) * np.roll(vectors[b], 1) * vectors[c] for a, b, c in zip(s, s[1:], s[2:]))
    assert (L.bundle(text) == want).all()


def test_pieces_of_a_long_text(monkeypatch):
    text = "abc  déf, " * 300 + "!!!" * 50 + "xyz"
    whole = L.bundle(text)
    monkeypatch.setattr(L, "PIECE", 17)
    assert np.array_equal(L.bundle(text), whole)


def test_edges(spark):
    protos = L.fit(frame(spark, made(random.Random(4), 60)))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(frame(spark, edge_rows(), True).select("doc_id", "text"), protos).collect()}
    assert out[1001] == out[1002] == out[1003] == ("und", 0.0)
    assert L.bundle("12 !?") is None
    assert L.predict(frame(spark, []), protos).collect() == []
    assert L.fit(frame(spark, [])) == {}
    assert {r["lang_pred"] for r in L.predict(frame(spark, edge_rows()), {}).collect()} == {"und"}
    with pytest.raises(ValueError):
        L.fit(frame(spark, made(random.Random(4), 60)), max_langs=1)


def test_accept_keeps_columns(spark):
    df = frame(spark, made(random.Random(5), 40) + edge_rows(), True)
    out = L.accept(df, L.fit(df))
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} >= set(range(40)) and not {r["doc_id"] for r in out.collect()} & {1001, 1002, 1003}


def test_memory_does_not_grow_with_distinct_trigrams():
    """A text of 300,000 letters that hardly repeat a trigram."""
    letters = np.random.default_rng(1).integers(0x4E00, 0x9FFF, 300_000)
    text = "".join(map(chr, letters))
    L.bundle("warm up")
    tracemalloc.start()
    v = L.bundle(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    codes, n = L.trigrams(text)
    part = sum(n[i : i + 999] @ L.trigram_vectors(codes[i : i + 999]).astype(np.int64) for i in range(0, len(codes), 999))
    assert most < 100 << 20 and len(codes) > 250_000 and np.array_equal(v, part.astype(np.float32))


def test_documents_without_a_key_are_held_out(spark):
    got = spark.createDataFrame([(None,), (1,)], "doc_id long").select(L.in_training(F.col("doc_id")).alias("t")).collect()
    assert got[0]["t"] is False
