from __future__ import annotations

import hashlib

import numpy as np
import pytest

from kmerlake.llm import substring_dedup as S
from kmerlake.llm.shingles import runs, word_hashes, words
from tests.llm.data import documents, edge_rows, frame


def brute(rows, window):
    texts = {r[0]: (r[1] or "").encode().split() for r in rows if r[0] is not None}
    first = {}
    for k in sorted(texts):
        for p in range(len(texts[k]) - window + 1):
            first.setdefault(tuple(texts[k][p : p + window]), k)
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[p : p + window])] < r[0]:
                gone[p : p + window] = [True] * window
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(left).hexdigest(), left.decode()))
    return out


@pytest.mark.parametrize("window,anchor,bits", [(50, 38, None), (50, 38, 16), (10, 6, None), (7, 7, None)])
def test_brute_force(spark, window, anchor, bits):
    rows = documents(n=150) + edge_rows()
    out = S.dedup_substrings(frame(spark, rows, True), window=window, anchor=anchor, bits=bits)
    want = brute(rows, window)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in out.collect()) == sorted(str(x[:4]) for x in want)
    assert sum(x[2] for x in want) > 0


def keys_of(text):
    hashes = word_hashes(words(text))
    keys = S.anchors(hashes, S.WINDOW, S.ANCHOR)
    return np.append(np.unique(keys), S.whole_key(hashes)) if len(keys) else keys


@pytest.mark.parametrize("bits,units,flush", [(16, 17, 1 << 19), (17, 17, 300), (20, 17, 300), (20, 1, 300)])
def test_estimates_are_those_of_a_count_min_sketch(spark, monkeypatch, bits, units, flush):
    """repeated_keys() against counts in one array of cells, for sketches of one stretch or many, in units of one stretch or several."""
    monkeypatch.setattr(S, "UNIT_BITS", units)
    monkeypatch.setattr(S, "FLUSH", flush)
    docs = [(k, t) for k, t, *_ in documents(n=150) + edge_rows() if k is not None and t is not None]
    count = np.zeros(S.ROWS << bits, np.int64)
    for _, t in docs:
        np.add.at(count, S.cells(keys_of(t), bits), 1)
    want: dict[int, set] = {}
    for k, t in docs:
        if len(keys := keys_of(t)):
            want.setdefault(k, set()).update(keys[(count[S.cells(keys, bits)] > 1).reshape(S.ROWS, -1).all(0)].tolist())
    frame_of = spark.createDataFrame(docs, "doc long, text string").repartition(5)
    told = {r["doc"]: {x & (2**64 - 1) for x in r["repeated"]} for r in S.repeated_keys(frame_of, bits).collect()}
    assert told == {k: v for k, v in want.items() if v}


def test_few_single_anchors_pass_at_any_size():
    """At the load that sketch_bits() gives, sketches of any size let through about as many keys that stand once."""
    rng = np.random.default_rng(5)
    for bits in (17, 18, 20):
        n = 1 << (bits - 2)
        assert S.sketch_bits(n * 42) == bits
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        at = S.cells(keys, bits)
        assert (np.bincount(at)[at] > 1).reshape(S.ROWS, -1).all(0).mean() < 0.02
    assert S.sketch_bits(100 * 10**12) == 44


def test_texts(spark):
    rows = documents(n=60) + edge_rows()
    out = {r["doc_id"]: r["text"] for r in S.drop_substrings(frame(spark, rows)).collect() if r["doc_id"] is not None}
    for (k, _, gone, _, left), r in zip(brute(rows, 50), rows):
        if k is not None:
            assert out[k] == (left if gone else r[1])


def test_an_overfull_sketch_loses_nothing(spark, monkeypatch):
    """With every key estimated to be repeated all texts and windows pass, and the result is the same."""

    def every(docs, *_):
        rows = [(r["doc"], keys_of(r["text"]).view(np.int64).tolist()) for r in docs.dropDuplicates(["doc"]).collect()]
        return spark.createDataFrame(rows, "doc long, repeated array<long>")

    monkeypatch.setattr(S, "repeated_keys", every)
    rows = documents(n=60) + edge_rows()
    out = S.dedup_substrings(frame(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in out) == sorted(str(x[:4]) for x in brute(rows, 50))


def test_anchors_are_least_of_inner_runs():
    h = word_hashes([str(i * i % 17).encode() for i in range(90)])
    r = runs(h, 38)
    assert S.anchors(h, 50, 38).tolist() == [int(r[i : i + 13].min()) for i in range(41)]
    assert len(S.anchors(h[:49], 50, 38)) == 0


def test_long_repeats_inside_one_document_stay(spark):
    text = "a b c d " * 5000
    out = S.dedup_substrings(frame(spark, [(1, text, "", "", 0), (2, text + "x", "", "", 0)])).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in out} == {(1, 0), (2, 20000)}


def test_empty_table(spark):
    assert S.dedup_substrings(frame(spark, [])).collect() == []
