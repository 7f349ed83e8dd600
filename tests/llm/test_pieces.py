from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from kmerlake.llm import pieces as P
from tests.llm.data import documents, edge_rows, frame


@pytest.fixture(scope="module")
def own():
    return P._pieces("piece_bpe_32k.model", P.THETA)


SIGNS = ["a", "b", "th", "in", " ", "  ", "▁", "\n", "\t", "é", "日", "😀", "̀", "①", "\x00", "the", "ing", "ﬁ"]


def test_lossless(own):
    rng = random.Random(6)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + ["", "▁", " ", "x" * 3000, None, "日" * 2000]
    ids = own.encode(texts, list(range(len(texts))))
    assert [own.decode(x) for x in ids] == texts


def test_same_draws_whatever_the_batch(own):
    texts = [r[1] for r in documents()]
    keys = list(range(len(texts)))
    whole = own.encode(texts, keys)
    for i in range(len(texts)):
        assert np.array_equal(own.encode([texts[i]], [keys[i]])[0], whole[i])
    assert any(not np.array_equal(a, b) for a, b in zip(whole, own.encode(texts, [k + 1000 for k in keys])))


def test_long_text_in_parts(own, monkeypatch):
    text = "this is  a\nlong ▁ text " * 400
    whole = own.encode([text], [1])[0]
    monkeypatch.setattr(P, "LONG", 100)
    monkeypatch.setattr(P, "UNITS", 7)
    assert np.array_equal(own.encode([text], [1])[0], whole)
    assert own.decode(whole) == text


def every_way(own, unit):
    """All segmentations of a unit with their probabilities."""
    names = {}
    for i, s in enumerate(own.spells):
        if s and i not in own.byte_ids.values():
            names.setdefault(s.decode().replace(" ", P.GAP), i)
    ways = {}

    def go(at, ids, weight):
        if at == len(unit):
            ways[tuple(ids)] = weight
        for j in range(at + 1, len(unit) + 1):
            if (i := names.get(unit[at:j])) is not None:
                go(j, [*ids, i], weight + own.theta * own.score[i])
        if unit[at : at + 1] and unit[at] not in names:
            go(at + 1, [*ids, *own.spelt(unit[at])], weight)

    go(0, [], 0.0)
    total = sum(math.exp(w) for w in ways.values())
    return {k: math.exp(w) / total for k, w in ways.items()}


@pytest.mark.parametrize("word", ["thing", "inner", "a①b", "zqx"])
def test_draws_follow_the_lattice(own, word):
    """Relative numbers of 20,000 draws against the enumerated lattice."""
    n = 20_000
    want = every_way(own, P.GAP + word) if "①" not in word else None
    got = Counter(tuple(x.tolist()) for x in own.encode([word] * n, list(range(n))))
    if want is None:  # the odd sign is a unit of its own
        assert all(own.decode(np.array(k)) == word for k in got)
        return
    assert set(got) <= set(want)
    for k, p in want.items():
        assert abs(got[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_query_and_decode(spark):
    rows = documents() + edge_rows()
    df = frame(spark, rows, True)
    out = P.encode(df)
    got = out.collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got)
    back = {r["doc_id"]: r["text"] for r in P.decode(out).collect() if r["doc_id"] is not None}
    assert back == {r[0]: r[1] for r in rows if r[0] is not None}
    none = next(r for r in got if r["doc_id"] == 1001)
    assert none["ids"] is None and none["n_pieces"] == 0
    assert P.encode(frame(spark, [])).collect() == []
    assert "ids" not in P.encode(df, with_ids=False).columns


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        P.Pieces(str(tmp_path / "none.model"))
