from __future__ import annotations

import math
import re

import pytest

from kmerlake.llm.mixing import Mix, targets
from tests.llm.data import documents, edge_rows, frame

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_targets_by_hand():
    got = targets([("b", 100), (None, 100), ("a", 10), ("c", 400)])
    # Weights 3, 1, 2, 3 for a, b, c, null; 915 to share. a stops at 20, null at 200; 695 by 1 : 2.
    assert got["a"] == 20 and got[None] == 200
    assert math.isclose(got["b"], 695 / 3) is False and got["b"] == 200
    assert math.isclose(got["c"], 495)


def test_targets_sum_and_limits():
    sizes = [(f"s{i}", 7 * i % 50) for i in range(20)]
    got = targets(sizes)
    assert math.isclose(sum(got.values()), 1.5 * sum(n for _, n in sizes))
    assert all(got[s] <= 2 * n + 1e-9 for s, n in sizes)


def test_mix(spark):
    rows = [r for r in documents(n=400)] + edge_rows()
    df = frame(spark, rows, True)
    mix = Mix(df)
    out = mix.taken().collect()
    assert len(out) == len(rows)
    size = sorted((r[0] is None, r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in out) == size
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    want = targets([(s, sum(r["size"] for r in x)) for s, x in by.items()])
    for s, x in by.items():
        assert math.isclose(x[0]["target"], want[s]) and all(r["source_size"] == sum(q["size"] for q in x) for r in x)
        assert all(0 <= r["taken"] <= 2 * r["size"] and 0 <= r["rate"] <= 2 for r in x)
        assert abs(sum(r["taken"] for r in x) - want[s]) <= max(r["size"] for r in x)
        rates = sum(r["rate"] * r["size"] for r in x)
        assert abs(rates - want[s]) <= 1
        # The rates are an exponential tilt, cut at 2: their logarithms are proportional to sizes.
        tilts = {round(math.log(r["rate"]) / r["size"], 9) for r in x if r["size"] and 0 < r["rate"] < 2}
        assert len(tilts) <= 1 or max(tilts) - min(tilts) < 1e-6
    again = Mix(df).taken()
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    copies = {}
    for r in mix.apply(df).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert mix.apply(df).columns == df.columns
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["copies"]
    assert copies == {k: v for k, v in total.items() if v}


def test_empty_and_wordless(spark):
    assert Mix(frame(spark, [])).taken().collect() == []
    out = Mix(frame(spark, [(1, None, "", "a", 0), (2, " ", "", "a", 0)])).taken().collect()
    assert {(r["size"], r["target"], r["taken"], r["copies"]) for r in out} == {(0, 0.0, 0, 1)}


def test_too_many_sources(spark):
    with pytest.raises(ValueError):
        Mix(frame(spark, documents()), max_sources=2)
