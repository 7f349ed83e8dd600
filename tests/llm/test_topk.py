from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v string, dim string"


def made(rng, n=300, dim=8):
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dim)]
        if i % 3 == 0:
            v = [0.5] * dim
        if i % 17 == 0:
            v[rng.randrange(dim)] = rng.choice([None, math.nan, math.inf, -math.inf])
        rows.append((i, None if i % 29 == 0 else v[: dim - (i % 7 == 0)], 0, "x", "y", "z"))
    return rows + [(9001, [], 0, "", "", ""), (9002, [], 0, "", "", ""), (None, [1.0] * dim, 0, "", "", "")]


def brute(rows, k, every):
    ok = {r[0]: [math.floor(256 * float(np.float32(x))) for x in r[1]] for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    out = []
    for q in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,passes,k", [(1024, 8192, 5), (16, 8192, 5), (7, 4, 3), (16, 8192, 400)])
def test_brute_force(spark, block, passes, k):
    rows = made(random.Random(7))
    all_rows = K.usable(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding")
    out = K.top_k(all_rows, all_rows.filter(F.col("key") % 10 == 0), k, block=block, pass_queries=passes)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()) == brute(rows, k, 10)


@pytest.mark.parametrize("block,passes", [(16, 8192), (5, 3)])
def test_repeated_rows_count_once(spark, block, passes):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0, "", "", "") for i in range(40)]
    rows += rows + [r for r in rows if r[0] % 10 == 0] * 3
    rng.shuffle(rows)
    once = {r[0]: r for r in rows}.values()
    all_rows = K.usable(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding")
    out = K.top_k(all_rows, all_rows.filter(F.col("key") % 10 == 0), 5, block=block, pass_queries=passes)
    assert sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == brute(once, 5, 10)


def test_a_key_of_several_vectors(spark):
    """The best of its scores as a candidate, the best results of all of them as a query."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0])]
    all_rows = K.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    out = K.top_k(all_rows, all_rows.filter("key = 0"))
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 1, 3 * 65536), (0, 2, 2, 65536)]


def test_a_task_holds_few_bytes():
    """Blocks come one after the other; a hold of one byte searches each at once, with the same result."""
    rng = np.random.default_rng(2)
    import pyarrow as pa

    rows = [(np.arange(20) + 20 * i, rng.integers(-99, 99, (20, 6))) for i in range(8)]
    batch = pa.RecordBatch.from_pydict({"dim": pa.array([6] * 8, pa.int32()), "ids": [a.astype("<i8").tobytes() for a, _ in rows], "cells": [K._packed(c) for _, c in rows], "top": [c.max(0).tobytes() for _, c in rows], "low": [c.min(0).tobytes() for _, c in rows]})
    shared = type("Shared", (), {"value": {6: (np.array([3, 77]), np.concatenate([c for _, c in rows])[[3, 77]])}})
    once, piece = (next(K._searcher(shared, 5, hold)(iter([batch]))).to_pydict() for hold in (1 << 30, 1))
    assert once == piece and len(rows[0][1]) * 6 * 4 == len(K._packed(rows[0][1]))


def test_empty(spark):
    rows = K.usable(spark.createDataFrame([], SCHEMA), "vec_id", "embedding")
    assert K.top_k(rows, rows).collect() == []


def test_blocks_are_left_out():
    """Blocks whose bound is under the k-th score aren't scored."""
    rng = np.random.default_rng(1)
    near = rng.integers(50, 60, (32, 16))
    blocks = [(np.arange(32) + 32 * i, near - 40 * i, (near - 40 * i).max(0), (near - 40 * i).min(0)) for i in range(6)]
    scored = []
    real = K._multiply

    def spy(q, x):
        scored.append(x.shape)
        return real(q, x)

    K._multiply = spy
    try:
        K._Found(np.array([0]), near[:1], 5).search(blocks)
    finally:
        K._multiply = real
    assert scored.count((32, 16)) < 6


def test_large_numbers_stay_exact():
    q, x = np.array([[2**30, 1]]), np.array([[2**30, 1], [2**30, 0]])
    assert K._multiply(q, x).tolist() == [[2**60 + 1, 2**60]]
