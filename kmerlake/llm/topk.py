"""Exact top-k search by inner product, with block-at-a-time pruning.

Rows lie in blocks, each a forward index of whole-number vectors with the largest and smallest value of every
component (term). For a query the sum of its term maxima bounds every score in a block; a task takes its blocks
by falling bound and leaves out those whose bound is under the query's k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, staged

SCALE, BLOCK = 256, 1024
#: Bytes of blocks that a task holds at once.
HOLD = 64 << 20
LEAST, NO_ID = -np.iinfo(np.int64).max, np.iinfo(np.int64).max  # the negative of LEAST is a number, too
_BLOCKS = "dim int, ids binary, cells binary, top binary, low binary"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector (array of double) of the rows whose vector has neither nulls nor non-finite components."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("long").alias("key"), v.alias("v")).filter(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _whole(b: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, keys, floor(scale * x) as whole numbers) for each dimension in the batch."""
    v, keys = b.column("v"), b.column("key").to_numpy()
    sizes, flat, start = np.diff(v.offsets.to_numpy()), v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield int(dim), keys[own], np.floor(flat[start[own][:, None] + np.arange(dim)] * scale).astype(np.int64)


def build_blocks(rows: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Blocks of at most block rows that lie together in the input. Within a task's batch, rows with the same strongest term go together, which lowers the others' maxima."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, keys, x in _whole(b, scale):
                order = np.argsort(x.argmax(1) if dim else keys, kind="stable")
                for i in range(0, len(order), block):
                    at = order[i : i + block]
                    cells = x[at]
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [keys[at].astype("<i8").tobytes()], "cells": [_packed(cells)], "top": [cells.max(0).tobytes()], "low": [cells.min(0).tobytes()]})

    return rows.transform(arrow, part, _BLOCKS)


def _packed(cells: np.ndarray) -> bytes:
    """As numbers of four bytes, where they fit: the size tells."""
    return cells.astype("<i4" if np.abs(cells).max(initial=0) < 1 << 31 else "<i8").tobytes()


def _multiply(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products: through doubles where no sum can pass 2**53, else whole numbers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if bound < 2**53 else q.astype(np.int64) @ x.T.astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, each id once. Places without an id are all alike and last."""
    order = np.lexsort((ids, -score))
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    order = order[first][:k]
    short = k - len(order)
    return np.concatenate([score[order], np.full(short, LEAST)]), np.concatenate([ids[order], np.full(short, NO_ID)])


class _Found:
    """The best so far of all queries of a dimension: what one group of blocks has found prunes the next."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q, k
        self.score, self.ids = np.full((len(q), k), LEAST), np.full((len(q), k), NO_ID)

    def search(self, blocks: list[tuple]) -> None:
        """blocks: (ids, cells, top, low)."""
        top, low = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])
        bound = _multiply(np.maximum(self.q, 0), top) + _multiply(np.minimum(self.q, 0), low)
        order = np.argsort(-bound, axis=1, kind="stable")
        alive = np.arange(len(self.q))
        repeats = [len(np.unique(b[0])) < len(b[0]) for b in blocks]
        for step in range(len(blocks)):
            # A bound equal to the k-th score may hide a tie with a smaller id.
            alive = alive[bound[alive, order[alive, step]] >= self.score[alive, -1]]
            if not alive.size:
                return
            at = order[alive, step]
            for j in np.unique(at):
                own, (bid, cells) = alive[at == j], blocks[j][:2]
                got = _multiply(self.q[own], cells)
                other = bid[None, :] != self.qid[own][:, None]
                good = other & (got >= self.score[own, -1][:, None])
                for i in np.flatnonzero(good.any(1)):
                    n, near = own[i], np.flatnonzero(good[i])
                    if near.size > 8 * self.k and not repeats[j]:  # all ties with the k-th stay in
                        cut = np.partition(got[i][near], len(near) - self.k)[len(near) - self.k]
                        near = near[got[i][near] >= cut]
                    self.score[n], self.ids[n] = _best(np.concatenate([self.score[n], got[i][near]]), np.concatenate([self.ids[n], bid[near]]), self.k)

    def rows(self) -> pa.RecordBatch:
        full = self.ids != NO_ID
        return pa.RecordBatch.from_pydict({"query_id": np.repeat(self.qid, full.sum(1)), "vec_id": self.ids[full], "score": self.score[full]})


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, block: int = BLOCK, pass_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x), among all rows but its own.

    rows, queries: key, v as usable() gives them. Ties go to the smaller key.
    - A query sees the rows of its own dimension; with fewer than k of them it has them all, with none no row.
    - Repeated rows count once. If a key names several vectors, as a candidate it has the best of their scores, and as a query
      the best results of all of them; it never meets itself.
    - Products beyond 64 bits wrap. Empty tables give an empty result.
    - A pass holds at most pass_queries queries, which every task gets. More queries take more passes over the blocks, each
      written before the next begins, so that driver and tasks hold one pass's queries.
    """
    spark = rows.sparkSession
    blocks = staged(build_blocks(rows, scale, block), "blocks")
    passes = max(1, -(-queries.count() // (pass_queries * 3 // 4)))
    parts = []
    for p in range(passes):
        got = queries.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == p).collect()
        if not got:
            continue
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(r["v"]) for r in got}:
            # A row that stands twice is one query.
            own = sorted({(r["key"], tuple(r["v"])) for r in got if len(r["v"]) == dim})
            by_dim[dim] = (np.array([x for x, _ in own], np.int64), np.floor(np.array([v for _, v in own], np.float64).reshape(len(own), dim) * scale).astype(np.int64))
        shared = spark.sparkContext.broadcast(by_dim)
        found = blocks.transform(arrow, _searcher(shared, k), "query_id long, vec_id long, score long")
        if passes > 1:
            found = staged(found, "found")
            shared.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for x in parts[1:]:
        found = found.unionAll(x)
    # A task sends at most k rows a query; rows are dealt by query once, for both steps.
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int, hold: int = HOLD):
    """A task's search, over hold bytes of blocks at a time."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {dim: _Found(*own, k) for dim, own in shared.value.items()}
        held: dict[int, list] = {}
        size = 0

        def search() -> None:
            for dim, own in held.items():
                if dim in found:
                    found[dim].search(own)
            held.clear()

        for b in batches:
            for r in b.to_pylist():
                ids, dim = np.frombuffer(r["ids"], "<i8"), r["dim"]
                kind = "<i4" if len(r["cells"]) == 4 * len(ids) * dim else "<i8"
                held.setdefault(dim, []).append((ids, np.frombuffer(r["cells"], kind).reshape(len(ids), dim), np.frombuffer(r["top"], "<i8"), np.frombuffer(r["low"], "<i8")))
                size += len(r["cells"]) + 1
                if size >= hold:
                    search()
                    size = 0
        search()
        for own in found.values():
            yield own.rows()

    return part
