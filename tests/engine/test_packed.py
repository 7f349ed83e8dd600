"""Packed sets of k-mers against the plan that has a row for each k-mer."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from kmerlake.operators import kmerdb, packed, score
from kmerlake.plans import catalogue
from tests.conftest import rows_of

ODD = [None, "", "A", "ACGTTGCAAC" * 9, "A" * 70, "N" * 40, "é" * 3 + "ACGGTCATTGCAGGTCATAACGTGACGTTTGACA" + "\U0001f9ec" + "ACGGTCATTGCAGGTCATAACGTGACGTTTGACA", "acggtcattgcaggtcataacgtgacgtttgaca\nTTGCA"]


@pytest.mark.parametrize("k,mc,step,early", [(8, 0.05, 0, True), (8, 0.9, 1, True), (12, 0.3, 1, False), (15, 0.2, 4, True), (16, 0.2, 0, True), (17, 0.6, 1, True), (24, 0.05, 1, True), (31, 0.0, 0, False)])
def test_same_scores_as_rows_of_kmers(spark, k, mc, step, early):
    rng = random.Random(k)
    refs = [(g, "".join(rng.choice("ACGT") for _ in range(n))) for g in ("a", "b", "é") for n in (30, 70, 700, 3000)] + [("a", s) for s in ODD] + [(None, "ACGTTGCAACC" * 20), ("none", None), ("short", "ACG")]
    reads = []
    for _ in range(150):
        s = rng.choice(refs[:12])[1]
        a = rng.randrange(len(s))
        s = [rng.choice("ACGTNacgt-é") if rng.random() < 0.03 else c for c in s[a : a + rng.randrange(120)]]
        reads.append("".join(s) if rng.random() < 0.5 else "".join(s).translate(str.maketrans("ACGT", "TGCA"))[::-1])
    seqs = spark.createDataFrame(refs, "group string, seq string").repartition(3)
    own = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate([*reads, *ODD])], "read_key string, seq string")
    got = packed.hit_scores(own, seqs, k, mc, step, early, piece=1000, batch_bases=300)
    assert rows_of(got) == rows_of(score.hit_scores(own, kmerdb.build(seqs.filter("group is not null"), k), k, mc, step, early).drop("len"))


@pytest.mark.parametrize("k", [8, 11, 13, 16, 17, 31])
def test_packing_keeps_each_kmer(k):
    kind = np.uint32 if k <= 16 else np.uint64
    codes = np.array(sorted({random.Random(i).randrange(4**k) for i in range(3000)} | {0, 4**k - 1}), kind)
    assert len(set(packed.mixed(codes, k).tolist())) == len(codes)
    there, counts, lows = packed.pack(codes, k)
    values, sizes = packed.unpack(counts, lows, k)
    assert (np.repeat(there.astype(np.uint64), sizes) << np.uint64(2 * k - packed.bucket_bits(k)) | values.astype(np.uint64)).tolist() == codes.tolist()
    values, sizes = packed.unpack(counts[1:3], lows[1:3], k)  # a part of a column
    assert len(values) == sizes.sum() and len(sizes) == 2


def test_keys_and_groups_of_other_kinds_and_no_rows(spark):
    text = "ACGGTCATTGCAGGTCATAACGTGACGTTTGACA"
    seqs = spark.createDataFrame([(7, text)], "group int, seq string")
    own = spark.createDataFrame([(2**40, text)], "read_key long, seq string")
    assert [tuple(r) for r in packed.hit_scores(own, seqs, 16).collect()] == [(2**40, "+", 7, len(text), 0)]
    assert packed.hit_scores(own.limit(0), seqs, 16).collect() == packed.hit_scores(own, seqs.limit(0), 16).collect() == []


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data")}


@pytest.fixture
def no_broadcast(spark):
    """As with tables too large for it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


def test_turns_are_scored_with_few_bytes_a_kmer(spark, tmp_path, no_broadcast):
    """A row for each k-mer of documents and turns took more disk than the check tool's run on 0.1 GB may."""
    rng = np.random.default_rng(1)
    text = lambda n: rng.integers(65, 91, n, np.uint8).tobytes().decode()
    docs = [text(50_000) for _ in range(40)]
    turns = [docs[i % 40][i * 100 : i * 100 + 1000] if i % 4 else text(1000) for i in range(200)]
    spark.createDataFrame([(i, x, "ab"[i % 2], "s") for i, x in enumerate(docs)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(turns)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    before = shuffle_bytes(spark)
    rows = catalogue.strand_choice_turns(spark, str(tmp_path)).collect()
    written = sum(n for f, n in shuffle_bytes(spark).items() if f not in before)
    assert len(rows) == 400 and sum(r["label"] != "MM" for r in rows) == 150
    kmers = sum(len(x) - 15 for x in docs) + 2 * sum(len(x) - 15 for x in turns)
    assert written < 5 * kmers


def test_runs_join_batches():
    batches = [pa.record_batch({"b": pa.array(x, pa.int32())}) for x in ([1, 1, 2], [], [2], [2, 3])]
    assert [(v, len(t)) for v, t in packed.runs(iter(batches), "b")] == [(1, 2), (2, 3), (3, 1)]
