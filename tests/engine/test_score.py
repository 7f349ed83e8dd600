"""Scoring against a step-by-step model, and its edge cases."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from kmerlake.functions import dna
from kmerlake.operators import assign, kmerdb, score
from kmerlake.plans import pipeline

RC = str.maketrans("ACGT", "TGCA")


def revcomp(s):
    return s.translate(RC)[::-1]


def model(read, kmers, k, mc, step, early=True):
    """Walks a read place by place, as one would by hand."""
    step = step or k
    n = len(read)
    ok = lambda p: "N" not in read[p : p + k]
    hit = [read[p : p + k] in kmers for p in range(max(0, n - k + 1))]
    if step > 1:
        probes = [0] + list(range(step, n, step))
        if not any(p < len(hit) and hit[p] and (p == 0 or (p + k < n and ok(p) and read[p + k] != "N")) for p in probes):
            return 0, 0
    match = err = 0
    p = 0
    while p < len(hit):
        q = p
        while q < len(hit) and hit[q] == hit[p]:
            q += 1
        if hit[p]:
            match += k + q - p - 1 if match == 0 else min(gap, k) + q - p - 1
        else:
            if early and ((p + k) - match) / n - (1 - mc) > 1e-6:
                break
            gap = q - p
            err += -(-gap // k)
        p = q
    return match, err


def random_case(rng, k):
    refs = {g: "".join(rng.choice("ACGT") for _ in range(80)) for g in ("a", "b")}
    reads = {}
    for i in range(40):
        src = rng.choice(list(refs.values()))
        a = rng.randrange(0, 50)
        s = list(src[a : a + rng.randrange(0, 45)])
        for _ in range(rng.randrange(0, 4)):
            if s:
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
        s = "".join(s)
        reads[i] = revcomp(s) if rng.random() < 0.4 else s
    return refs, reads


@pytest.mark.parametrize("k,mc,step", [(8, 0.05, 0), (8, 0.9, 1), (8, 0.6, 4), (12, 0.3, 1), (8, 1.0, 0), (8, 0.0, 1)])
def test_scores_like_the_model(spark, k, mc, step):
    rng = random.Random(k * 1000 + int(mc * 100) + step)
    refs, reads = random_case(rng, k)
    db = kmerdb.build(spark.createDataFrame(list(refs.items()), "group string, seq string"), k)
    groups = spark.createDataFrame([("a",), ("b",)], "group string")
    df = spark.createDataFrame(list(reads.items()), "read_key long, seq string")
    kmers = {g: {s[p : p + k] for p in range(len(s) - k + 1)} for g, s in refs.items()}
    want = {(i, g, d): model(r if d == "+" else revcomp(r), kmers[g], k, mc, step) for i, r in reads.items() for g in refs for d in "+-"}
    got = {(r["read_key"], r["group"], r["strand"]): (r["match"], r["min_err"]) for r in score.score(df, db, groups, k, mc, step).collect()}
    assert got == want
    for r in score.compare(df, db, groups, k, mc, step).collect():
        n, f, b = len(reads[r["read_key"]]), want[r["read_key"], r["group"], "+"], want[r["read_key"], r["group"], "-"]
        ok = lambda m: n > 0 and (m / n > mc or abs(m / n - mc) <= 1e-6)  # noqa: E731, B023
        label = "M_ORG" if ok(f[0]) else "M_COMP" if ok(b[0]) else "MM"
        assert (r["match"], r["min_err"], r["label"]) == (*(f if ok(f[0]) else b), label)


def one(spark, read, refs, k=8, mc=0.05, step=0):
    db = kmerdb.build(spark.createDataFrame([("g", refs)], "group string, seq string"), k)
    return score.compare(spark.createDataFrame([(1, read)], "read_key long, seq string"), db, spark.createDataFrame([("g",)], "group string"), k, mc, step).first()


REF = "ACGTTGCAACCGGTATTCAGGACCATAGACCTTGAGCATCCGATAG"


def test_exact_substring_and_its_reverse_complement(spark):
    r = one(spark, REF[5:35], REF)
    assert (r["match"], r["min_err"], r["label"]) == (30, 0, "M_ORG")
    r = one(spark, revcomp(REF[5:35]), REF)
    assert (r["match"], r["min_err"], r["label"]) == (30, 0, "M_COMP")


def test_short_and_empty_reads(spark):
    assert one(spark, REF[:7], REF)[3:] == (0, 0, "MM")
    assert one(spark, "", REF)[3:] == (0, 0, "MM")


def test_one_substitution(spark):
    read = REF[:20] + ("A" if REF[20] != "A" else "C") + REF[21:]
    r = one(spark, read, REF, step=1)
    assert (r["match"], r["min_err"]) == (len(REF) - 1, 1)


def test_last_window_is_no_probe(spark):
    """The only hit is at a multiple of the step, at the read's very end."""
    read = "T" * 8 + REF[:8]
    assert one(spark, read, REF)["match"] == 0
    assert one(spark, read, REF, step=1)["match"] == 8


def test_lower_case_and_other_signs(spark):
    assert one(spark, REF[3:30].lower(), REF)["match"] == 27
    assert one(spark, REF[3:12] + "-" + REF[13:30], REF, step=1)["match"] == one(spark, REF[3:12] + "N" + REF[13:30], REF, step=1)["match"]


def test_counts_saturate_and_code_round_trip(spark):
    df = spark.createDataFrame([("g", "A" * 400 + "C")], "group string, seq string")
    got = {r["kmer"]: r["cnt"] for r in kmerdb.build(df, 12).collect()}
    assert got == {0: 255, 1: 1}
    assert {r["kmer"]: r["cnt"] for r in kmerdb.written_out(kmerdb.build(df, 12), 12).collect()} == {"A" * 12: 255, "A" * 11 + "C": 1}
    assert spark.range(1).select(dna.kmer_code(F.lit("T" * 31))).first()[0] == 4**31 - 1


@pytest.mark.parametrize("k,alphabet", [(8, "ACGT"), (12, "ACGTTGCANA"), (30, "ACGT"), (31, "ACGTACGTACGTCCN")])
def test_tiles_give_each_place_once(spark, k, alphabet):
    rng = random.Random(k)
    seqs = {n: "".join(rng.choice(alphabet) for _ in range(n)) for n in (0, k - 1, k, 30, 32, 61, 62, 63, 93, 94, 500)}
    df = spark.createDataFrame(list(seqs.items()), "n int, seq string")
    got = sorted((r["n"], r["pos"], r["kmer"], r["next_valid"]) for r in dna.explode_kmers(df, k).withColumn("kmer", dna.kmer_text(F.col("kmer"), k)).collect())
    assert got == sorted((n, p, s[p : p + k], p + k < n and s[p + k] != "N") for n, s in seqs.items() for p in range(n - k + 1) if "N" not in s[p : p + k])
    places = dna.explode_kmers(df, k, valid_only=False)
    assert (places.count(), places.filter("valid").count()) == (sum(max(0, n - k + 1) for n in seqs), len(got))


def test_long_sequences_take_linear_time(spark, tmp_path):
    took = {}
    for n in (100_000, 500_000, 2_000_000):  # the first one compiles
        spark.range(1).select(F.repeat(F.lit("ACGTTGCATG"), n // 10).alias("seq")).write.parquet(f"{tmp_path}/{n}")
        began = time.time()
        assert dna.explode_kmers(spark.read.parquet(f"{tmp_path}/{n}"), 24).agg(F.count(F.lit(1)), F.max("kmer")).first()[0] == n - 23
        took[n] = time.time() - began
    assert took[2_000_000] < 8 * took[500_000]  # four times the length


@pytest.mark.parametrize("k,cutoff,step,similarity,mismatches", [(8, 5, 0, 100, True), (8, 90, 1, 60, False), (12, 30, 1, 80, True), (8, 0, 1, 100, False)])
def test_rows_of_hits_assign_like_all_rows(spark, k, cutoff, step, similarity, mismatches):
    rng = random.Random(k + cutoff)
    refs, reads = random_case(rng, k)
    refs["none"] = "T" * 40
    df = spark.createDataFrame(list(reads.items()), "read_key long, seq string")
    db = kmerdb.build(spark.createDataFrame(list(refs.items()), "group string, seq string"), k)
    groups = spark.createDataFrame([(g,) for g in refs], "group string")
    settings = pipeline.Settings(k=k, cutoff=cutoff, step=step, similarity=similarity, mismatches=mismatches)
    dense = assign.candidates(score.compare(df, db, groups, k, cutoff / 100, step), similarity, mismatches)
    sparse = pipeline.classify(df, db, settings, groups)
    rows = lambda x: sorted(map(tuple, x.collect()))
    dense, sparse = (spark.createDataFrame(x.collect(), x.schema) for x in (dense, sparse))
    for f in (lambda x: assign.assign(x, assign.ALL), assign.assign, assign.unclassified, assign.multiclass, assign.tie_histogram):
        assert rows(f(sparse)) == rows(f(dense))
    if cutoff:
        n = df.agg(F.count(F.lit(1))).scalar()
        assert rows(score.alignment_counts_of_hits(score.compare_hits(df, db, k, cutoff / 100, step), groups, n)) == rows(score.alignment_counts(score.compare(df, db, groups, k, cutoff / 100, step)))


def test_assignment_has_no_cross_join(spark):
    df = spark.createDataFrame([(1, REF)], "read_key long, seq string")
    db = kmerdb.build(spark.createDataFrame([("g", REF)], "group string, seq string"), 8)
    plan = pipeline.classify(df, db, pipeline.Settings(k=8))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_k_out_of_range(spark):
    with pytest.raises(ValueError):
        kmerdb.build(spark.createDataFrame([("g", REF)], "group string, seq string"), 32)


def test_ties_and_policies(spark):
    rows = spark.createDataFrame([(1, "a", 10, 3, "M_ORG"), (1, "b", 10, 1, "M_ORG"), (1, "c", 9, 0, "MM"), (2, "a", 0, 0, "MM"), (2, "b", 0, 0, "MM"), (3, "a", 7, 0, "M_COMP")], "read_key int, group string, match int, min_err int, label string")
    kept = assign.candidates(rows)
    assert {(r[0], r[1]) for r in assign.assign(kept).collect()} == {(3, "a")}
    assert {(r[0], r[1]) for r in assign.assign(kept, assign.ALL).collect()} == {(1, "a"), (1, "b"), (3, "a")}
    assert len(assign.assign(kept, assign.ONE).collect()) == 2
    assert {(r[0], r[1]) for r in assign.assign(assign.candidates(rows, 90), assign.ALL).collect()} == {(1, "a"), (1, "b"), (1, "c"), (3, "a")}
    assert [r[0] for r in assign.unclassified(kept).collect()] == [2]
    assert {(r[0], r[1]) for r in assign.tie_histogram(kept).collect()} == {(2, 2), (1, 1)}
    assert [(r[0], r[1]) for r in assign.rank(rows).filter("place = 1 and read_key = 1").select("read_key", "group").collect()] == [(1, "b")]
    assert assign.candidates(rows, 100, False).filter("read_key = 2").isEmpty()


def test_database_algebra(spark):
    d = lambda *x: spark.createDataFrame([("g", k, c) for k, c in x], "group string, kmer string, cnt int")
    a, b = d(("AA", 200), ("AC", 1)), d(("AA", 100), ("AG", 2))
    got = lambda x: {(r["kmer"], r.asDict().get("cnt")) for r in x.collect()}
    assert got(kmerdb.union([a, b])) == {("AA", 255), ("AC", 1), ("AG", 2)}
    assert got(kmerdb.intersect(a, b)) == {("AA", 100)}
    assert got(kmerdb.subtract(a, b)) == {("AC", 1)}
