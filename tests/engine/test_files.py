"""FASTA and list files, outputs, a whole run, and streamed reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kmerlake.functions import headers as H
from kmerlake.operators import assign, kmerdb, taxonomy
from kmerlake.plans import pipeline
from kmerlake.sources import fasta, sinks
from kmerlake.streaming.classify import classify_stream


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">gi|7|x one\nACGT\nAC\r\nG\n>two <name|T|\t tail\n\nTT\n>three\n")
    got = {r["header"]: r["seq"] for r in fasta.read_fasta(spark, path).collect()}
    assert got == {">gi|7|x one": "ACGTACG", ">two <name|T|\t tail": "TT", ">three": ""}
    reads = {r["read_key"]: (r["title"], r["seq"]) for r in fasta.as_reads(fasta.read_fasta(spark, path)).collect()}
    assert reads == {"gi|7|x one": (">gi|7|x one", "ACGTACG"), "two": (">two <name|T|", "TT"), "three": (">three", "")}


def test_headers_may_hold_more_signs(spark, tmp_path):
    path = write(tmp_path / "a.fa", "\n>r1 5->3 strand\nACGT\nAC\r\n>two>three\r\nTT\n\nGG\n>last")
    got = [(r["header"], r["seq"], r["wrapped"]) for r in fasta.read_fasta(spark, path).orderBy("place").collect()]
    assert got == [(">r1 5->3 strand", "ACGTAC", "ACGT\nAC"), (">two>three", "TTGG", "TT\nGG"), (">last", "", "")]


def test_the_last_of_equal_keys_is_that_of_the_last_file(spark, tmp_path):
    files = [write(tmp_path / n, f">same\n{s}\n>own{n}\nA\n>same\n{s}{s}\n") for n, s in (("z.fa", "AC"), ("a.fa", "GGGGGGGGGG"), ("m.fa", "T"))]
    for order in (files, files[::-1], [files[1], files[0], files[2]]):
        rows = fasta.as_reads(fasta.read_fasta(spark, order))
        got = {r["read_key"]: r["seq"] for r in fasta.last_by_key(rows, "place").collect()}
        assert got["same"] == {"z": "ACAC", "a": "G" * 20, "m": "TT"}[order[-1].rsplit("/", 1)[-1][0]]


def test_records_are_whole_where_a_file_is_split(spark, tmp_path):
    want = [(f">r{i} a>b", "ACGT" * (i % 40)) for i in range(3000)]
    path = write(tmp_path / "a.fa", "".join(f"{h}\n{s}\n" for h, s in want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        rows = fasta.read_fasta(spark, path)
        assert rows.rdd.getNumPartitions() > 5
        assert [(r["header"], r["seq"]) for r in rows.orderBy("place").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fasta_round_trip(spark, tmp_path):
    rows = [("g1", ">a", "ACGT" * 40), ("g1", ">b", "A" * 65), ("g/2", ">c", "")]
    df = spark.createDataFrame(rows, "group string, header string, seq string")
    sinks.write_fasta(df, str(tmp_path / "out"), "group")
    back = fasta.read_fasta(spark, [str(tmp_path / "out" / p) for p in ("group=g1", "group=g%2F2")])
    assert sorted((r["header"], r["seq"]) for r in back.collect()) == sorted(r[1:] for r in rows)


def test_lists(spark, tmp_path):
    files, groups = write(tmp_path / "f", "a.out\n\nb.out\n"), write(tmp_path / "g", "x\ny\n")
    got = fasta.zip_lists(fasta.read_list(spark, files, "file"), fasta.read_list(spark, groups, "group"))
    assert {tuple(r) for r in got.collect()} == {(0, "a.out", "x"), (1, "b.out", "y")}
    with pytest.raises(ValueError):
        fasta.zip_lists(fasta.read_list(spark, files, "file"), fasta.read_list(spark, write(tmp_path / "h", "x\n"), "group"))


def test_gi_map_and_annotation(spark, tmp_path):
    m = fasta.read_gi_map(spark, write(tmp_path / "m", "7\t70\n8  80\n7 71\n"))
    seqs = spark.createDataFrame([(">gi|7|a",), (">gi|9|b",), (">none",)], "header string")
    assert {r["header"] for r in taxonomy.annotate(seqs, m).collect()} == {">gi|7|a <idTAX|71| ", ">gi|9|b", ">none"}


def test_taxonomy_dumps(spark, tmp_path):
    nodes = write(tmp_path / "nodes", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tphylum\t|\n3\t|\t2\t|\tgenus\t|\n4\t|\t3\t|\tspecies\t|\n5\t|\t1\t|\tspecies\t|\n")
    names = write(tmp_path / "names", "2\t|\tP/x\t|\t\t|\tscientific name\t|\n2\t|\tother\t|\t\t|\tsynonym\t|\n3\t|\tG\t|\t\t|\tscientific name\t|\n")
    n, m = fasta.read_taxonomy(spark, nodes, names)
    got = {r["tax_id"]: (r["anc_id"], r["anc_name"]) for r in taxonomy.at_rank(taxonomy.lineage(n), m, "phylum").collect()}
    assert got == {1: (None, "undef"), 2: (2, "P/x"), 3: (2, "P/x"), 4: (2, "P/x"), 5: (None, "undef")}
    loop = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "tax_id long, parent_id long, rank string")
    with pytest.raises(ValueError):
        taxonomy.lineage(loop)


def test_parent_ranks():
    assert [taxonomy.parent_rank(r) for r in ("superkingdom", "phylum", "species")] == ["no", "superkingdom", "genus"]


def test_group_names(spark):
    rows = [("P", 1, "C", 2, "P_C_idTAX2"), ("P", 1, "undef", None, "P_undef_idTAX77"), ("undef", None, "C", 2, "undef_idPREV77_C_idTAX2"), (None, None, "C", 2, "notknow_in"), ("A/B", 1, "C", 2, "A=B_C_idTAX2")]
    df = spark.createDataFrame(rows, "n1 string, i1 long, n2 string, i2 long, want string")
    out = df.withColumn("got", taxonomy.group_name(F.col("n1"), F.col("i1"), F.col("n2"), F.col("i2"), F.lit("77"), F.lit("in")))
    assert all(r["got"] == r["want"] for r in out.collect())


def test_output_names(spark):
    assert spark.range(1).select(H.output_name(F.lit("/a/b/set.x.fa"), F.lit("NW_db"), 24, 5)).first()[0] == "set_NW_db_k24_mc5"


def test_missing_read_is_told(spark):
    a = spark.createDataFrame([(1, "g"), (2, "g")], "read_key int, group string")
    found, lost = assign.with_sequences(a, spark.createDataFrame([(1, "ACGT")], "read_key int, seq string"))
    assert [r["read_key"] for r in found.collect()] == [1] and [r["read_key"] for r in lost.collect()] == [2]


def tree(rng):
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    return [("P1", "C1", make(200)), ("P1", "C2", make(200)), ("P2", "C3", make(200)), ("P2", None, make(200))]


def test_run_down_the_ranks_and_resume(spark, tmp_path):
    seqs = tree(random.Random(3))
    df = spark.createDataFrame(seqs, "phylum string, class string, seq string")
    reads = spark.createDataFrame([(i, s[2][20:90]) for i, s in enumerate(seqs)], "read_key int, seq string")
    settings = pipeline.Settings(k=12)
    out = pipeline.run(spark, df, reads, ["phylum", "class"], str(tmp_path), settings)
    assert {(r["read_key"], r["group"]) for r in out["phylum"].collect()} == {(0, "P1"), (1, "P1"), (2, "P2"), (3, "P2")}
    assert {(r["read_key"], r["group"], r["match"]) for r in out["class"].collect()} == {(0, "C1", 70), (1, "C2", 70), (2, "C3", 70), (3, "undef_idPREVP2", 70)}
    # A second run reads the first one's tables, whatever it is given.
    again = pipeline.run(spark, df.limit(0), reads.limit(0), ["phylum", "class"], str(tmp_path), settings)
    assert again["class"].count() == 4


def test_assignment_outputs(spark, tmp_path):
    seqs = tree(random.Random(4))
    db = kmerdb.build(spark.createDataFrame([(p, s) for p, _, s in seqs], "group string, seq string"), 12)
    kmerdb.write(db, str(tmp_path / "db"))
    db = kmerdb.read(spark, str(tmp_path / "db"))
    reads = spark.createDataFrame([("a", ">a", seqs[0][2][:60], "P1"), ("b", ">b", seqs[2][2][:60], "P1"), ("c", ">c", "A" * 60, None)], "read_key string, title string, seq string, truth string")
    kept = pipeline.classify(reads, db, pipeline.Settings(k=12))
    sinks.write_assignment(kept, reads, str(tmp_path / "out"))
    assert {(r["read_key"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out/verdict")).collect()} == {("a", "TP"), ("b", "FP")}
    assert [r["header"] for r in fasta.read_fasta(spark, str(tmp_path / "out/notknow")).collect()] == [">c"]
    assert [r["header"] for r in fasta.read_fasta(spark, str(tmp_path / "out/groups/group=P1")).collect()] == [">a"]
    c = assign.confusion(assign.check_truth(assign.with_sequences(assign.assign(kept), reads)[0]), kept).first()
    assert (c["tp"], c["fp"], c["nk"], c["not_known"], c["multi"]) == (1, 1, 0, 1, 0)
    sinks.append_report(sinks.build_report(db, "group", 12, 1.5), str(tmp_path / "report"))
    sinks.append_report(sinks.build_report(db, "group", 12, 2.5), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == 4


def test_streamed_reads(spark, tmp_path):
    seqs = tree(random.Random(5))
    db = kmerdb.build(spark.createDataFrame([(p, s) for p, _, s in seqs], "group string, seq string"), 12)
    (tmp_path / "in").mkdir()
    reads = spark.createDataFrame([(i, s[2][30:99]) for i, s in enumerate(seqs)], "read_key int, seq string")
    reads.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    classify_stream(stream, db, str(tmp_path / "out"), str(tmp_path / "check"), pipeline.Settings(k=12)).awaitTermination()
    assert {(r["read_key"], r["group"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, "P1"), (1, "P1"), (2, "P2"), (3, "P2")}
