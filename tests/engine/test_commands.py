"""The commands, end to end on small files."""

from __future__ import annotations

import random

from kmerlake.__main__ import main
from kmerlake.sources import fasta


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_annotate_divide_build_compare_assign(spark, tmp_path, capsys):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    one, two, lost = make(300), make(300), make(300)
    seqs = write(tmp_path / "ref.fa", f">gi|1|x\n{one}\n>gi|2|y\n{two}\n>gi|9|z\n{lost}\n")
    main(["annotate", seqs, "--gi-map", write(tmp_path / "map", "1 30\n2 31\n"), "--out", str(tmp_path / "tagged")])
    nodes = write(tmp_path / "nodes", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tphylum\t|\n3\t|\t1\t|\tphylum\t|\n20\t|\t2\t|\tclass\t|\n30\t|\t20\t|\tspecies\t|\n31\t|\t3\t|\tspecies\t|\n")
    names = write(tmp_path / "names", "".join(f"{i}\t|\t{n}\t|\t\t|\tscientific name\t|\n" for i, n in ((2, "P"), (3, "Q"), (20, "C"))))
    main(["divide", str(tmp_path / "tagged"), "--nodes", nodes, "--names", names, "--upper", "phylum", "--lower", "class", "--out", str(tmp_path / "divided")])
    summary = {r["group"]: r["n_seqs"] for r in spark.read.parquet(str(tmp_path / "divided/summary")).collect()}
    part = [g for g in summary if g and g.startswith("notknow_")]
    assert summary["P_C_idTAX20"] == 1 and summary["Q_undef_idTAX3"] == 1 and summary[None] == 3 and len(part) == 1
    for group in ("P_C_idTAX20", "Q_undef_idTAX3"):
        main(["build", str(tmp_path / f"divided/groups/group={group}"), "--group", group, "--k", "16", "--out", str(tmp_path / "db")])
    assert spark.read.parquet(str(tmp_path / "db/report")).count() == 2
    whole = ["run", str(tmp_path / "tagged"), "--nodes", nodes, "--names", names, "--ranks", "phylum", "class", "--k", "16", "--out", str(tmp_path / "whole")]
    reads = write(tmp_path / "reads.fa", f">a <name|C|\n{one[50:150]}\n>b\n{two[10:90]}\n>c\n{make(80)}\n>a <name|C|\n{one[60:160]}\n")
    listed = write(tmp_path / "list", reads + "\n")
    main(["compare", "--list", listed, "--db", str(tmp_path / "db"), "--k", "16", "--out", str(tmp_path / "rows")])
    main(["count", "--scores", str(tmp_path / "rows")])
    assert capsys.readouterr().out.strip().endswith("3")
    main(["assign", reads, "--scores", str(tmp_path / "rows"), "--out", str(tmp_path / "out")])
    got = fasta.read_fasta(spark, str(tmp_path / "out/groups/group=P_C_idTAX20")).collect()
    assert [(r["header"], r["seq"]) for r in got] == [(">a <name|C|", one[60:160])]
    assert {(r["read_key"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out/verdict")).collect()} == {("a", "TP"), ("b", "NK")}
    s = spark.read.parquet(str(tmp_path / "out/summary")).first()
    assert (s["tp"], s["fp"], s["not_known"], s["multi"], s["k"], s["cutoff"], s["similarity"], s["policy"]) == (1, 0, 2, 0, 16, 5, 100, -1) and s["seconds"] > 0
    assert all(r["seconds"] > 0 for d in ("db", "rows") for r in spark.read.parquet(str(tmp_path / d / "report")).collect())
    main(["compare", reads, "--db", str(tmp_path / "db"), "--groups", "Q_", "--k", "16", "--out", str(tmp_path / "some")])
    assert {r["group"] for r in spark.read.parquet(str(tmp_path / "some/scores")).collect()} == {"Q_undef_idTAX3"}
    wrapped = write(tmp_path / "wrapped.fa", f">a>1\n{one[:50]}\n{one[50:80]}\n>b\n{two[:90]}\n")
    for _ in range(2):  # the second run takes up the first one's tables
        main([*whole, "--reads", wrapped])
        assert capsys.readouterr().out.split("\n")[-3:-1] == ["phylum 2", "class 2"]
    text = [r["value"] for p in ("P", "Q") for r in spark.read.text(str(tmp_path / f"whole/phylum/out_k16_s0_mc5_mm1_cl-1_sim100/groups/group={p}")).collect()]
    assert sorted(text) == sorted([">a>1", one[:50], one[50:80], ">b", two[:90]])
    assert {(r["read_key"], r["group"]) for r in spark.read.parquet(str(tmp_path / "whole/class/assigned_k16_s0_mc5_mm1_cl-1_sim100")).collect()} == {("a>1", "C"), ("b", "undef_idPREVQ")}
