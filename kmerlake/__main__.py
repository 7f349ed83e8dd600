"""Commands: python -m kmerlake annotate | divide | build | compare | assign | count | run."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.headers import truth_tag
from .operators import assign as A
from .operators import kmerdb, taxonomy
from .operators.score import alignment_counts, compare
from .plans import pipeline
from .shared import drop_staged, staged
from .sources import fasta, sinks

ALL_FILES = "a file that lists files, one a line"


def _paths(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Files named one by one, and those of a list."""
    return [*args.fasta, *([r["name"] for r in fasta.read_list(spark, args.list).collect()] if args.list else [])]


def _reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Of reads with the same key the last one in file order counts."""
    rows = fasta.as_reads(fasta.read_fasta(spark, paths))
    return fasta.last_by_key(rows, "place").drop("place").withColumn("truth", truth_tag(F.col("title")))


def _reads_name(args: argparse.Namespace) -> str:
    return ",".join([*args.fasta, *([args.list] if args.list else [])])


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.time()
    seqs = fasta.read_fasta(spark, _paths(spark, args)).select(F.lit(args.group).alias("group"), "seq")
    counts = staged(kmerdb.count_kmers(seqs, args.k), "counts")
    kmerdb.write(counts.filter(F.col("cnt") >= args.min_count).withColumn("cnt", kmerdb.saturate(F.col("cnt"))), f"{args.out}/db", mode="append")
    report = sinks.build_report(counts, "group", args.k).withColumn("n_seqs", F.lit(seqs.count())).withColumn("min_count", F.lit(args.min_count))
    sinks.append_report(report, f"{args.out}/report", began)
    drop_staged(spark)


def compare_reads(spark: SparkSession, args: argparse.Namespace) -> None:
    db = kmerdb.read(spark, f"{args.db}/db")
    if args.groups:
        from .functions.headers import contains_any

        db = db.filter(contains_any(F.col("group"), args.groups))
    began = time.time()
    rows = compare(_reads(spark, _paths(spark, args)).select("read_key", "seq"), db, db.select("group").distinct(), args.k, args.cutoff / 100, args.step)
    sinks.write_scores(rows, f"{args.out}/scores")
    done = spark.read.parquet(f"{args.out}/scores")
    report = alignment_counts(done).withColumn("k", F.lit(args.k)).withColumn("cutoff", F.lit(args.cutoff))
    sinks.append_report(report.withColumn("reads", F.lit(_reads_name(args))).withColumn("database", F.lit(args.db)), f"{args.out}/report", began)


def assign(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(f"{args.scores}/scores").select("read_key", "group", "len", "match", "min_err", "label")
    kept = A.candidates(rows, args.similarity, args.mismatches == 1)
    # k and the cutoff are those of the comparison.
    said = spark.read.parquet(f"{args.scores}/report").select("k", "cutoff").first()
    run = {"k": said["k"], "cutoff": said["cutoff"], "similarity": args.similarity, "mismatches": args.mismatches} if said else {}
    sinks.write_assignment(kept, _reads(spark, _paths(spark, args)), args.out, args.policy, **run)


def annotate(spark: SparkSession, args: argparse.Namespace) -> None:
    out = taxonomy.annotate(fasta.read_fasta(spark, _paths(spark, args)), fasta.read_gi_map(spark, args.gi_map))
    sinks.write_fasta(out, args.out)


def divide(spark: SparkSession, args: argparse.Namespace) -> None:
    nodes, names = fasta.read_taxonomy(spark, args.nodes, args.names)
    out = pipeline.divide(fasta.read_fasta(spark, _paths(spark, args)), nodes, names, args.upper, args.lower)
    sinks.write_fasta(out, f"{args.out}/groups", "group")
    taxonomy.count_by_taxon(out).orderBy(F.col("group").asc_nulls_last()).coalesce(1).write.mode("append").parquet(f"{args.out}/summary")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """The whole classification: databases, comparisons and assignments rank after rank, under --out. Run again, it takes up what is finished."""
    settings = pipeline.Settings(args.k, args.step, args.cutoff, args.mismatches == 1, args.policy, args.similarity)
    seqs = pipeline.at_ranks(fasta.read_fasta(spark, _paths(spark, args)), *fasta.read_taxonomy(spark, args.nodes, args.names), args.ranks)
    reads = _reads(spark, args.reads)
    out = pipeline.run(spark, seqs, reads.select("read_key", "seq"), args.ranks, args.out, settings)
    for rank in args.ranks:
        at = f"{args.out}/{rank}"
        kept = spark.read.parquet(f"{at}/rows_{settings.tag()}")
        if not pipeline.finished(spark, f"{at}/out_{settings.tag()}/histogram"):
            sinks.write_assignment(kept, reads, f"{at}/out_{settings.tag()}", args.policy, mode="overwrite", rank=rank, k=args.k, cutoff=args.cutoff, similarity=args.similarity, mismatches=args.mismatches)
        print(rank, out[rank].count())


def count(spark: SparkSession, args: argparse.Namespace) -> None:
    """Reads with any score row."""
    print(A.scored_reads(spark.read.parquet(f"{args.scores}/scores")).first()["n_reads"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerlake", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, sequences: bool = True, out: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if sequences:
            p.add_argument("fasta", nargs="*", help="FASTA files")
            p.add_argument("--list", help=ALL_FILES)
        if out:
            p.add_argument("--out", required=True, help="folder of the results")
        return p

    p = command("build", build)
    p.add_argument("--group", required=True)
    p.add_argument("--k", type=int, default=24)
    p.add_argument("--min-count", type=int, default=1)
    p = command("compare", compare_reads)
    p.add_argument("--db", required=True, help="a folder that build has written")
    p.add_argument("--groups", nargs="*", help="only groups whose name holds one of these")
    p.add_argument("--k", type=int, default=24)
    p.add_argument("--step", type=int, default=0, help="distance of the quick pass's probes; 0: k, 1: no quick pass")
    p.add_argument("--cutoff", type=int, default=5, help="percent of a read's bases")
    p = command("assign", assign)
    p.add_argument("--scores", required=True, help="a folder that compare has written")
    p.add_argument("--policy", type=int, choices=(A.UNIQUE, A.ONE, A.ALL), default=A.UNIQUE)
    p.add_argument("--similarity", type=int, default=100)
    p.add_argument("--mismatches", type=int, choices=(0, 1), default=1)
    p = command("annotate", annotate)
    p.add_argument("--gi-map", required=True)
    p = command("divide", divide)
    for name in ("--nodes", "--names", "--upper", "--lower"):
        p.add_argument(name, required=True)
    p = command("run", run)
    p.add_argument("--reads", nargs="+", required=True, help="FASTA files of reads")
    p.add_argument("--nodes", required=True)
    p.add_argument("--names", required=True)
    p.add_argument("--ranks", nargs="+", default=["phylum", "class", "order", "family", "genus"])
    p.add_argument("--k", type=int, default=24)
    p.add_argument("--step", type=int, default=0)
    p.add_argument("--cutoff", type=int, default=5)
    p.add_argument("--policy", type=int, choices=(A.UNIQUE, A.ONE, A.ALL), default=A.UNIQUE)
    p.add_argument("--similarity", type=int, default=100)
    p.add_argument("--mismatches", type=int, choices=(0, 1), default=1)
    p = command("count", count, sequences=False, out=False)
    p.add_argument("--scores", required=True)
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("kmerlake").getOrCreate(), args)


if __name__ == "__main__":
    main()
