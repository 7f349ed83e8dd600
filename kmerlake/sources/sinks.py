"""Outputs: FASTA by group, score files, assignments, reports, list files."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.headers import name_group, wrap
from ..operators import assign as A
from ..operators.score import MISMATCH


def fasta_text(header: Column, seq: Column, wrapped: Column | None = None) -> Column:
    return F.concat(header, F.lit("\n"), wrapped if wrapped is not None else wrap(seq))


def write_fasta(df: DataFrame, path: str, group: str | None = None, mode: str = "append", wrapped: str | None = None) -> None:
    """Text files of records (header, seq), in a folder per group if there is one. wrapped: a column with the lines as they stood; else they are wrapped anew."""
    text = df.select(*([group] if group else []), fasta_text(F.col("header"), F.col("seq"), F.col(wrapped) if wrapped else None).alias("value"))
    if group:
        text.repartition(group, F.pmod(F.xxhash64("value"), F.lit(8))).write.mode(mode).partitionBy(group).text(path)
    else:
        text.write.mode(mode).text(path)


def score_lines(rows: DataFrame, key: str = "read_key") -> DataFrame:
    """value: score rows in the text format that parse_scores() reads."""
    return rows.select(F.concat(F.lit("Min_err:\t"), F.col("min_err").cast("string"), F.lit("\tMatch:\t"), F.col("match").cast("string"), F.lit("\t>"), F.col(key).cast("string"), F.lit(" \t"), F.col("label")).alias("value"))


def write_scores(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One table by group and side: M for matches, MM for mismatches."""
    rows.withColumn("side", F.when(F.col("label") == MISMATCH, "MM").otherwise("M")).write.mode(mode).partitionBy("group", "side").parquet(path)


def write_assignment(kept: DataFrame, reads: DataFrame, path: str, policy: int = A.UNIQUE, key: str = "read_key", mode: str = "append", **run) -> None:
    """Under path: groups (FASTA by group), multiclass (score rows), notknow (FASTA), histogram, and, if reads have a truth, verdict (rows by
    TP, FP, NK) and summary, a row that is added for each run: tp, fp, not_known, multi, seconds, and the run's parameters as given.

    Sequences keep the lines that they had, if reads have them (wrapped).
    """
    began = time.time()
    lines = "wrapped" if "wrapped" in reads.columns else None
    assigned, _ = A.with_sequences(A.assign(kept, policy, key), reads, key)
    write_fasta(assigned.withColumnRenamed("title", "header"), f"{path}/groups", "group", mode, lines)
    A.multiclass(kept, key).write.mode(mode).parquet(f"{path}/multiclass")
    write_fasta(A.unclassified(kept, key).join(reads, key).withColumnRenamed("title", "header"), f"{path}/notknow", None, mode, lines)
    A.tie_histogram(kept, key).write.mode(mode).parquet(f"{path}/histogram")
    if "truth" in reads.columns:
        checked = A.check_truth(assigned)
        checked.select(key, "group", "match", "min_err", "verdict").write.mode(mode).partitionBy("verdict").parquet(f"{path}/verdict")
        append_report(summary(A.confusion(checked, kept, policy, key), policy=policy, **run), f"{path}/summary", began)


def summary(confusion: DataFrame, **run) -> DataFrame:
    """tp, fp, not_known, multi, and the run's parameters. Not known are also reads that were assigned but have no truth."""
    return confusion.select("tp", "fp", (F.col("nk") + F.col("not_known")).alias("not_known"), "multi", *[F.lit(v).alias(n) for n, v in run.items()])


def append_report(report: DataFrame, path: str, began: float | None = None) -> None:
    """Adds a report of a few rows to its table; seconds since began, if given."""
    if began is not None:
        report = report.withColumn("seconds", F.lit(time.time() - began))
    report.coalesce(1).write.mode("append").parquet(path)


def build_report(counts: DataFrame, group: str, k: int, seconds: float | None = None) -> DataFrame:
    from ..operators.kmerdb import stats

    return stats(counts, group).withColumn("k", F.lit(k)).withColumn("seconds", F.lit(seconds).cast("double"))


def file_lists(names: DataFrame, name: str = "name") -> DataFrame:
    """group, pos, files: neighbouring names of the same group go to one list; a group that comes again later begins another."""
    w = Window.orderBy("pos")  # the names of one folder's databases
    marked = names.withColumn("group", name_group(F.col(name))).withColumn("new", (F.lag("group").over(w).eqNullSafe(F.col("group")) == F.lit(False)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("group", "run").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", name))), lambda x: x[name]).alias("files")).drop("run")


def output_list(groups: DataFrame, reads_name: str, k: int, mc: int, mismatches: bool = True) -> DataFrame:
    """file, group: the score files of a comparison and the group each speaks of, in place of two list files."""
    ends = F.array(*[F.lit(e) for e in (["M.out", "MM.out"] if mismatches else ["M.out"])])
    return groups.select("group", F.explode(ends).alias("end")).select(F.concat(F.lit(f"{reads_name}_"), "group", F.lit(f"_k{k}_mc{mc}"), "end").alias("file"), "group")


def missing(wanted: DataFrame, present: DataFrame, on: str | list[str]) -> DataFrame:
    """What is wanted but isn't there: the log of missing databases, and what a resumed run still has to do."""
    return wanted.join(present, on, "left_anti")
