"""Assigning reads to groups: order, similarity cut, ties, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .score import MISMATCH, label_without_hits

UNIQUE, ONE, ALL = -1, 0, 1


def candidates(rows: DataFrame, similarity: int = 100, mismatches: bool = True, key: str = "read_key") -> DataFrame:
    """The rows of each read whose match is at least similarity percent of its best, rounded down; with best and n_groups.

    mismatches False leaves MM rows out, and with them reads that have no other row. Errors don't count here.
    """
    rows = rows if mismatches else rows.filter(F.col("label") != MISMATCH)
    w = Window.partitionBy(key)
    best = rows.withColumn("best", F.max("match").over(w))
    kept = best.filter(F.col("match") >= F.floor(F.col("best") * similarity / 100))
    return kept.withColumn("n_groups", F.count(F.lit(1)).over(w))


def candidates_of_hits(rows: DataFrame, reads: DataFrame, n_groups: Column, k: int, similarity: int = 100, mismatches: bool = True, mc: float = 0.05, key: str = "read_key", group: str = "group") -> DataFrame:
    """The candidates among the rows of compare_hits(), with best and n_groups as candidates() gives them.

    A read without a match in any group has one row here, with group null, in place of a row for every group. reads: key and len of
    all reads, a row each; n_groups: the number of groups. A similarity so small that rows without a hit pass is refused.
    """
    if similarity * k < 100:
        raise ValueError("a similarity that rows without a match pass needs all rows: use candidates()")
    rows = rows.select(key, group, "len", "match", "min_err", "label", F.lit(False).alias("_alone"))
    rows = rows if mismatches else rows.filter(F.col("label") != MISMATCH)
    alone = reads.select(key, F.lit(None).cast(rows.schema[group].dataType).alias(group), "len", F.lit(0).alias("match"), F.lit(None).cast("int").alias("min_err"), label_without_hits(F.col("len"), mc).alias("label"), F.lit(True).alias("_alone"))
    alone = alone if mismatches else alone.filter(F.col("label") != MISMATCH)
    w = Window.partitionBy(key)
    best = rows.unionAll(alone).withColumn("best", F.max("match").over(w))
    kept = best.filter(F.when(F.col("_alone"), F.col("best") == 0).otherwise((F.col("best") > 0) & (F.col("match") >= F.floor(F.col("best") * similarity / 100))))
    return kept.withColumn("n_groups", F.when(F.col("_alone"), n_groups).otherwise(F.count(F.lit(1)).over(w))).drop("_alone")


def rank(rows: DataFrame, key: str = "read_key", group: str = "group") -> DataFrame:
    """place: by match, falling, then errors, then the group's name."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("match"), "min_err", group)))


def tie_hash(key: str, group: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(group).cast("string")))


def assign(kept: DataFrame, policy: int = UNIQUE, key: str = "read_key", group: str = "group") -> DataFrame:
    """key, group, match, min_err of candidates whose best match isn't 0.

    UNIQUE: reads with one candidate. ALL: every candidate. ONE: one of them, chosen by a hash of read and group, the same on every run.
    """
    rows = kept.filter("best > 0")
    if policy == UNIQUE:
        rows = rows.filter("n_groups = 1")
    elif policy == ONE:
        rows = rows.groupBy(key).agg(F.min_by(F.struct(group, "match", "min_err"), tie_hash(key, group)).alias("x")).select(key, "x.*")
    return rows.select(key, group, "match", "min_err")


def unclassified(kept: DataFrame, key: str = "read_key") -> DataFrame:
    """Reads whose best match is 0."""
    return kept.filter("best = 0").select(key).distinct()


def multiclass(kept: DataFrame, key: str = "read_key", group: str = "group") -> DataFrame:
    """Rows of reads with several candidates."""
    return kept.filter("best > 0 and n_groups > 1").select(key, group, "match", "min_err", "n_groups")


def tie_histogram(kept: DataFrame, key: str = "read_key") -> DataFrame:
    """n_groups, n_reads; reads whose best match is 0 count, too."""
    return kept.select(key, "n_groups").distinct().groupBy("n_groups").agg(F.count(F.lit(1)).alias("n_reads"))


def scored_reads(rows: DataFrame, key: str = "read_key") -> DataFrame:
    """One row: the number of reads with any score row."""
    return rows.agg(F.countDistinct(key).alias("n_reads"))


def check_truth(assigned: DataFrame, truth: str = "truth", group: str = "group") -> DataFrame:
    """verdict: TP if the group's name holds the truth tag, FP if not, NK without a tag."""
    return assigned.withColumn("verdict", F.when(F.col(truth).isNull(), "NK").when(F.col(group).contains(F.col(truth)), "TP").otherwise("FP"))


def confusion(checked: DataFrame, kept: DataFrame, policy: int = UNIQUE, key: str = "read_key") -> DataFrame:
    """One row: tp, fp, nk, not_known, multi. Under UNIQUE, reads with several candidates are not known, as are those with best 0."""
    n = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0)).alias(v.lower())
    reads = kept.select(key, "best", "n_groups").distinct()
    several = (F.col("best") > 0) & (F.col("n_groups") > 1)
    lost = (F.col("best") == 0) | (several if policy == UNIQUE else F.lit(False))
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    # Two tables of one row each.
    return checked.agg(n("TP"), n("FP"), n("NK")).crossJoin(reads.agg(total(lost).alias("not_known"), total(several).alias("multi")))


def with_sequences(assigned: DataFrame, reads: DataFrame, key: str = "read_key") -> tuple[DataFrame, DataFrame]:
    """Assigned rows with their reads, and those whose read is missing."""
    return assigned.join(reads, key), assigned.join(reads.select(key), key, "left_anti")
