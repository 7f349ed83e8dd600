"""k-mer databases: one row for each group and k-mer, a number, with its count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import BASES, check_k, explode_kmers, kmer_text

#: A count takes one byte.
COUNT_MAX = 255


def saturate(count: Column) -> Column:
    return F.least(count, F.lit(COUNT_MAX)).cast("int")


def count_kmers(seqs: DataFrame, k: int, group: str | list[str] = "group", seq: str = "seq") -> DataFrame:
    """group, kmer, cnt (not saturated). Counting begins before the exchange, so a frequent k-mer crosses it once a task."""
    groups = [group] if isinstance(group, str) else group
    kmers = explode_kmers(seqs.select(*groups, F.col(seq).alias("seq")), check_k(k))
    return kmers.groupBy(*groups, "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def build(seqs: DataFrame, k: int, group: str | list[str] = "group", seq: str = "seq", min_count: int = 1) -> DataFrame:
    """A database: group, kmer, cnt up to 255. min_count leaves out rarer k-mers."""
    return count_kmers(seqs, k, group, seq).filter(F.col("cnt") >= min_count).withColumn("cnt", saturate(F.col("cnt")))


def written_out(db: DataFrame, k: int) -> DataFrame:
    """The same with k-mers as text."""
    return db.withColumn("kmer", kmer_text(F.col("kmer"), k))


def members(seqs: DataFrame, k: int, wanted: DataFrame, group: str | list[str] = "group", seq: str = "seq") -> DataFrame:
    """group, kmer without repeats, for the k-mers in wanted only: all that comparing a read set with fresh sequences needs.

    The semi-join comes before the exchange; Spark broadcasts wanted if it is small enough, and else sorts both sides.
    """
    groups = [group] if isinstance(group, str) else group
    kmers = explode_kmers(seqs.select(*groups, F.col(seq).alias("seq")), check_k(k))
    return kmers.join(wanted.select("kmer").distinct(), "kmer", "left_semi").select(*groups, "kmer").distinct()


def stats(counts: DataFrame, group: str = "group") -> DataFrame:
    """Of unsaturated counts: n_total, n_unique, n_singletons, n_repeated by group."""
    c = F.col("cnt")
    return counts.groupBy(group).agg(
        F.sum(c).cast("long").alias("n_total"), F.count(F.lit(1)).alias("n_unique"),
        F.sum((c == 1).cast("long")).alias("n_singletons"), F.sum((c > 1).cast("long")).alias("n_repeated"),
    )


def code_of(kmer: str) -> int:
    return sum(BASES.index(b) << 2 * i for i, b in enumerate(reversed(kmer)))


def special_kmers(k: int) -> dict[str, int]:
    """The k-mers that low-complexity sequence is full of."""
    return {n: code_of(s) for n, s in {"all_a": "A" * k, "all_t": "T" * k, "all_c": "C" * k, "a_then_g": "A" * (k - 1) + "G"}.items()}


def special_counts(counts: DataFrame, k: int, group: str = "group") -> DataFrame:
    return counts.groupBy(group).agg(*[F.coalesce(F.sum(F.when(F.col("kmer") == s, F.col("cnt"))), F.lit(0)).cast("long").alias(n) for n, s in special_kmers(k).items()])


def prefix_histogram(counts: DataFrame, k: int, bases: int = 4) -> DataFrame:
    """k-mers and occurrences by prefix."""
    sums = counts.groupBy(F.shiftright("kmer", 2 * (k - bases)).alias("prefix")).agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("cnt").cast("long").alias("n_total"))
    return sums.withColumn("prefix", kmer_text(F.col("prefix"), bases))


def union(databases: list[DataFrame], group: str = "group") -> DataFrame:
    """One database of several: counts of the same group and k-mer add up, to 255 at most."""
    merged = reduce(DataFrame.unionByName, databases)
    return merged.groupBy(group, "kmer").agg(saturate(F.sum("cnt")).alias("cnt"))


def intersect(a: DataFrame, b: DataFrame, group: str = "group") -> DataFrame:
    """k-mers in both, with the smaller count."""
    return a.join(b.withColumnRenamed("cnt", "_cnt"), [group, "kmer"]).select(group, "kmer", F.least("cnt", "_cnt").alias("cnt"))


def subtract(a: DataFrame, b: DataFrame, group: str = "group") -> DataFrame:
    return a.join(b.select(group, "kmer"), [group, "kmer"], "left_anti")


def write(db: DataFrame, path: str, group: str = "group", mode: str = "error") -> None:
    """Parquet by group, each file a range of k-mers in order, so that a reader of one group opens only its folder and k-mer ranges prune files.

    Ranges are cut by sampled quantiles: a group that holds most of the k-mers, or a frequent prefix, is spread over many tasks.
    """
    db.repartitionByRange(group, "kmer").sortWithinPartitions(group, "kmer").write.mode(mode).partitionBy(group).parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
