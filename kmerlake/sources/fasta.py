"""FASTA files, list files, score files and taxonomy dumps as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import read_key

_LINES = r"\r?\n"


def _order(spark: SparkSession, paths: list[str]) -> Column:
    """Where a row stands: the file's place in the list, the file, the part of the file that was read, the row in that part."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    full = lambda p: path(p).getFileSystem(conf).makeQualified(path(p)).toString()
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    listed = F.array_position(F.array(*[bare(F.lit(full(p))) for p in paths]), bare(F.col("_metadata.file_path")))
    return F.struct(listed.alias("listed"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, header (with its >), seq (lines joined), wrapped (its lines as they stood), place: a row per record; rows in the order of place stand as in the files.

    A record begins with a > at the start of a line; a header may hold more of them. Files begin with a record, after empty lines
    at most, and are split between records, so one large file is read by many tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.text(paths, lineSep="\n>").select(F.input_file_name().alias("file"), "value", _order(spark, paths).alias("place"))
    # The first record of a file has its > still; empty lines before it are a part of their own.
    rows = rows.withColumn("value", F.regexp_replace("value", "^>", "")).filter(F.length(F.trim(F.regexp_replace("value", r"[\r\n]", ""))) > 0)
    lines = F.split(F.col("value"), _LINES)
    body = F.filter(F.transform(F.slice("lines", 2, F.size("lines")), lambda x: F.regexp_replace(x, r"[\x00-\x1f]", "")), lambda x: x != "")
    found = rows.withColumn("lines", lines).withColumn("body", body)
    return found.select("file", F.concat(F.lit(">"), F.element_at("lines", 1)).alias("header"), F.array_join("body", "").alias("seq"), F.array_join("body", "\n").alias("wrapped"), "place")


def as_reads(fasta: DataFrame) -> DataFrame:
    """read_key, title, seq, wrapped, place. The title ends at the first control sign; every sign of a sequence is a place of it."""
    title = F.regexp_replace("header", r"[\x00-\x1f].*$", "")
    return fasta.select(read_key(F.substring(title, 2, 1 << 30)).alias("read_key"), title.alias("title"), "seq", "wrapped", "place")


def last_by_key(reads: DataFrame, order: Column | str, key: str = "read_key") -> DataFrame:
    """One row per key, the last by order: how a map loaded from a file with repeated headers ends up."""
    rest = [c for c in reads.columns if c != key]
    return reads.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def read_list(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """pos (from 0) and name for the lines of a list file, which is small and read whole; empty lines don't count."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", _LINES), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", name))
    return rows


def zip_lists(files: DataFrame, groups: DataFrame) -> DataFrame:
    """pos, file, group of two lists that lie side by side; lists of different lengths are an error."""
    n, m = files.count(), groups.count()
    if n != m:
        raise ValueError(f"{n} files, but {m} groups")
    return files.join(groups, "pos")


def read_gi_map(spark: SparkSession, path: str) -> DataFrame:
    """gi, tax_id, seq_no: white space between two numbers; seq_no rises with the place in the file."""
    rows = spark.read.text(path).withColumn("seq_no", _order(spark, [path]))
    parts = F.split(F.trim("value"), r"\s+")
    return rows.select(parts[0].try_cast("bigint").alias("gi"), parts[1].try_cast("bigint").alias("tax_id"), "seq_no").filter("gi is not null")


def _dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t?\|$", ""), r"\t\|\t").alias("c"))


def read_taxonomy(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(tax_id, parent_id, rank) and the scientific (tax_id, name) of two dump files."""
    c = F.col("c")
    node = _dump(spark, nodes).select(c[0].cast("bigint").alias("tax_id"), c[1].cast("bigint").alias("parent_id"), F.trim(c[2]).alias("rank"))
    name = _dump(spark, names).filter(F.trim(c[3]) == "scientific name").select(c[0].cast("bigint").alias("tax_id"), F.trim(c[1]).alias("name"))
    return node, name


#: Fixed format of a score row.
SCORE_FIELDS = r"Min_err:\s*(-?[0-9]+)\s+Match:\s*(-?[0-9]+)\s+(.*)$"


def parse_scores(lines: DataFrame, value: str = "value") -> DataFrame:
    """read_key, match, min_err, label of score rows; other lines are left out."""
    found = lines.filter(F.col(value).rlike(SCORE_FIELDS))
    part = lambda i: F.regexp_extract(value, SCORE_FIELDS, i)
    title, label = F.regexp_replace(part(3), r"[ \t]*(M_ORG|M_COMP|MM)[ \t]*$", ""), F.regexp_extract(part(3), r"(M_ORG|M_COMP|MM)[ \t]*$", 1)
    return found.select(read_key(F.regexp_replace(title, "^>", "")).alias("read_key"), part(2).cast("int").alias("match"), part(1).cast("int").alias("min_err"), label.alias("label"))


def read_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_scores(spark.read.text(path))
