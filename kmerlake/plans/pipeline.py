"""The stages of a classification run, rank after rank, each kept as a table so that a run can be taken up again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import headers as H
from ..operators import assign as A
from ..operators import kmerdb
from ..operators.score import compare, compare_hits, errors_without_hits, label_without_hits
from ..operators.taxonomy import UNDEF, at_rank, group_name, lineage


#: The parent of the top rank's groups; a folder's name can't be empty.
ROOT = "root"


@dataclass(frozen=True)
class Settings:
    """Parameters of a run: k-mer length, probe distance (0: k), cutoff in percent, mismatches take part, tie policy, similarity in percent."""

    k: int = 24
    step: int = 0
    cutoff: int = 5
    mismatches: bool = True
    policy: int = A.UNIQUE
    similarity: int = 100

    @property
    def mc(self) -> float:
        return self.cutoff / 100

    def tag(self) -> str:
        """The part of a result's folder that tells the settings apart."""
        return f"k{self.k}_s{self.step}_mc{self.cutoff}_mm{int(self.mismatches)}_cl{self.policy}_sim{self.similarity}"


def finished(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], *partition: str) -> DataFrame:
    """A stage's table: read if an earlier run finished it, else made and written. Spark marks a finished table; a broken one is made anew."""
    if not finished(spark, path):
        writer = make().write.mode("overwrite")
        (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return spark.read.parquet(path)


def at_ranks(seqs: DataFrame, nodes: DataFrame, names: DataFrame, ranks: list[str]) -> DataFrame:
    """seqs (header, seq) with a column per rank: the name of its taxon there, from the header's tag, or null."""
    paths = lineage(nodes)
    out = seqs.select(H.taxid_from_header(F.col("header")).try_cast("bigint").alias("tax_id"), "seq")
    for rank in ranks:
        at = at_rank(paths, names, rank).filter("anc_id is not null").select("tax_id", H.sanitise_name(F.col("anc_name")).alias(rank))
        out = out.join(at, "tax_id", "left")
    return out


def divide(seqs: DataFrame, nodes: DataFrame, names: DataFrame, upper: str, lower: str) -> DataFrame:
    """seqs (file, header, seq) with tax_id, from the header's tag, and group, from its taxa at two ranks."""
    paths = lineage(nodes)
    at = lambda rank, i: at_rank(paths, names, rank).select("tax_id", F.col("anc_id").alias(f"_i{i}"), F.col("anc_name").alias(f"_n{i}"))
    tagged = seqs.withColumn("tax_id", H.taxid_from_header(F.col("header")).try_cast("bigint"))
    found = tagged.join(at(upper, 1), "tax_id", "left").join(at(lower, 2), "tax_id", "left")
    file = H.taxid_from_file(F.col("file"))
    named = group_name(F.col("_n1"), F.col("_i1"), F.coalesce("_n2", F.lit(UNDEF)), F.col("_i2"), file, H.stem(F.col("file")))
    return found.select(*seqs.columns, "tax_id", named.alias("group"))


def _lengths(reads: DataFrame) -> DataFrame:
    return reads.groupBy("read_key").agg(F.max(F.length("seq")).alias("len"))


def classify(reads: DataFrame, db: DataFrame, settings: Settings, groups: DataFrame | None = None) -> DataFrame:
    """Candidate rows of reads (read_key, seq) against a database (group, kmer). A read without a match has one row, with group null.

    Rows come from hits alone. Only a similarity so small that rows without a match pass needs a row for every read and group.
    """
    groups = (db if groups is None else groups).select("group").distinct()
    if settings.similarity * settings.k < 100:
        return A.candidates(compare(reads, db, groups, settings.k, settings.mc, settings.step), settings.similarity, settings.mismatches)
    rows = compare_hits(reads, db, settings.k, settings.mc, settings.step)
    return A.candidates_of_hits(rows, _lengths(reads), groups.agg(F.count(F.lit(1))).scalar(), settings.k, settings.similarity, settings.mismatches, settings.mc)


def classify_children(assigned: DataFrame, reads: DataFrame, db: DataFrame, settings: Settings, tree: DataFrame | None = None) -> DataFrame:
    """Reads of a parent group against that parent's children only. assigned: read_key, parent; db: parent, group, kmer; tree: parent, group, if known.

    The parent is part of the join key, so a read's k-mers only meet k-mers of its parent. A read that matches none of the
    children has a row with match 0 for each of them; other reads have rows of hits only.
    """
    if settings.similarity * settings.k < 100:
        raise ValueError("a similarity that rows without a match pass is for flat comparisons")
    own = reads.join(assigned.select("read_key", "parent"), "read_key")
    tree = (db if tree is None else tree).select("parent", "group").distinct()
    rows = compare_hits(own, db, settings.k, settings.mc, settings.step, "read_key", ["parent", "group"], ["parent"])
    rows = rows.select("read_key", F.struct("parent", "group").alias("group"), "len", "match", "min_err", "label")
    kept = A.candidates_of_hits(rows, _lengths(own), F.lit(0), settings.k, settings.similarity, settings.mismatches, settings.mc)
    lost = kept.filter("group is null").select("read_key").join(own.select("read_key", "parent", F.length("seq").alias("len")).distinct(), "read_key").join(tree, "parent")
    # As many as the read's parents have children.
    n = F.count(F.lit(1)).over(Window.partitionBy("read_key"))
    lost = lost.select("read_key", "parent", "group", "len", F.lit(0).alias("match"), errors_without_hits(F.col("len"), settings.k, settings.mc, settings.step).alias("min_err"), label_without_hits(F.col("len"), settings.mc).alias("label"), F.lit(0).alias("best"), n.alias("n_groups"))
    found = kept.filter("group is not null").select("read_key", "group.parent", "group.group", "len", "match", "min_err", "label", "best", "n_groups")
    return found.unionAll(lost)


def undef_of(parent: Column) -> Column:
    """The group of a parent's sequences without a taxon: it carries the parent's name, so that different parents' don't mix further down."""
    return F.when(parent == ROOT, UNDEF).when(parent.startswith(f"{UNDEF}_idPREV"), parent).otherwise(F.concat(F.lit(f"{UNDEF}_idPREV"), parent))


def run(spark: SparkSession, seqs: DataFrame, reads: DataFrame, ranks: list[str], path: str, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Down the ranks. seqs: seq and a column per rank with the group's name there; reads: read_key, seq.

    At each rank the reads of a group are compared with that group's children only. Databases, score rows and
    assignments are tables under path, by settings; a parent's sequences without a taxon are one group, see undef_of().
    """
    out: dict[str, DataFrame] = {}
    before: str | None = None
    seqs = seqs.withColumn("_group", F.lit(ROOT))
    for rank in ranks:
        at = f"{path}/{rank}"
        seqs = seqs.withColumn("_parent", F.col("_group")).withColumn("_group", F.coalesce(F.col(rank), undef_of(F.col("_parent"))))
        named = seqs.select(F.col("_parent").alias("parent"), F.col("_group").alias("group"), "seq")
        db = stage(spark, f"{at}/db_k{settings.k}", lambda named=named: kmerdb.build(named, settings.k, ["parent", "group"]), "parent")
        above = out[before].select("read_key", F.col("group").alias("parent")) if before else None
        kept = stage(spark, f"{at}/rows_{settings.tag()}", lambda above=above, db=db: classify(reads, db, settings) if above is None else classify_children(above, reads, db, settings))
        out[rank] = stage(spark, f"{at}/assigned_{settings.tag()}", lambda kept=kept: A.assign(kept, settings.policy))
        before = rank
    return out

