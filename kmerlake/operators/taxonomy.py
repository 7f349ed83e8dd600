"""Taxon annotation, lineages and the division of sequences by taxon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import append_tax_tag, extract_gi, sanitise_name
from ..shared import staged

#: Fixed order of ranks, from the top.
RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")
UNDEF = "undef"


def parent_rank(rank: str) -> str:
    return RANKS[RANKS.index(rank) - 1] if rank in RANKS[1:] else "no"


def annotate(seqs: DataFrame, gi_map: DataFrame, header: str = "header") -> DataFrame:
    """seqs with gi, tax_id and a header that names the taxon; sequences without a known one stay as they are.

    gi_map: gi, tax_id; of several rows for a gi the one with the greatest seq_no counts, if there is such a column, else the greatest taxon.
    """
    order = "seq_no" if "seq_no" in gi_map.columns else "tax_id"
    one = gi_map.groupBy("gi").agg(F.max_by("tax_id", order).alias("tax_id"))
    out = seqs.withColumn("gi", extract_gi(F.col(header))).join(one, "gi", "left")
    return out.withColumn(header, append_tax_tag(F.col(header), F.col("tax_id")))


def lineage(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """tax_id, ancestor, depth, ancestor_rank for every node and each of its ancestors, itself included.

    nodes: tax_id, parent_id, rank; a root is its own parent or has none. Paths double in length with each join, so
    a tree of depth d takes log2(d) of them; deeper than max_depth is an error, as a loop would be. What a join finds is written, so
    that the next one doesn't find it again.
    """
    up = nodes.filter("parent_id is not null and parent_id <> tax_id").select("tax_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth"))
    paths = nodes.select("tax_id", F.col("tax_id").alias("ancestor"), F.lit(0).alias("depth")).unionAll(up)
    reach = 1
    while True:
        step = paths.filter(F.col("depth") == reach).select(F.col("tax_id").alias("_t"), F.col("ancestor").alias("_mid"))
        longer = step.join(paths.filter("depth > 0").withColumnRenamed("tax_id", "_mid"), "_mid").select(F.col("_t").alias("tax_id"), "ancestor", (F.col("depth") + reach).alias("depth"))
        longer = staged(longer, "paths")
        if longer.isEmpty():
            break
        if reach >= max_depth:
            raise ValueError(f"a lineage is longer than {max_depth}, or the nodes hold a loop")
        paths, reach = paths.unionAll(longer), reach * 2
    return paths.join(nodes.select(F.col("tax_id").alias("ancestor"), F.col("rank").alias("ancestor_rank")), "ancestor").select("tax_id", "ancestor", "depth", "ancestor_rank")


def at_rank(paths: DataFrame, names: DataFrame, rank: str) -> DataFrame:
    """tax_id, anc_id, anc_name: each node's ancestor of a rank (itself included), null and undef without one. names: tax_id, name."""
    found = paths.filter(F.col("ancestor_rank") == rank).groupBy("tax_id").agg(F.min_by("ancestor", "depth").alias("anc_id"))
    out = paths.select("tax_id").distinct().join(found, "tax_id", "left").join(names.select(F.col("tax_id").alias("anc_id"), F.col("name").alias("anc_name")), "anc_id", "left")
    return out.select("tax_id", "anc_id", F.coalesce("anc_name", F.lit(UNDEF)).alias("anc_name"))


def group_name(upper: Column, upper_id: Column, lower: Column, lower_id: Column, file_id: Column, file_stem: Column) -> Column:
    """A sequence's group from its taxa at two ranks and the id and stem of its file.

    Without an upper taxon: notknow and the stem. Upper undef: the file's id leads. Otherwise both names, with the lower
    taxon's id, or the file's where the lower one is undef, else the upper's.
    """
    n1, n2 = sanitise_name(upper), sanitise_name(lower)
    number = F.coalesce(F.when(n2 == UNDEF, file_id).otherwise(lower_id.cast("string")), upper_id.cast("string"), F.lit(""))
    named = F.concat(n1, F.lit("_"), n2, F.lit("_idTAX"), number)
    lost = F.concat(F.lit("undef_idPREV"), F.coalesce(file_id, F.lit("")), F.lit("_"), n2, F.lit("_idTAX"), F.coalesce(lower_id.cast("string"), F.lit("")))
    return F.when(upper.isNull() | (upper == ""), F.concat(F.lit("notknow_"), file_stem)).when((n1 == UNDEF) & (n2 != UNDEF), lost).otherwise(named)


def count_by_taxon(seqs: DataFrame, group: str = "group") -> DataFrame:
    """n_seqs by group, and the grand total under the group null."""
    return seqs.rollup(group).agg(F.count(F.lit(1)).alias("n_seqs"))


def children(assigned: DataFrame, databases: DataFrame, parent: str = "parent") -> DataFrame:
    """Reads of a parent group meet the databases of its children: an equi-join, where patterns of names would also meet longer names."""
    return assigned.join(databases, parent)
