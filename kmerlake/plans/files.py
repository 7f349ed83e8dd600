"""Queries that write files into the shared folder and read them back, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..operators import kmerdb
from ..operators.taxonomy import RANKS, parent_rank
from ..shared import fresh_path
from ..sources import fasta, sinks
from .catalogue import DNA, counts_sql, reads, refs
from .names import _NODES, nodes
from .pipeline import Settings, stage, undef_of
from .registry import query, t

_HEADER = "'>d' || CAST(doc_id AS VARCHAR) || ' 5->3 ' || coalesce(source, '')"


def records(spark: SparkSession, d: str) -> DataFrame:
    """A FASTA record per document; headers hold a second >."""
    header = F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" 5->3 "), F.coalesce("source", F.lit("")))
    return refs(spark, d).select("group", header.alias("header"), "seq")


@query(f"SELECT {_HEADER} AS header, {DNA} AS seq FROM documents")
def fasta_records(spark, d):
    path = fresh_path(spark, "records")
    sinks.write_fasta(records(spark, d).drop("group"), path)
    return fasta.read_fasta(spark, path).select("header", "seq")


@query(f"""WITH r AS (SELECT item_id, {DNA} AS seq FROM benchmark)
    SELECT 'r' || CAST(item_id AS VARCHAR) AS read_key, '>r' || CAST(item_id AS VARCHAR) || ' <name|T|' AS title, seq,
    coalesce((SELECT string_agg(substr(seq, CAST(65 * i + 1 AS BIGINT), 65), chr(10) ORDER BY i) FROM unnest(range(0, (length(seq) + 64) // 65)) AS u(i)), '') AS wrapped FROM r""")
def fasta_reads(spark, d):
    path = fresh_path(spark, "reads")
    sinks.write_fasta(reads(spark, d).select(F.concat(F.lit(">r"), F.col("read_key").cast("string"), F.lit(" <name|T|")).alias("header"), "seq"), path)
    return fasta.as_reads(fasta.read_fasta(spark, path)).select("read_key", "title", "seq", "wrapped")


@query(f"SELECT lang AS \"group\", {_HEADER} AS header, {DNA} AS seq FROM documents WHERE lang IS NOT NULL")
def fasta_by_group(spark, d):
    path = fresh_path(spark, "by-group")
    sinks.write_fasta(records(spark, d).filter("group is not null"), path, "group")
    return fasta.read_fasta(spark, path).select(F.regexp_extract("file", "/group=([^/]*)/", 1).alias("group"), "header", "seq")


@query("SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS pos, source AS name FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def list_file(spark, d):
    path = fresh_path(spark, "list")
    names = t(spark, d, "documents").select("source").filter("source is not null").distinct()
    names.coalesce(1).sortWithinPartitions("source").write.text(path)  # a list of names is one file
    return fasta.read_list(spark, path)


@query(f"WITH {counts_sql(8)} SELECT grp AS \"group\", kmer, CAST(least(cnt, 255) AS INTEGER) AS cnt FROM counts")
def kmer_db_stored(spark, d):
    path = fresh_path(spark, "db")
    kmerdb.write(kmerdb.build(refs(spark, d), 8), path)
    return kmerdb.written_out(kmerdb.read(spark, path), 8).select("group", "kmer", "cnt")


@query(f"WITH {_NODES} SELECT tax_id, CAST(parent_id AS BIGINT) AS parent_id, rank, name FROM nodes")
def taxonomy_dump(spark, d):
    path, own = fresh_path(spark, "taxonomy"), nodes(spark, d)
    line = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|"))
    number = lambda c: F.col(c).cast("string")
    own.select(line(number("tax_id"), number("parent_id"), F.col("rank"))).write.text(f"{path}/nodes")
    other = own.select(line(number("tax_id"), F.lit("other"), F.lit(""), F.lit("synonym")))
    own.select(line(number("tax_id"), F.col("name"), F.lit(""), F.lit("scientific name"))).unionAll(other).write.text(f"{path}/names")
    node, name = fasta.read_taxonomy(spark, f"{path}/nodes", f"{path}/names")
    return node.join(name, "tax_id").select("tax_id", "parent_id", "rank", "name")


@query("SELECT page_id, split_part(regexp_extract(url, '[^/]*$', 0), '.', 1) || '_db' || CAST(page_id % 7 AS VARCHAR) || '_k24_mc5' AS name FROM pages")
def output_default_name(spark, d):
    prefix = F.concat(F.lit("db"), (F.col("page_id") % 7).cast("string"))
    return t(spark, d, "pages").select("page_id", H.output_name(F.col("url"), prefix, 24, 5).alias("name"))


@query("SELECT n_nationkey, n_name FROM nation")
def stage_taken_up_again(spark, d):
    """A second run gets the first one's table, whatever it would make."""
    path, own = fresh_path(spark, "stage"), t(spark, d, "nation").select("n_nationkey", "n_name")
    stage(spark, path, lambda: own)
    return stage(spark, path, lambda: own.filter("false"))


@query(f"SELECT * FROM (VALUES {', '.join(f'''('{r}', '{RANKS[i - 1] if i else 'no'}')''' for i, r in enumerate(RANKS))}) v(rank, parent)")
def parent_ranks(spark, d):
    return spark.createDataFrame([(r, parent_rank(r)) for r in RANKS], "rank string, parent string")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'undef' WHEN c_mktsegment = 'BUILDING' THEN 'undef_idPREV' || c_name ELSE 'undef_idPREV' || c_mktsegment END AS \"group\" FROM customer")
def undef_routing(spark, d):
    """The group of sequences without a taxon: of the root, of an undef group, and of a named one."""
    s = F.col("c_mktsegment")
    parent = F.when(s == "MACHINERY", "root").when(s == "BUILDING", F.concat(F.lit("undef_idPREV"), "c_name")).otherwise(s)
    return t(spark, d, "customer").select("c_custkey", undef_of(parent).alias("group"))


@query("SELECT 'k24_s4_mc5_mm1_cl-1_sim100' AS tag UNION ALL SELECT 'k12_s0_mc30_mm0_cl1_sim90'")
def settings_folders(spark, d):
    made = [Settings(step=4), Settings(k=12, cutoff=30, mismatches=False, policy=1, similarity=90)]
    return spark.createDataFrame([(s.tag(),) for s in made], "tag string")
