"""Queries about headers, names, taxa and lists, and the same in SQL. Headers are made of the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..operators import taxonomy as X
from ..sources import fasta, sinks
from .registry import query, t

# --- headers --------------------------------------------------------------------------------------------------


def lines(spark: SparkSession, d: str) -> DataFrame:
    """A sequence header per line item: a GI in most, without one in some."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    gi = F.when(F.col("l_linenumber") == 7, F.lit("no|")).otherwise(F.lit("gi|"))
    return rows.select("l_orderkey", "l_linenumber", F.concat(F.lit(">"), gi, F.col("l_orderkey").cast("string"), F.lit("|ref|"), F.col("l_returnflag"), F.lit("|gi|9|")).alias("header"))


LINES = "l AS (SELECT l_orderkey, l_linenumber, '>' || CASE WHEN l_linenumber = 7 THEN 'no|' ELSE 'gi|' END || CAST(l_orderkey AS VARCHAR) || '|ref|' || l_returnflag || '|gi|9|' AS header FROM lineitem)"
GI = r"CAST(nullif(regexp_extract(header, '^.*?gi\|([0-9]{1,18})\|', 1), '') AS BIGINT)"
#: Every third order has no taxon; an order's taxon is its customer.
GI_MAP = "m AS (SELECT o_orderkey AS gi, o_custkey AS tax_id FROM orders WHERE o_orderkey % 3 <> 0)"


def gi_map(spark: SparkSession, d: str) -> DataFrame:
    # No GI is negative, so an order without a taxon has a key that none meets.
    gi = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey"))
    return t(spark, d, "orders").select(gi.alias("gi"), F.col("o_custkey").alias("tax_id"))


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, {GI} AS gi FROM l")
def gi_extract(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", H.extract_gi(F.col("header")).alias("gi"))


@query(f"WITH {LINES}, {GI_MAP}, g AS (SELECT *, {GI} AS gi FROM l) SELECT g.l_orderkey, g.l_linenumber, g.gi, coalesce(m.tax_id, -1) AS tax_id FROM g LEFT JOIN m USING (gi)")
def gi_to_tax_left_join(spark, d):
    return X.annotate(lines(spark, d), gi_map(spark, d)).select("l_orderkey", "l_linenumber", "gi", F.coalesce("tax_id", F.lit(-1)).alias("tax_id"))


@query(f"WITH {LINES}, {GI_MAP}, g AS (SELECT *, {GI} AS gi FROM l) SELECT g.l_orderkey, g.l_linenumber, header || CASE WHEN m.tax_id IS NULL THEN '' ELSE ' <idTAX|' || CAST(m.tax_id AS VARCHAR) || '| ' END AS header FROM g LEFT JOIN m USING (gi)")
def append_tax_tag(spark, d):
    return X.annotate(lines(spark, d), gi_map(spark, d)).select("l_orderkey", "l_linenumber", "header")


@query("SELECT gi, max(tax_id) AS tax_id FROM (SELECT o_custkey AS gi, o_orderkey AS tax_id FROM orders) GROUP BY gi")
def gi_map_last_wins(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("read_key"), F.col("o_orderkey").alias("tax_id"))
    return fasta.last_by_key(rows, "tax_id").select(F.col("read_key").alias("gi"), "tax_id")


_TAGGED = "h AS (SELECT o_orderkey, '>r' || CAST(o_orderkey AS VARCHAR) || ' gi|' || CAST(o_custkey AS VARCHAR) || '| <class|' || o_orderstatus || '| <idTAX|' || CAST(o_custkey AS VARCHAR) || '| <name|' || o_orderpriority || '|' AS header FROM orders)"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit(">r"), s("o_orderkey"), F.lit(" gi|"), s("o_custkey"), F.lit("| <class|"), s("o_orderstatus"), F.lit("| <idTAX|"), s("o_custkey"), F.lit("| <name|"), s("o_orderpriority"), F.lit("|"))
    return t(spark, d, "orders").select("o_orderkey", text.alias("header"))


@query(rf"WITH {_TAGGED} SELECT o_orderkey, nullif(regexp_extract(header, '<idTAX\|(.*)\|', 1), '') AS tax, nullif(regexp_extract(header, '^.*?<name\|(.*)\|', 1), '') AS truth, nullif(regexp_extract(header, '^.*?<class\|([^|]*)\|', 1), '') AS cls, coalesce(nullif(regexp_extract(header, '^.*?gi[^0-9]*([0-9]+)', 1), ''), '0') AS grp FROM h")
def header_tag_parse(spark, d):
    h = F.col("header")
    return tagged(spark, d).select("o_orderkey", H.taxid_from_header(h).alias("tax"), H.truth_tag(h).alias("truth"), H.class_tag(h).alias("cls"), H.default_group(h).alias("grp"))


_KEYED = "k AS (SELECT o_orderkey, '  ' || CASE WHEN o_orderkey % 2 = 0 THEN 'a' || chr(9) || 'b' ELSE 'read' END || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN chr(9) || 'rest' ELSE ' x ' END || ' <name|' || o_orderpriority || '|  ' AS title FROM orders)"
_KEY1 = r"regexp_replace(split_part(regexp_replace(title, '^[ \t]+|[ \t]+$', '', 'g'), '<name|', 1), '[ \t]+$', '')"


@query(f"WITH {_KEYED}, a AS (SELECT o_orderkey, {_KEY1} AS s FROM k) SELECT o_orderkey, substr(s, 1, 3) || split_part(substr(s, 4), chr(9), 1) AS read_key FROM a")
def read_key_normalise(spark, d):
    tab = F.lit("\t")
    lead = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a"), tab, F.lit("b"))).otherwise(F.lit("read"))
    tail = F.when(F.col("o_orderkey") % 3 == 0, F.concat(tab, F.lit("rest"))).otherwise(F.lit(" x "))
    title = F.concat(F.lit("  "), lead, F.col("o_custkey").cast("string"), tail, F.lit(" <name|"), F.col("o_orderpriority"), F.lit("|  "))
    return t(spark, d, "orders").select("o_orderkey", H.read_key(title).alias("read_key"))


_SCORE = "s AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Min_err:' || chr(9) || CAST(l_linenumber AS VARCHAR) || chr(9) || 'Match:' || chr(9) || CAST(l_partkey AS VARCHAR) || chr(9) || '>r' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) || ' ' || chr(9) || CASE l_returnflag WHEN 'A' THEN 'M_ORG' WHEN 'N' THEN 'MM' ELSE 'M_COMP' END AS value FROM lineitem)"


@query("SELECT 'r' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS read_key, CAST(l_partkey AS INTEGER) AS match, CAST(l_linenumber AS INTEGER) AS min_err, CASE l_returnflag WHEN 'A' THEN 'M_ORG' WHEN 'N' THEN 'MM' ELSE 'M_COMP' END AS label FROM lineitem")
def score_rows_round_trip(spark, d):
    """Rows written in the text format and parsed again."""
    label = F.when(F.col("l_returnflag") == "A", "M_ORG").when(F.col("l_returnflag") == "N", "MM").otherwise("M_COMP")
    key = F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    rows = t(spark, d, "lineitem").select(key.alias("read_key"), F.col("l_partkey").cast("int").alias("match"), F.col("l_linenumber").cast("int").alias("min_err"), label.alias("label"))
    return fasta.parse_scores(sinks.score_lines(rows))


@query("SELECT o_custkey AS read_key, max_by(o_orderpriority, o_orderkey) AS title, max(o_orderkey) AS no FROM orders GROUP BY o_custkey")
def read_map_last_wins(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("read_key"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("no"))
    return fasta.last_by_key(rows, "no")


# --- names and paths ------------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_extract(url, '^(.*/)?[^/]*$', 1) AS dir, regexp_extract(url, '[^/]*$', 0) AS base, regexp_replace(regexp_extract(url, '[^/]*$', 0), '\.fa$', '') AS stem, nullif(regexp_extract(url || '_idTAX' || CAST(page_id AS VARCHAR) || '.fa', 'idTAX(.*)\.fa', 1), '') AS tax FROM pages")
def path_parts(spark, d):
    u = F.col("url")
    file = F.concat(u, F.lit("_idTAX"), F.col("page_id").cast("string"), F.lit(".fa"))
    return t(spark, d, "pages").select("page_id", H.dirname(u).alias("dir"), H.basename(u).alias("base"), H.stem(u).alias("stem"), H.taxid_from_file(file).alias("tax"))


@query("SELECT page_id, replace(replace(url || chr(13), '/', '='), chr(13), '') AS name FROM pages")
def name_sanitise(spark, d):
    return t(spark, d, "pages").select("page_id", H.sanitise_name(F.concat("url", F.lit("\r"))).alias("name"))


_ALNUM = "regexp_replace(text, '[^A-Za-z]', '', 'g')"


@query(f"WITH s AS (SELECT item_id, {_ALNUM} AS seq FROM benchmark) SELECT item_id, (SELECT string_agg(substr(seq, CAST(65 * i + 1 AS BIGINT), 65), chr(10) ORDER BY i) FROM unnest(range(0, (length(seq) + 64) // 65)) AS u(i)) AS wrapped FROM s")
def fasta_rewrap65(spark, d):
    return t(spark, d, "benchmark").select("item_id", H.wrap(F.regexp_replace("text", "[^A-Za-z]", "")).alias("wrapped"))


@query("SELECT DISTINCT source AS name FROM documents WHERE contains(source, 'src1') OR contains(source, '9')")
def group_substring_filter(spark, d):
    names = t(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return names.filter(H.contains_any(F.col("name"), ["src1", "9"]))


@query("SELECT * FROM (SELECT DISTINCT lang || '_' || CASE WHEN source = 'src3' THEN 'FP' WHEN source = 'src4' THEN 'notknow' WHEN source = 'src5' THEN 'MultiClass' ELSE source END AS name FROM documents) WHERE NOT (contains(name, 'notknow') OR contains(name, 'FP') OR contains(name, 'TP') OR contains(name, 'NK') OR contains(name, 'MultiClass'))")
def output_name_filter(spark, d):
    s = F.col("source")
    ends = F.when(s == "src3", "FP").when(s == "src4", "notknow").when(s == "src5", "MultiClass").otherwise(s)
    names = t(spark, d, "documents").select(F.concat("lang", F.lit("_"), ends).alias("name")).distinct()
    return names.filter(H.is_group_output(F.col("name")))


@query("WITH n AS (SELECT DISTINCT lang, source FROM documents), o AS (SELECT CAST(row_number() OVER (ORDER BY lang, source) - 1 AS INTEGER) AS pos, lang || '_NT_' || source AS name, lang AS g FROM n) SELECT g AS \"group\", min(pos) AS pos, array_to_string(list(name ORDER BY pos), ',') AS files FROM o GROUP BY g")
def filename_grouping(spark, d):
    pairs = t(spark, d, "documents").select("lang", "source").distinct()
    # The list of a folder's files: one row holds them all, in order.
    names = pairs.agg(F.array_sort(F.collect_list(F.struct("lang", "source"))).alias("a")).select(F.posexplode("a").alias("pos", "x")).select("pos", F.concat("x.lang", F.lit("_NT_"), "x.source").alias("name"))
    return sinks.file_lists(names).withColumn("files", F.array_join("files", ","))


@query("WITH g AS (SELECT DISTINCT lang AS grp FROM documents) SELECT 'set_' || grp || '_k24_mc5' || e AS file, grp AS \"group\" FROM g, (VALUES ('M.out'), ('MM.out')) v(e)")
def output_file_list(spark, d):
    return sinks.output_list(t(spark, d, "documents").select(F.col("lang").alias("group")).distinct(), "set", 24, 5)


@query("SELECT DISTINCT lang || '_' || source || '_k24_mc5' AS name, CASE WHEN source = 'src7' THEN 'undef' ELSE source END AS \"group\" FROM documents")
def group_from_output_name(spark, d):
    rows = t(spark, d, "documents").select("lang", "source").distinct()
    name = F.concat("lang", F.lit("_"), F.when(F.col("source") == "src7", "undef_9").otherwise(F.col("source")), F.lit("_k24_mc5"))
    out = rows.select(F.concat("lang", F.lit("_"), "source", F.lit("_k24_mc5")).alias("name"), H.group_of_output(name, F.col("lang")).alias("group"))
    return out


@query("WITH w AS (SELECT DISTINCT lang, source FROM documents), p AS (SELECT DISTINCT lang, source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1) SELECT w.lang, w.source FROM w ANTI JOIN p USING (lang, source)")
def missing_databases(spark, d):
    docs = t(spark, d, "documents")
    wanted = docs.select("lang", "source").distinct()
    present = docs.join(t(spark, d, "labels").filter("toxic = 1"), "doc_id").select("lang", "source").distinct()
    return sinks.missing(wanted, present, ["lang", "source"])


@query("SELECT CAST(item_id AS INTEGER) AS pos, 'file' || CAST(item_id AS VARCHAR) AS file, r_name AS \"group\" FROM benchmark JOIN region ON r_regionkey = item_id")
def file_group_zip(spark, d):
    # Both lists hold every item that has a region, as the SQL's join does; zip_lists demands equal lengths.
    items = t(spark, d, "benchmark").join(t(spark, d, "region"), F.col("r_regionkey") == F.col("item_id")).withColumn("pos", F.col("item_id").cast("int"))
    return fasta.zip_lists(items.select("pos", F.concat(F.lit("file"), F.col("item_id").cast("string")).alias("file")), items.select("pos", F.col("r_name").alias("group")))


# --- taxa -----------------------------------------------------------------------------------------------------
# The tree: region (phylum), nation (class), customer (species). Customers of the machinery segment hang on the root directly.

_NODES = """nodes AS (SELECT CAST(1 AS BIGINT) AS tax_id, CAST(1 AS BIGINT) AS parent_id, 'no rank' AS rank, 'root' AS name
    UNION ALL SELECT 10 + r_regionkey, 1, 'phylum', r_name FROM region UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'class', n_name FROM nation
    UNION ALL SELECT 1000 + c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 100 + c_nationkey END, 'species', c_name FROM customer)"""
_LINEAGE = f"RECURSIVE {_NODES}, up AS (SELECT tax_id, tax_id AS ancestor, 0 AS depth FROM nodes UNION ALL SELECT u.tax_id, n.parent_id, u.depth + 1 FROM up u JOIN nodes n ON n.tax_id = u.ancestor WHERE n.parent_id <> n.tax_id), paths AS (SELECT up.*, n.rank AS ancestor_rank, n.name AS anc_name FROM up JOIN nodes n ON n.tax_id = up.ancestor)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """tax_id, parent_id, rank, name."""
    long = lambda c: F.col(c).cast("long")
    root = spark.range(1).select(F.lit(1).cast("long").alias("tax_id"), F.lit(1).cast("long").alias("parent_id"), F.lit("no rank").alias("rank"), F.lit("root").alias("name"))
    regions = t(spark, d, "region").select(long("r_regionkey") + 10, F.lit(1).cast("long"), F.lit("phylum"), "r_name")
    nations = t(spark, d, "nation").select(long("n_nationkey") + 100, long("n_regionkey") + 10, F.lit("class"), "n_name")
    over = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(1).cast("long")).otherwise(long("c_nationkey") + 100)
    return root.unionAll(regions).unionAll(nations).unionAll(t(spark, d, "customer").select(long("c_custkey") + 1000, over, F.lit("species"), "c_name"))


@query(f"WITH {_LINEAGE} SELECT tax_id, ancestor, depth, ancestor_rank FROM paths")
def lineage(spark, d):
    return X.lineage(nodes(spark, d))


@query(f"WITH {_LINEAGE}, f AS (SELECT tax_id, ancestor, anc_name FROM paths WHERE ancestor_rank = 'phylum') SELECT n.tax_id, coalesce(f.ancestor, -1) AS anc_id, coalesce(f.anc_name, 'undef') AS anc_name FROM nodes n LEFT JOIN f USING (tax_id)")
def lineage_at_rank(spark, d):
    own = nodes(spark, d)
    return X.at_rank(X.lineage(own), own, "phylum").fillna(-1, "anc_id")


@query("SELECT n_name AS name, CAST(100 + n_nationkey AS BIGINT) AS tax_id FROM nation")
def taxon_id_by_name(spark, d):
    wanted = t(spark, d, "nation").select(F.col("n_name").alias("name"))
    return wanted.join(nodes(spark, d).select("name", "tax_id"), "name")


_NAMED = f"""{_LINEAGE}, p AS (SELECT tax_id, ancestor AS i1, anc_name AS n1 FROM paths WHERE ancestor_rank = 'phylum'), c AS (SELECT tax_id, ancestor AS i2, anc_name AS n2 FROM paths WHERE ancestor_rank = 'class'),
    x AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS fid, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE coalesce(p.n1, 'undef') END AS n1, i1, coalesce(c.n2, 'undef') AS n2, i2 FROM orders JOIN nodes n ON n.tax_id = 1000 + o_custkey LEFT JOIN p USING (tax_id) LEFT JOIN c USING (tax_id)),
    named AS (SELECT o_orderkey, CASE WHEN n1 IS NULL THEN 'notknow_in' || fid WHEN n1 = 'undef' AND n2 <> 'undef' THEN 'undef_idPREV' || fid || '_' || n2 || '_idTAX' || CAST(i2 AS VARCHAR)
        ELSE n1 || '_' || n2 || '_idTAX' || coalesce(CASE WHEN n2 = 'undef' THEN fid ELSE CAST(i2 AS VARCHAR) END, CAST(i1 AS VARCHAR), '') END AS "group" FROM x)"""


def named(spark: SparkSession, d: str) -> DataFrame:
    own = nodes(spark, d)
    paths = X.lineage(own)
    upper, lower = (X.at_rank(paths, own, r).select("tax_id", F.col("anc_id").alias(f"i{i}"), F.col("anc_name").alias(f"n{i}")) for i, r in ((1, "phylum"), (2, "class")))
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("fid"), (F.col("o_custkey") + 1000).alias("tax_id")).join(upper, "tax_id").join(lower, "tax_id")
    n1 = F.when(F.col("o_orderkey") % 11 != 0, F.col("n1"))
    return rows.select("o_orderkey", X.group_name(n1, F.col("i1"), F.col("n2"), F.col("i2"), F.col("fid"), F.concat(F.lit("in"), "fid")).alias("group"))


@query(f"WITH {_NAMED} SELECT * FROM named")
def taxon_group_name(spark, d):
    return named(spark, d)


@query(f"WITH {_NAMED} SELECT \"group\", count(*) AS n_seqs FROM named GROUP BY \"group\" UNION ALL SELECT NULL, count(*) FROM named")
def seqs_per_taxon(spark, d):
    return X.count_by_taxon(named(spark, d))


@query("SELECT c.c_custkey, s.s_suppkey, n.n_nationkey AS parent FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN supplier s ON s.s_nationkey = n.n_nationkey")
def parent_children_join(spark, d):
    assigned = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("parent"))
    return X.children(assigned, t(spark, d, "supplier").select(F.col("s_nationkey").alias("parent"), "s_suppkey"))
