"""The queries of the classification engine over the driver's tables, and the same in SQL.

There is no DNA in the tables: letters of texts are mapped to bases. Documents are reference sequences, their language
the group and their source the group below it; benchmark passages and conversation turns are reads; headers are made of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import assign as A
from ..operators import kmerdb
from ..operators import score as S
from ..sources import sinks
from .pipeline import Settings, classify, classify_children
from .registry import query, spread, t

K, MC = 12, 0.05


# --- inputs, in both languages --------------------------------------------------------------------------------

_LETTERS = f"'{dna.ALPHABET}', '{dna.MAPPED}'"
DNA = "translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), " + _LETTERS + ")"
DNA_N = r"translate(regexp_replace(regexp_replace(text, '[0-9\n]', '#', 'g'), '[^A-Za-z#]', '', 'g'), " + f"'{dna.ALPHABET}#', '{dna.MAPPED}N')"
RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


def refs(spark: SparkSession, d: str) -> DataFrame:
    """group, source, seq. One task per file would take all of a small table, so rows are dealt out."""
    docs = t(spark, d, "documents").select("doc_id", F.col("lang").alias("group"), "source", "text")
    return spread(docs).select("doc_id", "group", "source", dna.text_to_dna(F.col("text")).alias("seq"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").alias("read_key"), dna.text_to_dna(F.col("text")).alias("seq"))


REFS = f"refs AS (SELECT doc_id, lang AS grp, source, {DNA} AS seq FROM documents)"
READS = f"reads AS (SELECT item_id AS read_key, {DNA} AS seq FROM benchmark)"
GROUPS = "groups AS (SELECT DISTINCT lang AS grp FROM documents)"


def kmers_sql(k: int, source: str = "refs", cols: str = "grp", name: str = "kmers") -> str:
    """A long sequence is cut into tiles first; substr() in the middle of a long string is slow here, too."""
    return f"""{name}_t AS (SELECT {cols}, j, substr(seq, CAST(256 * j + 1 AS BIGINT), {256 + k - 1}) AS part FROM (SELECT {cols}, seq, unnest(range(0, (length(seq) - {k}) // 256 + 1)) AS j FROM {source} WHERE length(seq) >= {k})),
    {name}_p AS (SELECT {cols}, j, part, unnest(range(0, length(part) - {k} + 1)) AS i FROM {name}_t),
    {name} AS (SELECT {cols}, CAST(256 * j + i AS INTEGER) AS pos, substr(part, i + 1, {k}) AS kmer FROM {name}_p WHERE NOT regexp_matches(substr(part, i + 1, {k}), '[^ACGT]'))"""


def counts_sql(k: int) -> str:
    return f"{REFS}, {kmers_sql(k)}, counts AS (SELECT grp, kmer, count(*) AS cnt FROM kmers GROUP BY ALL)"


# --- k-mer databases ------------------------------------------------------------------------------------------


@query(f"WITH {counts_sql(8)} SELECT grp AS \"group\", kmer, cnt FROM counts")
def kmer_count(spark, d):
    return kmerdb.written_out(kmerdb.count_kmers(refs(spark, d), 8), 8)


@query(f"WITH {counts_sql(8)} SELECT grp AS \"group\", kmer, CAST(least(cnt, 255) AS INTEGER) AS cnt FROM counts")
def kmer_count_capped255(spark, d):
    return kmerdb.written_out(kmerdb.build(refs(spark, d), 8), 8)


@query(f"WITH {counts_sql(8)} SELECT grp AS \"group\", kmer, CAST(least(cnt, 255) AS INTEGER) AS cnt FROM counts WHERE cnt >= 3")
def kmer_count_min3(spark, d):
    return kmerdb.written_out(kmerdb.build(refs(spark, d), 8, min_count=3), 8)


_CODE = " + ".join(f"(position(substr(kmer, {i + 1}, 1) IN 'ACGT') - 1) * {4 ** (9 - i)}" for i in range(10))


@query(f"WITH {counts_sql(10)} SELECT grp AS \"group\", CAST({_CODE} AS BIGINT) AS kmer, CAST(least(cnt, 255) AS INTEGER) AS cnt FROM counts")
def kmer_encode_bigint(spark, d):
    return kmerdb.build(refs(spark, d), 10)


@query(f"WITH {counts_sql(24)} SELECT grp AS \"group\", CAST(sum(cnt) AS BIGINT) AS n_total, count(*) AS n_unique, count(*) FILTER (cnt = 1) AS n_singletons, count(*) FILTER (cnt > 1) AS n_repeated FROM counts GROUP BY ALL")
def kmer_db_stats(spark, d):
    return kmerdb.stats(kmerdb.count_kmers(refs(spark, d), 24))


@query(f"WITH {counts_sql(24)} SELECT grp AS \"group\", CAST(sum(cnt) AS BIGINT) AS n_total, count(*) AS n_unique, count(*) FILTER (cnt = 1) AS n_singletons, count(*) FILTER (cnt > 1) AS n_repeated, 24 AS k, CAST(NULL AS DOUBLE) AS seconds FROM counts GROUP BY ALL")
def build_metrics(spark, d):
    return sinks.build_report(kmerdb.count_kmers(refs(spark, d), 24), "group", 24)


@query(f"WITH {counts_sql(8)} SELECT grp AS \"group\", CAST(coalesce(sum(cnt) FILTER (kmer = '{'A' * 8}'), 0) AS BIGINT) AS all_a, CAST(coalesce(sum(cnt) FILTER (kmer = '{'T' * 8}'), 0) AS BIGINT) AS all_t, CAST(coalesce(sum(cnt) FILTER (kmer = '{'C' * 8}'), 0) AS BIGINT) AS all_c, CAST(coalesce(sum(cnt) FILTER (kmer = '{'A' * 7}G'), 0) AS BIGINT) AS a_then_g FROM counts GROUP BY ALL")
def special_kmer_counts(spark, d):
    return kmerdb.special_counts(kmerdb.count_kmers(refs(spark, d), 8), 8)


@query(f"WITH {counts_sql(10)}, d AS (SELECT kmer, sum(cnt) AS cnt FROM counts GROUP BY ALL) SELECT substr(kmer, 1, 4) AS prefix, count(*) AS n_kmers, CAST(sum(cnt) AS BIGINT) AS n_total FROM d GROUP BY ALL")
def prefix_bin_histogram(spark, d):
    counts = kmerdb.count_kmers(refs(spark, d), 10)
    return kmerdb.prefix_histogram(counts.groupBy("kmer").agg(F.sum("cnt").alias("cnt")), 10)


@query(f"WITH {counts_sql(8)}, c AS (SELECT grp, kmer, least(cnt, 255) AS cnt FROM counts) SELECT a.kmer, CAST(least(a.cnt, b.cnt) AS INTEGER) AS cnt FROM c a JOIN c b USING (kmer) WHERE a.grp = 'de' AND b.grp = 'fr'")
def kmer_db_intersect(spark, d):
    db = kmerdb.build(refs(spark, d).filter("group in ('de', 'fr')"), 8)
    one = lambda g: db.filter(F.col("group") == g).withColumn("group", F.lit("both"))
    return kmerdb.written_out(kmerdb.intersect(one("de"), one("fr")).drop("group"), 8)


@query(f"WITH {counts_sql(8)}, c AS (SELECT grp, kmer, least(cnt, 255) AS cnt FROM counts) SELECT kmer, CAST(cnt AS INTEGER) AS cnt FROM (SELECT * FROM c WHERE grp = 'en') ANTI JOIN (SELECT kmer FROM c WHERE grp <> 'en') USING (kmer)")
def kmer_db_subtract(spark, d):
    db = kmerdb.build(refs(spark, d), 8)
    rest = db.filter("group <> 'en'").select(F.lit("en").alias("group"), "kmer")
    return kmerdb.written_out(kmerdb.subtract(db.filter("group = 'en'"), rest).drop("group"), 8)


@query(f"WITH {counts_sql(8)} SELECT kmer, CAST(least(sum(least(cnt, 255)), 255) AS INTEGER) AS cnt FROM counts GROUP BY kmer")
def kmer_db_union(spark, d):
    db = kmerdb.build(refs(spark, d), 8)
    return kmerdb.written_out(kmerdb.union([db.withColumn("group", F.lit("all"))]).drop("group"), 8)


_N_REFS = f"refs AS (SELECT doc_id, lang AS grp, {DNA_N} AS seq FROM documents)"


def refs_n(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(t(spark, d, "documents").select("doc_id", F.col("lang").alias("group"), "text"))
    return docs.select("doc_id", "group", dna.text_to_dna_n(F.col("text")).alias("seq"))


@query(f"WITH {_N_REFS}, {kmers_sql(12)}, a AS (SELECT grp, sum(greatest(length(seq) - 11, 0)) AS n FROM refs GROUP BY ALL), v AS (SELECT grp, count(*) AS n FROM kmers GROUP BY ALL) SELECT grp AS \"group\", CAST(a.n AS BIGINT) AS n_places, v.n AS n_valid FROM a JOIN v USING (grp)")
def kmer_valid_only(spark, d):
    kmers = dna.explode_kmers(refs_n(spark, d).select("group", "seq"), 12, valid_only=False)
    return kmers.groupBy("group").agg(F.count(F.lit(1)).alias("n_places"), F.sum(F.col("valid").cast("long")).alias("n_valid"))


_SEGMENTS = f"{_N_REFS}, s AS (SELECT doc_id, grp, list_filter(regexp_split_to_array(seq, 'N+'), lambda x: x <> '') AS l FROM refs), segs AS (SELECT doc_id, grp, unnest(range(0, len(l))) AS seg_no, unnest(l) AS segment FROM s)"


@query(f"WITH {_SEGMENTS} SELECT doc_id, CAST(seg_no AS INTEGER) AS seg_no, CAST(length(segment) AS INTEGER) AS seg_len FROM segs")
def n_segmentation(spark, d):
    return dna.segments(refs_n(spark, d).select("doc_id", "seq")).select("doc_id", "seg_no", F.length("segment").alias("seg_len"))


@query(f"WITH {_SEGMENTS} SELECT grp AS \"group\", count(*) AS n_segments, CAST(sum(length(segment) - 23) AS BIGINT) AS n_kmers FROM segs WHERE length(segment) >= 24 GROUP BY ALL")
def min_length_filter(spark, d):
    long = dna.segments(refs_n(spark, d).select("group", "seq")).filter(F.length("segment") >= 24)
    return long.groupBy("group").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("segment") - 23).cast("long").alias("n_kmers"))


@query(f"WITH r AS (SELECT item_id, {DNA_N} AS seq FROM benchmark) SELECT item_id, seq, {RC.format('seq')} AS rc, translate(seq, 'ACGTN', '0123-') AS codes FROM r")
def reverse_complement(spark, d):
    rows = t(spark, d, "benchmark").select("item_id", dna.text_to_dna_n(F.col("text")).alias("seq"))
    return rows.select("item_id", "seq", dna.reverse_complement(F.col("seq")).alias("rc"), dna.base_codes(F.col("seq")).alias("codes"))


@query(f"WITH {REFS} SELECT grp AS \"group\", count(*) AS n_seqs, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM refs GROUP BY ALL")
def seq_counts_per_group(spark, d):
    return refs(spark, d).groupBy("group").agg(F.count(F.lit(1)).alias("n_seqs"), F.sum(F.length("seq")).cast("long").alias("n_bases"))


@query(f"WITH u AS (SELECT 'documents' AS file, {DNA} AS seq FROM documents UNION ALL SELECT 'benchmark', {DNA} FROM benchmark UNION ALL SELECT 'conversations', {DNA} FROM conversations) SELECT file, count(*) AS n_seqs, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM u GROUP BY ALL")
def multi_file_union(spark, d):
    files = [t(spark, d, n).select(F.lit(n).alias("file"), dna.text_to_dna(F.col("text")).alias("seq")) for n in ("documents", "benchmark", "conversations")]
    return files[0].unionAll(files[1]).unionAll(files[2]).groupBy("file").agg(F.count(F.lit(1)).alias("n_seqs"), F.sum(F.length("seq")).cast("long").alias("n_bases"))


# --- comparing ------------------------------------------------------------------------------------------------


def database(spark: SparkSession, d: str, k: int, own: DataFrame, strands: bool = True) -> DataFrame:
    """The part of the reference database that the reads can hit."""
    kmers = S.read_kmers(S.both_strands(own) if strands else own, k)
    return kmerdb.members(refs(spark, d), k, kmers)


def groups(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("lang").alias("group")).distinct()


def scores_sql(k: int, mc: float, step: int, early: bool = True, reads_cte: str = READS) -> str:
    """Runs and gaps by windows: read strands, probes, hits, runs, gaps, stops, scores by strand."""
    probe = f"(pos = 0 OR (pos % {step} = 0 AND pos + {k} < len AND substr(seq, pos + {k} + 1, 1) SIMILAR TO '[ACGT]'))" if step > 1 else "true"
    over = "PARTITION BY read_key, strand, grp ORDER BY p0"
    stop = f"(g > 0 AND ((p0 + {k}) - before) / CAST(len AS DOUBLE) - (1 - CAST({mc} AS DOUBLE)) > 1e-6)" if early else "false"
    none = "0" if step > 1 else f"CASE WHEN len >= {k} AND NOT " + (f"({k} / CAST(len AS DOUBLE) - (1 - CAST({mc} AS DOUBLE)) > 1e-6)" if early else "false") + f" THEN CAST(ceil((len - {k} + 1) / CAST({k} AS DOUBLE)) AS INTEGER) ELSE 0 END"
    return f"""{REFS}, {GROUPS}, {reads_cte},
    strands AS (SELECT read_key, '+' AS strand, seq, length(seq) AS len FROM reads UNION ALL SELECT read_key, '-', {RC.format('seq')}, length(seq) FROM reads),
    rk AS (SELECT read_key, strand, len, seq, pos, substr(seq, pos + 1, {k}) AS kmer FROM (SELECT *, CAST(unnest(range(0, greatest(len - {k} + 1, 0))) AS INTEGER) AS pos FROM strands)),
    {kmers_sql(k)}, wanted AS (SELECT DISTINCT kmer FROM rk), db AS (SELECT DISTINCT grp, kmer FROM kmers SEMI JOIN wanted USING (kmer)),
    hits AS (SELECT read_key, strand, grp, len, pos, {probe} AS probe FROM rk JOIN db USING (kmer)),
    probed AS (SELECT read_key, strand, grp FROM hits GROUP BY ALL HAVING bool_or(probe)),
    isl AS (SELECT *, pos - row_number() OVER (PARTITION BY read_key, strand, grp ORDER BY pos) AS isl FROM hits SEMI JOIN probed USING (read_key, strand, grp)),
    runs AS (SELECT read_key, strand, grp, len, min(pos) AS s, count(*) AS n FROM isl GROUP BY read_key, strand, grp, len, isl),
    ends AS (SELECT read_key, strand, grp, len, s, n FROM runs UNION ALL SELECT DISTINCT read_key, strand, grp, len, len - {k} + 1, 0 FROM runs),
    gaps AS (SELECT *, coalesce(lag(s + n) OVER (PARTITION BY read_key, strand, grp ORDER BY s), 0) AS p0, row_number() OVER (PARTITION BY read_key, strand, grp ORDER BY s) AS no FROM ends),
    parts AS (SELECT *, s - p0 AS g, CASE WHEN n = 0 THEN 0 WHEN no = 1 THEN {k} + n - 1 ELSE least(s - p0, {k}) + n - 1 END AS add FROM gaps),
    run AS (SELECT *, coalesce(sum(add) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts),
    stops AS (SELECT *, bool_or({stop}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM run),
    hit_scores AS (SELECT read_key, strand, grp, CAST(coalesce(sum(add) FILTER (NOT stopped), 0) AS INTEGER) AS match, CAST(coalesce(sum(ceil(g / CAST({k} AS DOUBLE))) FILTER (NOT stopped), 0) AS INTEGER) AS min_err FROM stops GROUP BY ALL),
    scores AS (SELECT s.read_key, g.grp, s.strand, CAST(s.len AS INTEGER) AS len, coalesce(h.match, 0) AS match, coalesce(h.min_err, {none}) AS min_err FROM strands s CROSS JOIN groups g LEFT JOIN hit_scores h USING (read_key, strand, grp))"""


def rows_sql(k: int, mc: float, step: int, reads_cte: str = READS) -> str:
    ok = lambda m: f"(len > 0 AND ({m} / CAST(len AS DOUBLE) > {mc} OR abs({m} / CAST(len AS DOUBLE) - {mc}) <= 1e-6))"
    return f"""{scores_sql(k, mc, step, True, reads_cte)},
    both_s AS (SELECT f.read_key, f.grp, f.len, f.match AS fm, f.min_err AS fe, r.match AS rm, r.min_err AS re FROM scores f JOIN scores r ON f.read_key = r.read_key AND f.grp = r.grp AND f.strand = '+' AND r.strand = '-'),
    rows AS (SELECT read_key, grp, len, CASE WHEN {ok('fm')} THEN fm ELSE rm END AS match, CASE WHEN {ok('fm')} THEN fe ELSE re END AS min_err, CASE WHEN {ok('fm')} THEN 'M_ORG' WHEN {ok('rm')} THEN 'M_COMP' ELSE 'MM' END AS label FROM both_s)"""


def kept_sql(similarity: int = 100, where: str = "true", k: int = K, mc: float = MC) -> str:
    return f"""{rows_sql(k, mc, k)}, best AS (SELECT *, max(match) OVER (PARTITION BY read_key) AS best FROM rows WHERE {where}),
    kept AS (SELECT *, count(*) OVER (PARTITION BY read_key) AS n_groups FROM best WHERE match >= floor(best * {similarity} / 100))"""


def scored(spark: SparkSession, d: str, k: int = K, mc: float = MC, step: int = 0, early: bool = True) -> DataFrame:
    own = reads(spark, d)
    return S.score(own, database(spark, d, k, own), groups(spark, d), k, mc, step, early)


def compared(spark: SparkSession, d: str) -> DataFrame:
    return S.choose_strand(scored(spark, d), MC)


def candidates(spark: SparkSession, d: str, similarity: int = 100, mismatches: bool = True, k: int = K, cutoff: int = 5) -> DataFrame:
    own = reads(spark, d)
    return classify(own, database(spark, d, k, own), Settings(k=k, cutoff=cutoff, mismatches=mismatches, similarity=similarity), groups(spark, d))


_READ_KMERS = f"{READS}, rk AS (SELECT read_key, pos, substr(seq, pos + 1, {K}) AS kmer FROM (SELECT *, CAST(unnest(range(0, greatest(length(seq) - {K - 1}, 0))) AS INTEGER) AS pos FROM reads))"


def forward_kmers(spark: SparkSession, d: str) -> DataFrame:
    return dna.explode_kmers(reads(spark, d), K)


@query(f"WITH {REFS}, {_READ_KMERS}, {kmers_sql(K)} SELECT read_key, count(*) AS n_hits FROM rk SEMI JOIN kmers USING (kmer) GROUP BY ALL")
def kmer_membership_semi(spark, d):
    own = forward_kmers(spark, d)
    return own.join(kmerdb.members(refs(spark, d), K, own).select("kmer").distinct(), "kmer", "left_semi").groupBy("read_key").agg(F.count(F.lit(1)).alias("n_hits"))


@query(f"WITH {REFS}, {_READ_KMERS}, {kmers_sql(K)} SELECT read_key, pos, kmer FROM rk ANTI JOIN kmers USING (kmer)")
def kmer_missing_anti(spark, d):
    own = forward_kmers(spark, d)
    return own.join(kmerdb.members(refs(spark, d), K, own).select("kmer").distinct(), "kmer", "left_anti").select("read_key", "pos", dna.kmer_text(F.col("kmer"), K).alias("kmer"))


@query(f"WITH {scores_sql(K, MC, K)} SELECT read_key, strand, grp AS \"group\" FROM probed")
def quick_pass_filter(spark, d):
    own = reads(spark, d)
    found = S.hits(S.read_kmers(S.both_strands(own), K), database(spark, d, K, own))
    return found.filter(S.is_probe(K, K)).select("read_key", "strand", "group").distinct()


@query(f"WITH {scores_sql(K, MC, 1)} SELECT read_key, strand, grp AS \"group\", s AS run_start, n AS run_len FROM runs")
def hit_runs(spark, d):
    own = reads(spark, d)
    found = S.hits(S.read_kmers(S.both_strands(own), K), database(spark, d, K, own))
    return S.hit_runs(found, ["read_key", "strand", "group"])


_SCORES = 'SELECT read_key, grp AS "group", strand, len, match, min_err FROM scores'


@query(f"WITH {scores_sql(K, MC, 1, early=False)} {_SCORES}")
def run_score(spark, d):
    return scored(spark, d, step=1, early=False)


@query(f"WITH {scores_sql(K, 0.9, 1)} {_SCORES}")
def early_exit_score(spark, d):
    return scored(spark, d, mc=0.9, step=1)


@query(f"WITH {scores_sql(K, MC, K)} {_SCORES}")
def score_all_groups(spark, d):
    return scored(spark, d)


_ROWS = 'SELECT read_key, grp AS "group", len, match, min_err, label FROM rows'


@query(f"WITH {rows_sql(K, MC, K)} {_ROWS}")
def strand_choice(spark, d):
    return compared(spark, d)


_TURNS = f"reads AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS read_key, CASE WHEN turn % 2 = 0 THEN {DNA} ELSE {RC.format(DNA)} END AS seq FROM conversations)"


@query(f"WITH {rows_sql(16, 0.2, 16, _TURNS)} {_ROWS}")
def strand_choice_turns(spark, d):
    seq = dna.text_to_dna(F.col("text"))
    own = t(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("read_key"), F.when(F.col("turn") % 2 == 0, seq).otherwise(dna.reverse_complement(seq)).alias("seq"))
    return S.compare_fresh(own, refs(spark, d), groups(spark, d), 16, 0.2)


@query(f"WITH {rows_sql(K, MC, K)} SELECT read_key, grp AS \"group\", CASE WHEN label = 'MM' THEN 'MM' ELSE 'M' END AS side, match, min_err FROM rows")
def match_mismatch_split(spark, d):
    return compared(spark, d).select("read_key", "group", F.when(F.col("label") == S.MISMATCH, "MM").otherwise("M").alias("side"), "match", "min_err")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    own = reads(spark, d)
    rows = S.compare_hits(own, database(spark, d, K, own), K, MC)
    return S.alignment_counts_of_hits(rows, groups(spark, d), own.agg(F.countDistinct("read_key")).scalar())


_COUNTS = "count(*) FILTER (label = 'M_ORG') AS aligned_fwd, count(*) FILTER (label = 'M_COMP') AS aligned_rev, count(*) FILTER (label = 'MM') AS not_aligned"


@query(f"WITH {rows_sql(K, MC, K)} SELECT grp AS \"group\", {_COUNTS} FROM rows GROUP BY ALL")
def alignment_counts(spark, d):
    return aligned(spark, d)


@query(f"WITH {rows_sql(K, MC, K)} SELECT grp AS \"group\", {_COUNTS}, {K} AS k, 5 AS cutoff FROM rows GROUP BY ALL")
def class_metrics(spark, d):
    return aligned(spark, d).withColumn("k", F.lit(K)).withColumn("cutoff", F.lit(5))


# --- assigning ------------------------------------------------------------------------------------------------

_ASSIGNED = 'SELECT read_key, grp AS "group", match, min_err FROM'


@query(f"WITH {kept_sql()} {_ASSIGNED} kept WHERE best > 0 AND n_groups = 1")
def best_group_unique(spark, d):
    return A.assign(candidates(spark, d), A.UNIQUE)


@query(f"WITH {kept_sql()} {_ASSIGNED} kept WHERE best > 0")
def best_group_all(spark, d):
    return A.assign(candidates(spark, d), A.ALL)


@query(f"WITH {kept_sql(80)}, h AS (SELECT *, row_number() OVER (PARTITION BY read_key ORDER BY md5(CAST(read_key AS VARCHAR) || '|' || grp)) AS rn FROM kept WHERE best > 0) {_ASSIGNED} h WHERE rn = 1")
def best_group_hash(spark, d):
    return A.assign(candidates(spark, d, 80), A.ONE)


@query(f"WITH {kept_sql(90)} {_ASSIGNED} kept WHERE best > 0")
def best_group_sim90(spark, d):
    return A.assign(candidates(spark, d, 90), A.ALL)


@query(f"WITH {kept_sql(100, "label <> 'MM'", K, 0.9)} {_ASSIGNED} kept WHERE best > 0")
def match_only_assign(spark, d):
    return A.assign(candidates(spark, d, mismatches=False, cutoff=90), A.ALL)


@query(f"WITH {rows_sql(K, MC, K)} SELECT read_key, grp AS \"group\", match, min_err, CAST(row_number() OVER (PARTITION BY read_key ORDER BY match DESC, min_err, grp) AS INTEGER) AS place FROM rows")
def group_ranking(spark, d):
    return A.rank(compared(spark, d)).select("read_key", "group", "match", "min_err", "place")


@query(f"WITH {kept_sql(100, 'true', 24)} SELECT DISTINCT read_key FROM kept WHERE best = 0")
def unclassified_reads(spark, d):
    return A.unclassified(candidates(spark, d, k=24))


@query(f"WITH {kept_sql(60)} SELECT read_key, grp AS \"group\", match, min_err, n_groups FROM kept WHERE best > 0 AND n_groups > 1")
def multiclass_reads(spark, d):
    return A.multiclass(candidates(spark, d, 60))


@query(f"WITH {kept_sql(60)}, h AS (SELECT DISTINCT read_key, n_groups FROM kept) SELECT n_groups, count(*) AS n_reads FROM h GROUP BY ALL")
def tie_histogram(spark, d):
    return A.tie_histogram(candidates(spark, d, 60))


@query(f"WITH {rows_sql(K, MC, K)} SELECT count(DISTINCT read_key) AS n_reads FROM rows")
def scored_read_count(spark, d):
    return A.scored_reads(compared(spark, d))


_TRUTH = "CASE WHEN read_key % 5 = 0 THEN NULL WHEN read_key % 5 = 1 THEN 'fr' ELSE 'e' END"


@query(f"""WITH {kept_sql(80)}, a AS (SELECT *, {_TRUTH} AS truth FROM kept WHERE best > 0 AND n_groups = 1), v AS (SELECT CASE WHEN truth IS NULL THEN 'NK' WHEN contains(grp, truth) THEN 'TP' ELSE 'FP' END AS v FROM a),
    r AS (SELECT DISTINCT read_key, best, n_groups FROM kept)
    SELECT count(*) FILTER (v = 'TP') AS tp, count(*) FILTER (v = 'FP') AS fp, count(*) FILTER (v = 'NK') AS nk, (SELECT count(*) FROM r WHERE best = 0 OR n_groups > 1) AS not_known, (SELECT count(*) FROM r WHERE best > 0 AND n_groups > 1) AS multi FROM v""")
def confusion_counts(spark, d):
    kept = candidates(spark, d, 80)
    key = F.col("read_key") % 5
    tagged = A.assign(kept).withColumn("truth", F.when(key == 0, None).when(key == 1, "fr").otherwise("e"))
    return A.confusion(A.check_truth(tagged), kept)


@query(f"WITH {kept_sql()} SELECT k.read_key, k.grp AS \"group\", b.text FROM kept k JOIN benchmark b ON b.item_id = k.read_key WHERE best > 0 AND n_groups = 1")
def reads_with_sequence_join(spark, d):
    own = t(spark, d, "benchmark").select(F.col("item_id").alias("read_key"), "text")
    return A.with_sequences(A.assign(candidates(spark, d)), own)[0].select("read_key", "group", "text")


_REFS2 = f"refs AS (SELECT doc_id, lang || '/' || source AS grp, {DNA} AS seq FROM documents)"
_HIER = f"""WITH a AS (WITH {kept_sql()} SELECT read_key, grp AS parent FROM kept WHERE best > 0 AND n_groups = 1),
    r AS (WITH {rows_sql(K, MC, K).replace(REFS, _REFS2).replace(GROUPS, 'groups AS (SELECT DISTINCT grp FROM refs)')} SELECT * FROM rows),
    b AS (SELECT r.*, a.parent, max(match) OVER (PARTITION BY r.read_key) AS best FROM r JOIN a ON a.read_key = r.read_key AND starts_with(r.grp, a.parent || '/')),
    c AS (SELECT *, count(*) OVER (PARTITION BY read_key) AS n_groups FROM b WHERE match >= best)
    SELECT read_key, parent, substr(grp, length(parent) + 2) AS "group", match, min_err, label, n_groups FROM c"""


@query(_HIER)
def hier_level2_assign(spark, d):
    own = reads(spark, d)
    # One database for both ranks: the parents' is the children's without their names.
    db = kmerdb.members(refs(spark, d).withColumnRenamed("group", "parent").withColumnRenamed("source", "group"), K, S.read_kmers(S.both_strands(own), K), ["parent", "group"])
    upper = db.select(F.col("parent").alias("group"), "kmer").distinct()
    assigned = A.assign(classify(own, upper, Settings(k=K), groups(spark, d))).select("read_key", F.col("group").alias("parent"))
    tree = t(spark, d, "documents").select(F.col("lang").alias("parent"), F.col("source").alias("group")).distinct()
    kept = classify_children(assigned, own, db, Settings(k=K), tree)
    return kept.select("read_key", "parent", "group", "match", "min_err", "label", "n_groups")
