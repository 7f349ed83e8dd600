"""The ten queries opN_<name> with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import DigestIndex
from .lang_id import fit, in_training, predict
from .mixing import Mix
from .near_dedup import near_duplicates
from .pieces import encode
from .pii import find
from .substring_dedup import dedup_substrings
from .token_count import count_tokens
from .topk import top_k, usable
from .url_filter import LIMIT, RULES, Z, judge, path_of


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op4_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = fit(docs.filter(in_training(F.col("doc_id"))))
    return predict(docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "text"), prototypes)


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)


def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("key") % 50 == 0))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's outcome is the label of the document that its path numbers: good if of quality and not toxic."""
    number = F.expr("try_cast(regexp_extract(_path, '^/[^/]+/([0-9]{1,18})(?![0-9])', 1) as bigint)")
    numbered = pages.select("page_id", path_of(F.col("url")).alias("_path")).select("page_id", number.alias("doc_id")).filter("doc_id is not null")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")
    return numbered.join(labels.select("doc_id", good.alias("good")), "doc_id").select("page_id", "good")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Two batches into one index, that of the greater keys first: the row that stays is then the one that the index has.
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    first = F.coalesce(F.col("doc_id") > F.lit(None if low is None else (low + high) // 2).cast("long"), F.lit(False))
    index = DigestIndex.at(spark)
    out = index.labels([index.append(docs.filter(first), batch="greater keys"), index.append(docs.filter(~first), batch="smaller keys")])
    index.drop()
    return out.withColumnRenamed("key", "doc_id").select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_find_pii": op4_find_pii,
    "op5_language_id": op5_language_id,
    "op6_piece_sampling": op6_piece_sampling,
    "op7_url_filter": op7_url_filter,
    "op8_count_tokens": op8_count_tokens,
    "op9_top_k": op9_top_k,
    "op10_exact_dedup": op10_exact_dedup,
}

def _rules_sql() -> tuple[str, str]:
    """CASE expressions for the longest rule that fits, and its verdict."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))]
    return tuple("CASE " + " ".join(f"WHEN {f} THEN '{x[i]}'" for f, *x in fits) + " END" for i in (0, 1))


def _strength_sql(level: str) -> str:
    """The prior's strength and the good rate of a level's groups."""
    return f"""{level}_s AS (SELECT count(*) AS k, sum(n) AS n, sum(good) AS g, sum(n * n) AS nn, sum(good * good / n) AS gg FROM {level}),
    {level}_r AS (SELECT CASE WHEN n > 0 THEN g / n ELSE 1.0 END AS p, CASE WHEN n > 0 AND g / n > 0 AND g / n < 1 AND n - nn / n - (k - 1) > 0
        THEN ((gg - n * (g / n) * (g / n)) / ((g / n) * (1 - g / n)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0.1 END AS raw FROM {level}_s),
    {level}_m AS (SELECT p, (1 - least(0.5, greatest(0.001, raw))) / least(0.5, greatest(0.001, raw)) AS m FROM {level}_r)"""


def _upper_sql(a: str, b: str) -> str:
    return f"least(1.0, {a} / ({a} + {b}) + {Z} * sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1))))"


_SPACE = r"[\x20\x09-\x0D]+"


def _words_sql(text: str) -> str:
    """doc_id and w, a text's words in order."""
    return f"w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents)"


SQL: dict[str, str] = {
    "op1_near_dedup": rf"""
        WITH RECURSIVE {_words_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN ends ON x = r)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept FROM reach d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
    """,
    "op3_substring_dedup": rf"""
        WITH {_words_sql('text')},
        p AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50)),
        f AS (SELECT k, min(doc_id) AS first FROM p GROUP BY k HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, p + i AS p FROM p JOIN f USING (k), (SELECT unnest(range(0, 50)) AS i) WHERE doc_id > first),
        each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op7_url_filter": rf"""
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        num AS (SELECT page_id, TRY_CAST(nullif(regexp_extract(path, '^/[^/]+/([0-9]{{1,18}})', 1), '') AS BIGINT) AS doc_id FROM u),
        good AS (SELECT page_id, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END)) AS good FROM num JOIN labels USING (doc_id) GROUP BY page_id),
        hosts AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS good FROM u JOIN good USING (page_id) GROUP BY host),
        parts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM u),
        named AS (SELECT host, array_to_string(l[greatest(1, len(l) - 1):], '.') AS domain, l[-1] AS suffix FROM parts),
        h AS (SELECT hosts.*, domain, suffix FROM hosts JOIN named USING (host)),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
        s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
        {_strength_sql('h')}, {_strength_sql('d')}, {_strength_sql('s')},
        ms AS (SELECT suffix, (good + s_m.m * s_m.p) / (n + s_m.m) AS mean_s FROM s, s_m),
        md AS (SELECT domain, suffix, mean_s, (good + d_m.m * mean_s) / (n + d_m.m) AS mean_d FROM d JOIN ms USING (suffix), d_m),
        mh AS (SELECT host, good + h_m.m * mean_d AS a, n - good + h_m.m * (1 - mean_d) AS b FROM h JOIN md USING (domain, suffix), h_m),
        prior AS (SELECT named.host, coalesce(md.mean_d, ms.mean_s) AS q FROM named LEFT JOIN md USING (domain) LEFT JOIN ms ON ms.suffix = named.suffix),
        bound AS (SELECT prior.host, coalesce({_upper_sql('a', 'b')}, {_upper_sql('(q * h_m.m)', '((1 - q) * h_m.m)')}, 1.0) AS upper FROM prior LEFT JOIN mh USING (host), h_m)
        SELECT page_id, host, path, {_rules_sql()[0]} AS rule, coalesce({_rules_sql()[1]}, CASE WHEN upper < {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM u JOIN bound USING (host)
    """,
    "op9_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d
    """,
}
