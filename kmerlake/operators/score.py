"""Comparing reads with k-mer databases: hits, runs, scores, strands.

Scores come from hits alone: places that miss are the gaps between them, so the exploded reads meet the database in
one inner join, and nothing is stored for a k-mer that no group has. The places of a read's hits, a number bounded by
its length, are folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import check_k, explode_kmers, normal_bases, reverse_complement

#: Fixed tolerance of the comparisons with a cutoff.
EPS = 1e-6
FORWARD, REVERSE = "+", "-"
ORG, COMP, MISMATCH = "M_ORG", "M_COMP", "MM"


def both_strands(reads: DataFrame, keys: str | list[str] = "read_key", seq: str = "seq") -> DataFrame:
    """keys, strand, len, seq: each read and its reverse complement."""
    keys = [keys] if isinstance(keys, str) else keys
    own = reads.select(*keys, normal_bases(F.col(seq)).alias("seq"))
    strands = F.array(F.struct(F.lit(FORWARD).alias("strand"), F.col("seq")), F.struct(F.lit(REVERSE).alias("strand"), reverse_complement(F.col("seq")).alias("seq")))
    return own.select(*keys, F.length("seq").alias("len"), F.explode(strands).alias("s")).select(*keys, "s.strand", "len", "s.seq")


def read_kmers(strands: DataFrame, k: int) -> DataFrame:
    """The valid k-mers of reads by strand, with next_valid: the base behind is one, too (false at the end)."""
    return explode_kmers(strands, k)


def hits(kmers: DataFrame, db: DataFrame, group: str | list[str] = "group", on: list[str] | None = None) -> DataFrame:
    """Places of k-mers that a group has. The database names a k-mer once a group, so nothing multiplies."""
    groups = [group] if isinstance(group, str) else group
    return kmers.join(db.select(*dict.fromkeys([*(on or []), *groups]), "kmer"), [*(on or []), "kmer"]).drop("kmer")


def is_probe(k: int, step: int) -> Column:
    """Places that the quick pass looks at: the first, and every step-th whose window and the base behind it end before the read's last base."""
    return (F.col("pos") == 0) | ((F.col("pos") % step == 0) & (F.col("pos") + k < F.col("len")) & F.col("next_valid"))


def hit_runs(found: DataFrame, by: list[str]) -> DataFrame:
    """Gaps and islands: by, run_start, run_len of each run of neighbouring hits."""
    w = Window.partitionBy(*by).orderBy("pos")
    islands = found.withColumn("island", F.col("pos") - F.row_number().over(w))
    return islands.groupBy(*by, "island").agg(F.min("pos").alias("run_start"), F.count(F.lit(1)).alias("run_len")).drop("island")


def stops(at: Column, match: Column, k: int, length: Column, mc: float) -> Column:
    """At a gap's start: the read can't reach the cutoff any more."""
    return ((at + k) - match) / F.nullif(length.cast("double"), F.lit(0.0)) - (1 - F.lit(float(mc))) > EPS


def fold(places: Column, k: int, length: Column, mc: float, early_exit: bool = True) -> Column:
    """(match, min_err) of sorted hit places.

    A run of n hits adds n - 1 and, if it is the first, k, else the gap before it up to k; a gap of n adds ceil(n / k) errors.
    Scoring stops at a gap from which the cutoff is out of reach; what was scored until then stays.
    """

    def gap(state: Column, to: Column) -> tuple[Column, Column, Column]:
        size = to - state["prev"] - 1
        stop = (size > 0) & stops(state["prev"] + 1, state["match"], k, length, mc) if early_exit else F.lit(False)
        return size, stop, state["err"] + F.when(size > 0, F.ceil(size / k)).otherwise(0).cast("int")

    def step(state: Column, place: Column) -> Column:
        size, stop, err = gap(state, place)
        add = F.when(state["match"] == 0, k).when(size == 0, 1).otherwise(F.least(size, F.lit(k)))
        on = F.struct(place.alias("prev"), (state["match"] + add).cast("int").alias("match"), err.alias("err"), F.lit(False).alias("stop"))
        off = F.struct(state["prev"].alias("prev"), state["match"].alias("match"), state["err"].alias("err"), F.lit(True).alias("stop"))
        return F.when(state["stop"] | stop, off).otherwise(on)

    def finish(state: Column) -> Column:
        _, stop, err = gap(state, (length - k + 1).cast("int"))
        return F.struct(state["match"].alias("match"), F.when(state["stop"] | stop, state["err"]).otherwise(err).alias("min_err"))

    start = F.struct(F.lit(-1).alias("prev"), F.lit(0).alias("match"), F.lit(0).alias("err"), F.lit(False).alias("stop"))
    return F.aggregate(places, start, step, finish)


def passes(match: Column, length: Column, mc: float) -> Column:
    """The read's share of matched bases reaches the cutoff; an empty read never does."""
    share = match / F.nullif(length.cast("double"), F.lit(0.0))
    return (length > 0) & ((share > mc) | (F.abs(share - F.lit(float(mc))) <= EPS))


def hit_scores(reads: DataFrame, db: DataFrame, k: int, mc: float = 0.05, step: int = 0, early_exit: bool = True, key: str = "read_key", group: str | list[str] = "group", on: list[str] | None = None) -> DataFrame:
    """key, strand, group, len, match, min_err of the read strands and groups that share a k-mer, if the quick pass lets them through.

    step 0 means k, 1 no quick pass. on: further columns that reads and database must agree in, besides the k-mer.
    """
    step, groups, more = step or check_k(k), [group] if isinstance(group, str) else group, on or []
    own = [key, *[c for c in more if c not in groups]]
    found = hits(read_kmers(both_strands(reads, [*own, *[c for c in more if c in groups]]), k), db, groups, more)
    by = [*own, "strand", *groups]
    folded = found.groupBy(*by).agg(F.max("len").alias("len"), F.array_sort(F.collect_list("pos")).alias("places"), F.max(is_probe(k, step)).alias("probed") if step > 1 else F.lit(True).alias("probed"))
    return folded.filter("probed").select(*by, "len", fold(F.col("places"), k, F.col("len"), mc, early_exit).alias("x")).select(*by, "len", "x.match", "x.min_err")


def errors_without_hits(length: Column, k: int, mc: float, step: int = 0, early_exit: bool = True) -> Column:
    """A read without hits is one gap from end to end, unless the quick pass leaves it out."""
    places = F.greatest(length - k + 1, F.lit(0))
    if (step or k) > 1:
        return F.lit(0)
    return F.when((places > 0) & ~(stops(F.lit(0), F.lit(0), k, length, mc) if early_exit else F.lit(False)), F.ceil(places / k)).otherwise(0).cast("int")


def score(reads: DataFrame, db: DataFrame, groups: DataFrame, k: int, mc: float = 0.05, step: int = 0, early_exit: bool = True, key: str = "read_key", group: str = "group") -> DataFrame:
    """Both strands of every read against every group: key, group, strand, len, match, min_err.

    This lists pairs without a hit, too, a row for each read and group; assignment needs compare_hits() only.
    groups: one row per group; Spark broadcasts the list if it is small enough.
    """
    return all_pairs(reads, hit_scores(reads, db, k, mc, step, early_exit, key, group).drop("len"), groups, k, mc, step, early_exit, key, group)


def all_pairs(reads: DataFrame, scored: DataFrame, groups: DataFrame, k: int, mc: float, step: int, early_exit: bool, key: str, group: str) -> DataFrame:
    """scored, and a row for each read strand and group that it has none for."""
    everything = both_strands(reads, [key]).drop("seq").crossJoin(groups.select(group).distinct())
    none = errors_without_hits(F.col("len"), k, mc, step, early_exit)
    out = everything.join(scored, [key, "strand", group], "left")
    return out.select(key, group, "strand", "len", F.coalesce("match", F.lit(0)).cast("int").alias("match"), F.coalesce(F.col("min_err"), none).cast("int").alias("min_err"))


def choose_strand(scores: DataFrame, mc: float = 0.05, key: str = "read_key", group: str | list[str] = "group", none: Column | None = None) -> DataFrame:
    """One row for each read and group: the forward score if it passes (M_ORG), else the reverse one (M_COMP if it passes, else MM).

    none: the errors of a strand that has no row, in terms of len.
    """
    fwd, groups = F.struct("match", "min_err"), [group] if isinstance(group, str) else group
    both = scores.groupBy(key, *groups).agg(F.max("len").alias("len"), F.max(F.when(F.col("strand") == FORWARD, fwd)).alias("f"), F.max(F.when(F.col("strand") == REVERSE, fwd)).alias("r"))
    if none is not None:
        empty = F.struct(F.lit(0).alias("match"), none.cast("int").alias("min_err"))
        both = both.withColumn("f", F.coalesce("f", empty)).withColumn("r", F.coalesce("r", empty))
    ok = passes(F.col("f.match"), F.col("len"), mc)
    label = F.when(ok, ORG).when(passes(F.col("r.match"), F.col("len"), mc), COMP).otherwise(MISMATCH)
    best = F.when(ok, F.col("f")).otherwise(F.col("r"))
    return both.select(key, *groups, "len", best["match"].alias("match"), best["min_err"].alias("min_err"), label.alias("label"))


def compare(reads: DataFrame, db: DataFrame, groups: DataFrame, k: int, mc: float = 0.05, step: int = 0, key: str = "read_key", group: str = "group") -> DataFrame:
    """Score rows of all reads against all groups; see score() and choose_strand()."""
    return choose_strand(score(reads, db, groups, k, mc, step, True, key, group), mc, key, group)


def compare_fresh(reads: DataFrame, seqs: DataFrame, groups: DataFrame, k: int, mc: float = 0.05, step: int = 0, key: str = "read_key", group: str = "group") -> DataFrame:
    """compare() with fresh sequences instead of their database, for many reads: k-mers travel as packed sets, see packed."""
    from . import packed  # needs numpy and pyarrow, which the rest does without

    scored = packed.hit_scores(reads, seqs, k, mc, step, True, key, group)
    return choose_strand(all_pairs(reads, scored, groups, k, mc, step, True, key, group), mc, key, group)


def compare_hits(reads: DataFrame, db: DataFrame, k: int, mc: float = 0.05, step: int = 0, key: str = "read_key", group: str | list[str] = "group", on: list[str] | None = None) -> DataFrame:
    """The rows of compare() for reads and groups that share a k-mer: all others have match 0. No row stands for a pair without a hit."""
    scored = hit_scores(reads, db, k, mc, step, True, key, group, on)
    return choose_strand(scored, mc, key, group, errors_without_hits(F.col("len"), k, mc, step))


def label_without_hits(length: Column, mc: float) -> Column:
    return F.when(passes(F.lit(0), length, mc), ORG).otherwise(MISMATCH)


def alignment_counts(rows: DataFrame, group: str = "group") -> DataFrame:
    """By group, of the rows of compare()."""
    n = lambda label: F.sum((F.col("label") == label).cast("long"))
    return rows.groupBy(group).agg(n(ORG).alias("aligned_fwd"), n(COMP).alias("aligned_rev"), n(MISMATCH).alias("not_aligned"))


def alignment_counts_of_hits(rows: DataFrame, groups: DataFrame, n_reads: Column, group: str = "group") -> DataFrame:
    """The same of the rows of compare_hits(), for every group, at a cutoff above 0: whatever has no row isn't aligned. n_reads: of all reads."""
    found = groups.select(group).distinct().join(alignment_counts(rows, group), group, "left").fillna(0)
    return found.withColumn("not_aligned", n_reads - F.col("aligned_fwd") - F.col("aligned_rev"))
