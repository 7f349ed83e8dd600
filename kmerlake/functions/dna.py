"""Bases, k-mers and strands as column expressions and DataFrame steps. No UDFs.

A k-mer is a number, two bits a base; kmer_text() writes it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K_MIN, K_MAX = 8, 31
#: Bases of a tile, as many as a number holds at two bits each. A window lies in a tile and the one behind it.
TILE = 31
#: Fixed mapping of letters to bases for text that isn't DNA: the alphabet, in turn, to A, C, G, T.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGT"
MAPPED = "".join(BASES[i % 26 % 4] for i in range(52))


def check_k(k: int) -> int:
    if not K_MIN <= k <= K_MAX:
        raise ValueError(f"k must be between {K_MIN} and {K_MAX}")
    return k


def text_to_dna(text: Column) -> Column:
    """ASCII letters only, mapped to bases. The filter comes first: changing case could make ASCII letters of others."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), ALPHABET, MAPPED)


def text_to_dna_n(text: Column) -> Column:
    """Likewise, but digits and line ends become N, which no k-mer may hold."""
    return F.translate(F.regexp_replace(F.regexp_replace(text, r"[0-9\n]", "#"), "[^A-Za-z#]", ""), ALPHABET + "#", MAPPED + "N")


def normal_bases(seq: Column) -> Column:
    """Both cases of A, C, G, T as upper case; every other sign as N."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def base_codes(seq: Column) -> Column:
    """A C G T as 0 1 2 3, anything else as a dash."""
    return F.translate(normal_bases(seq), "ACGTN", "0123-")


def is_valid(kmer: Column) -> Column:
    return ~kmer.rlike("[^ACGT]")


def reverse_complement(seq: Column) -> Column:
    """Signs that aren't bases stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def kmer_code(kmer: Column) -> Column:
    """A k-mer (k up to 31) as a number, two bits a base."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def kmer_text(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def _tile(part: Column) -> Column:
    """A tile's bases as a number (c), 0 for what is no base, and a bit for each place that has none (x). Few tiles have such a place."""
    full, odd = F.rpad(part, TILE, "N"), (F.length(part) < TILE) | part.contains("N")
    number = lambda c, base: F.conv(c, base, 10).cast("long")
    return F.struct(number(F.when(odd, F.translate(full, "N", "0")).otherwise(part), 4).alias("c"), F.when(odd, number(F.translate(full, "0123N", "00001"), 2)).otherwise(F.lit(0).cast("long")).alias("x"))


def explode_kmers(df: DataFrame, k: int, seq: str = "seq", valid_only: bool = True) -> DataFrame:
    """df's columns but seq, with pos (from 0), kmer and next_valid: a row for each place; shorter sequences have none.

    The sequence, both cases of A, C, G, T and signs that are no base, is cut into tiles once, and each tile becomes a number
    once; a window is cut out of two neighbouring numbers by shifts. So the work is linear in the length, and no k-mer is ever a string.
    next_valid: the base behind the window is one (false at the end). Without valid_only all places come, with a column valid.
    """
    rest = [c for c in df.columns if c != seq]
    kept = [F.col(f"`{c}`") for c in rest]
    # A sign costs most where it is looked up, so bases become digits in one go.
    digits = F.regexp_replace(F.translate(seq, "ACGTacgt0123", "01230123NNNN"), "[^0-3]", "N")
    cut = df.select(*kept, digits.alias("_seq")).select(*kept, F.length("_seq").alias("_len"), F.regexp_extract_all(F.col("_seq"), F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0)).alias("_tiles"))
    codes = cut.select(*kept, "_len", F.transform("_tiles", _tile).alias("_codes"))
    # Neighbours side by side; what lies behind the end is no base.
    none = F.struct(F.lit(0).cast("long").alias("c"), F.lit((1 << TILE) - 1).cast("long").alias("x"))
    pairs = F.zip_with("_codes", F.slice("_codes", 2, F.greatest(F.size("_codes"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, none).alias("b")))
    tiles = codes.select(*kept, "_len", F.posexplode(pairs).alias("_tile", "_p"))
    tiles = tiles.select(*kept, "_len", (F.col("_tile") * TILE).alias("_from"), F.col("_p.a.c").alias("_a"), F.col("_p.b.c").alias("_b"), F.col("_p.a.x").alias("_ax"), F.col("_p.b.x").alias("_bx"))
    # A window that passes the end holds places without a base. (A filter on the length would be taken to the scan, and cut there, too.)
    offsets = F.array(*[F.lit(i) for i in range(TILE)])
    if not valid_only:
        offsets = F.slice(offsets, 1, F.least(F.lit(TILE), F.greatest(F.lit(0), F.col("_len") - F.col("_from") - k + 1)))
    places = tiles.select(*kept, "_len", "_from", "_a", "_b", "_ax", "_bx", F.explode(offsets).alias("_at"))
    # A window of n bases from _at on ends over places behind the first tile, or as many before its end.
    over = f"(_at + {k} - {TILE})"

    def window(first: str, second: str, width: int) -> Column:
        own = f"{first} & (shiftleft(1L, {width} * ({TILE} - _at)) - 1)"
        inside = f"shiftright({own}, {width} * -{over})"
        across = f"shiftleft({own}, {width} * {over}) | shiftright({second}, {width} * ({TILE} - {over}))"
        return F.expr(f"case when {over} <= 0 then {inside} else {across} end")

    at = f"{over}"
    behind = F.expr(f"case when {at} < 0 then shiftright(_ax, -{at} - 1) & 1 else shiftright(_bx, {TILE - 1} - {at}) & 1 end")
    valid = window("_ax", "_bx", 1) == 0
    found = places.filter(valid) if valid_only else places.withColumn("valid", valid)
    kmer = window("_a", "_b", 2)
    return found.select(*kept, (F.col("_from") + F.col("_at")).alias("pos"), (kmer if valid_only else F.when(F.col("valid"), kmer)).alias("kmer"), (behind == 0).alias("next_valid"), *([] if valid_only else ["valid"]))


def segments(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The pieces between runs of N: df's columns but seq, with seg_no (from 0) and segment."""
    rest = [c for c in df.columns if c != seq]
    cut = F.filter(F.split(normal_bases(F.col(seq)), "N+"), lambda s: s != "")
    return df.select(*rest, F.posexplode(cut).alias("seg_no", "segment"))
