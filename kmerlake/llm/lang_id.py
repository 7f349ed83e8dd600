"""Language ID by hyperdimensional profiles.

Every letter has a random +-1 vector. A trigram's vector is the product of its letters' vectors, each
rotated by its place in the trigram; a text's vector is the sum over its trigrams, a language's prototype
the sum over its training texts. A text has the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow

DIMS = 512
UNKNOWN = "und"
#: Letters below DIRECT have a vector each; all others share POOLED vectors by code point. Slot 0 is the gap between words.
DIRECT, POOLED = 0x250, 4096
SLOTS = DIRECT + POOLED
#: A piece of text that is turned into numbers at once; longer texts are taken piece by piece.
PIECE = 1 << 20
#: Trigrams whose vectors are held at once.
SLICE = 4096


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Slot by code point (0: no letter), and the letters' vectors."""
    points = np.arange(0x110000)
    is_letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
    slot = np.where(points < DIRECT, points, DIRECT + points % POOLED) * is_letter
    vectors = np.random.default_rng(5).integers(0, 2, (SLOTS, DIMS), dtype=np.int8) * 2 - 1
    return slot.astype(np.int64), vectors


@cache
def _rotated() -> list[np.ndarray]:
    return [np.roll(_letters()[1], k, axis=1) for k in (2, 1, 0)]


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    a, b, c = _rotated()
    return a[codes // (SLOTS * SLOTS)] * b[codes // SLOTS % SLOTS] * c[codes % SLOTS]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a whole text and their numbers. Runs of non-letters count as one gap; gaps stand at both ends."""
    found: dict[int, int] = {}
    parts, tail = [], np.zeros(1, np.int64)
    for i in range(0, len(text), PIECE):
        s = _letters()[0][np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate([tail, s, np.zeros(int(i + PIECE >= len(text)), np.int64)])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        tail = s[-2:]
        parts = np.unique((s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:], return_counts=True)
        if len(text) <= PIECE:
            return parts
        for code, n in zip(*parts, strict=True):
            found[code] = found.get(code, 0) + int(n)
    return np.array(list(found), np.int64), np.array(list(found.values()), np.int64)


def bundle(text: str | None) -> np.ndarray | None:
    """The text's vector, or None if it has no letter."""
    codes, n = trigrams(text or "")
    if not codes.any():
        return None
    total = np.zeros(DIMS)
    for i in range(0, len(codes), SLICE):
        total += n[i : i + SLICE].astype(np.float32) @ trigram_vectors(codes[i : i + SLICE]).astype(np.float32)
    return total.astype(np.float32)


def in_training(key: Column) -> Column:
    """Four fifths of the documents, by their key. A document without a key isn't learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_langs: int = 2000) -> dict[str, np.ndarray]:
    """Prototypes by language, from every row with a language and a text with a letter.

    Partitions send one vector per language, which Spark adds up; the driver holds DIMS numbers per language.
    More than max_langs languages raise an error.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if (v := bundle(t)) is not None:
                    total[name] = total.get(name, 0) + v / np.linalg.norm(v)
        for name, v in total.items():
            # Whole numbers add up to the same sum in any order.
            yield pa.RecordBatch.from_pydict({"lang": [name] * DIMS, "dim": np.arange(DIMS, dtype=np.int32), "value": np.rint(v * 2**20).astype(np.int64)})

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    sums = rows.transform(arrow, part, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    got = sums.limit(max_langs * DIMS + 1).collect()
    if len(got) > max_langs * DIMS:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    out: dict[str, np.ndarray] = {}
    for name, dim, value in got:
        out.setdefault(name, np.zeros(DIMS))[dim] = value
    return {k: (v / n).astype(np.float32) for k, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all but the text, if not given), lang_pred and score, for every row.

    - score is the cosine with the language's prototype, 0 at least; of equal cosines the first language by name has it.
    - lang_pred is und with score 0 for a null text, one without a letter, or without any prototype.
    - Rows are independent; other columns can't clash, as only those in keep are carried.
    """
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(-1, DIMS)

    def label(t: str | None) -> tuple[str, float]:
        v = bundle(t) if names else None
        if v is None or not (n := np.linalg.norm(v)):
            return UNKNOWN, 0.0
        cos = matrix @ v / n
        k = int(cos.argmax())
        return names[k], min(1.0, max(0.0, float(cos[k])))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [label(t) for t in b.column(b.num_columns - 1).to_pylist()]
            arrays = [*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [f"_{i}" for i in range(len(arrays))])

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = ", ".join([f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"_{len(keep)} string", f"_{len(keep) + 1} double"])
    return rows.transform(arrow, part, schema).toDF(*keep, "lang_pred", "score")


def noise_bound(n_langs: int, chance: float = 0.01) -> float:
    """The score that a text unrelated to all of n_langs prototypes passes with that chance: each of its cosines is normal with spread 1 / sqrt(DIMS)."""
    return NormalDist(0, DIMS**-0.5).inv_cdf((1 - chance) ** (1 / max(1, n_langs)))


def judged(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float | None = None, text: str = "text") -> DataFrame:
    """row (the columns of docs), lang_pred, score, accepted: whether the language is known and the score above min_score, by default the noise bound."""
    least = noise_bound(len(prototypes)) if min_score is None else min_score
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return predict(packed, prototypes, "text", ["row"]).withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") > least))


def accept(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float | None = None, text: str = "text") -> DataFrame:
    """The accepted rows of judged(), with their own columns."""
    return judged(docs, prototypes, min_score, text).filter("accepted").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
