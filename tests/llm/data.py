"""Small made-up documents with the cases that the operators have to handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = ("digest", "keep_id", "kept", "size", "_source", "theta", "copies", "row", "_row", "_gone", "lang_pred", "score", "key", "doc", "id", "comp", "text2", "_text", "_0")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}{rng.choice(['', ',', '.', 'É'])}" for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passage = words(rng, 70, 10_000)
    base = words(rng, 120, 10_000)
    rows = []
    for i in range(n):
        kind = i % 10
        w = words(rng, rng.randrange(1, 160), 10_000)
        if kind == 1 and rows:
            w = rng.choice(rows)[1].split(" ")
        elif kind in (2, 3, 4):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        elif kind == 5:
            w[len(w) // 2 : len(w) // 2] = passage[: rng.choice([49, 50, 51, 70])]
        elif kind == 6:
            w = words(rng, rng.randrange(0, 5), 3)
        elif kind == 7:
            w = ["same", "line", "again"] * rng.randrange(1, 60)
        text = " ".join(w)
        if kind == 8:
            text = text.replace(" ", rng.choice(["\t", "\n", "  ", "\x0b", "\r\n", "\x0c "]))
        if kind == 9:
            text = text.upper()
        rows.append((i * 3 % (3 * n) + i % 2, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", "B", "é"]), len(text)))
    return rows


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and white texts, signs that only look white, repeated rows."""
    return [
        (1001, None, "en", "a", None), (1002, "", None, "a", 0), (1003, " \t\n", "fr", None, 3), (None, "no key at all", "en", "a", 1), (1004, "one", None, None, 3),
        (1005, "twice the same row", "en", "b", 18), (1005, "twice the same row", "en", "b", 18), (1006, "one word only\x1c!", "en", "b", 1), (1007, "ONE", "en", "b", 3), (1008, "\U0001f600 é ß İ", "en", "b", 1), (None, None, None, None, None),
    ]


def frame(spark, rows, clashes: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        for c in CLASHES:
            df = df.selectExpr("*", f"concat('extra ', doc_id) as `{c}`")
    return df
