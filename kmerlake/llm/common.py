"""What the operators share: table access, small tables. Staged tables and Arrow batches are those of kmerlake.shared."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import arrow, drop_staged, fresh_path, shared_dir, staged, staged_so_far  # noqa: F401  for the operators

#: A word is a longest run of bytes other than these six ASCII characters; the contracts fix it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only: lower() would also change other letters, and by the JVM's rules."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows that a plan may hold as a literal.
LITERAL_ROWS = 1000


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows as a table: made in the JVM from one literal, or, if they are more than LITERAL_ROWS, from a file in the shared folder."""
    names = [c.split()[0] for c in schema.split(",")]
    lines = [json.dumps(dict(zip(names, r, strict=True))) for r in rows]
    if len(rows) > LITERAL_ROWS:
        path = fresh_path(spark, "small-table")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write("\n".join(lines).encode())
        finally:
            out.close()
        return spark.read.schema(schema).json(path)
    return spark.range(1).select(F.inline(F.from_json(F.lit(f"[{','.join(lines)}]"), f"array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in schema.split(','))}>>")))


def hash_unit(*keys: Column) -> Column:
    """A double in [0, 1), the same for the same keys on every run."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 12) / F.lit(float(1 << 52))
