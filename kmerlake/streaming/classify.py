"""Reads that arrive as a stream, compared with a fixed database.

A read's rows depend on that read and the database alone, so every micro-batch is an ordinary comparison and no
state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import assign as A
from ..plans.pipeline import Settings, classify


def classify_stream(reads: DataFrame, db: DataFrame, path: str, checkpoint: str, settings: Settings = Settings(), once: bool = True) -> StreamingQuery:
    """Writes the assignments of streamed reads (read_key, seq) to path, a folder for each batch, so a batch that is run again replaces itself."""
    groups = db.select("group").distinct()

    def batch(rows: DataFrame, number: int) -> None:
        A.assign(classify(rows, db, settings, groups), settings.policy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
