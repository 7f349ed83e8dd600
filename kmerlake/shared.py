"""The folder that all machines share, tables staged in it, and Arrow batches for Python workers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders made for sessions on one machine, by application.
_OWN: dict[str, str] = {}
#: Tables that staged() wrote and drop_staged() hasn't removed.
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a session on one machine (tests) gets a folder of its own until it ends; a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        made = tempfile.mkdtemp(prefix="kmerlake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _OWN[context.applicationId] = f"file://{made}"
    return _OWN[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and outlives any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged_so_far() -> int:
    """A mark for drop_staged()."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> int:
    """Removes this process's staged tables from a mark on, but for those that keep reads: whatever was made of them is written. Their number."""
    needed = {f.rsplit("/", 1)[0].split("://")[-1].split(":")[-1] for df in keep for f in df.inputFiles()}
    gone = [p for p in _STAGED[since:] if p.split("://")[-1].split(":")[-1] not in needed]
    for path in gone:
        remove(spark, path)
    _STAGED[since:] = [p for p in _STAGED[since:] if p not in gone]
    return len(gone)


#: Where this package lies.
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Batches for Python workers are cut at this size: texts and sets make rows of many kilobytes, and JVM and worker hold several batches at once.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _give_back() -> None:
    """Workers outlive their tasks; what a task has freed goes back to the machine, so that the stages of a job don't add up in them."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with the GNU C library
    if trim:
        trim(0)


def arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow() in small batches, whose workers find this package wherever they start. On a cluster it is installed, or sent with --py-files."""
    if df.sparkSession.conf.get(_BATCH) in ("64MB", "64m", "67108864b", "67108864"):  # Spark's default
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    env = df.sparkSession.sparkContext.environment
    if _ROOT not in (known := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join(x for x in [*known, _ROOT] if x)

    def tidy(batches: Iterator) -> Iterator:
        yield from f(batches)
        _give_back()

    return df.mapInArrow(tidy, schema)
