"""Exact dedup against a persistent digest index.

The index is a folder of tables, each bucketed and sorted by digest with one file a bucket. A batch's digests are written in
the same buckets, so that the sort-merge anti-joins against the index neither move nor sort anything; what is new is
appended as one more table. A manifest names the finished tables and the batches in them: a batch that breaks off leaves
nothing behind that counts, and a batch that comes again is labelled as it was the first time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove
from .common import ascii_lower, fresh_path, staged

#: Digests in a bucket of a batch, about; buckets at least; tables of an index that are merged into one when there are more.
PER_BUCKET, LEAST_BUCKETS, MERGE = 2_000_000, 64, 8


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


@dataclass
class Batch:
    """An appended batch: its rows (key, digest), the table of its groups (digest, last, n), and its number."""

    digests: DataFrame
    groups: str
    seq: int


@dataclass
class DigestIndex:
    """A digest index in a folder of the shared store. Rows: digest (SHA-256, 32 bytes), keep_id, batch: one per digest, whatever a group's size.

    A new session attaches to the same folder again. One writer at a time: a second one that publishes the same version fails.
    """

    spark: SparkSession
    path: str
    buckets: int | None = None
    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)

    @classmethod
    def at(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """Attaches to the index at path, or begins one; buckets: of a new index, by default from the first batch's rows."""
        # Tells a sorted bucket of one file from an unsorted one; Spark checks that there is one file.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        # Spark 4.1 takes a union of bucketed tables for one with their buckets, but lines its partitions up one after the other.
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        index = cls(spark, path or fresh_path(spark, "digest-index"), buckets)
        fs, where = index._fs(index.path)
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        versions = [int(n[9:-5]) for n in found if n.startswith("manifest-") and n.endswith(".json")]
        if versions:
            index.version = max(versions)
            text = "\n".join(r[0] for r in spark.read.text(f"{index.path}/manifest-{index.version}.json").collect())
            known = json.loads(text)
            index.buckets, index.batches, index.tables = known["buckets"], known["batches"], known["tables"]
        return index

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _publish(self, batches: dict[str, int], tables: list[str]) -> None:
        """The new state counts from the moment its manifest has its name."""
        made = f"{self.path}/making-{uuid.uuid4().hex}"
        fs, where = self._fs(made)
        out = fs.create(where, False)
        try:
            out.write(json.dumps({"buckets": self.buckets, "batches": batches, "tables": tables}).encode())
        finally:
            out.close()
        _, name = self._fs(f"{self.path}/manifest-{self.version + 1}.json")
        if fs.exists(name) or not fs.rename(where, name):
            raise RuntimeError(f"another writer has changed the index at {self.path}")
        self.version, self.batches, self.tables = self.version + 1, batches, tables

    def _name(self, folder: str) -> str:
        return "digests_" + hashlib.md5(f"{self.path}/{folder}".encode()).hexdigest()

    def _write(self, df: DataFrame, folder: str) -> str:
        """A bucketed table in the folder. One task writes one bucket, whatever the session's number of partitions: Spark's bucket is this hash."""
        name, rows = self._name(folder), df.repartitionById(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets))).sortWithinPartitions("digest")
        rows.write.mode("overwrite").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{folder}").saveAsTable(name)
        return name

    def _table(self, folder: str) -> DataFrame:
        name = self._name(folder)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch BIGINT) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        return self.spark.table(name)

    def rows(self) -> DataFrame:
        if not self.tables:
            return self.spark.createDataFrame([], "digest binary, keep_id long, batch long")
        return reduce(DataFrame.unionAll, [self._table(t) for t in self.tables])

    def append(self, docs: DataFrame, text: str = "text", key: str = "doc_id", batch: str | None = None) -> Batch:
        """Adds the digests that no earlier batch has. batch: a name by which the same batch is known when it comes again; it adds nothing then."""
        digests = staged(docs.select(F.col(key).cast("long").alias("key"), digest_of(F.col(text)).alias("digest")), "digests")
        if self.buckets is None:
            self.buckets = LEAST_BUCKETS
            while self.buckets * PER_BUCKET < (n := digests.count()):
                self.buckets *= 2 ** max(1, (n // (self.buckets * PER_BUCKET)).bit_length() - 1)
        batch = batch or uuid.uuid4().hex
        seq = self.batches.get(batch, max(self.batches.values(), default=0) + 1)
        groups = self._write(digests.groupBy("digest").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n")), f"groups-{uuid.uuid4().hex}")
        if batch not in self.batches:
            fresh = self.spark.table(groups)
            for t in self.tables:
                fresh = fresh.join(self._table(t).select("digest").hint("merge"), "digest", "left_anti")
            made = f"batch-{seq}-{uuid.uuid4().hex}"
            self._write(fresh.select("digest", F.col("last").alias("keep_id"), F.lit(seq).cast("long").alias("batch")), made)
            self._publish(self.batches | {batch: seq}, [*self.tables, made])
            if len(self.tables) > MERGE:
                old, merged = self.tables, f"merged-{seq}-{uuid.uuid4().hex}"
                self._write(self.rows(), merged)
                self._publish(self.batches, [merged])
                for t in old:
                    self._forget(t, files=True)
        return Batch(digests, groups, seq)

    def labels(self, parts: list[Batch]) -> DataFrame:
        """key, digest, keep_id, group_size, kept for all rows of appended batches, against themselves and all batches before the last of them."""
        seqs = [p.seq for p in parts]
        rows = reduce(DataFrame.unionAll, [p.digests for p in parts])
        # The sums of several batches' groups are taken anew, and dealt out again.
        groups = self.spark.table(parts[0].groups).select("digest", "n") if len(parts) == 1 else staged(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "groups")
        here = F.col("batch").isin(seqs)
        labels = [groups.join(self._table(t).hint("merge"), "digest").filter(F.col("batch") <= max(seqs)) for t in self.tables]
        labels = reduce(DataFrame.unionAll, [x.select("digest", "keep_id", (F.col("n") + (~here).cast("long")).alias("group_size"), here.alias("here")) for x in labels])
        # A group may hold any share of the rows: its one label meets many rows, which Spark splits as a skewed join. It can do
        # so only where both sides are dealt out for the join, not in the index's buckets, so the labels are a table of their own.
        labels = staged(labels, "labels")
        for p in parts:
            where = self.spark.table(p.groups).inputFiles()
            self.spark.sql(f"DROP TABLE {p.groups}")
            if where:
                remove(self.spark, where[0].rsplit("/", 1)[0])
        return rows.join(labels.hint("merge"), "digest").select("key", "digest", "keep_id", "group_size", (F.col("here") & F.col("keep_id").eqNullSafe(F.col("key"))).alias("kept"))

    def add(self, docs: DataFrame, text: str = "text", key: str = "doc_id", batch: str | None = None) -> DataFrame:
        """Dedups a batch against itself and all earlier batches, appends what is new, and labels every row.

        Result, one row per input row: key, digest, keep_id, group_size, kept.
        - Texts are equal if identical after lower-casing A-Z; null counts as empty.
        - Of a batch's equal texts the largest key stays, unless an earlier batch has the text: its row stays.
        - group_size counts the batch's equal rows, and the earlier row if there is one.
        - A named batch that comes again adds nothing and gets the labels of its first time, whatever came after it.
        - A repeated key (the same row twice) is two rows of a group; both are kept if the key stays.
        - A null key never wins over another; a group of null keys only has keep_id null and kept true.
        - Other columns are not read. An empty batch gives an empty result and appends nothing.
        """
        return self.labels([self.append(docs, text, key, batch)]).withColumnRenamed("key", key)

    def _forget(self, folder: str, files: bool) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(folder)}")
        if files:
            remove(self.spark, f"{self.path}/{folder}")

    def close(self) -> None:
        """Leaves the catalog as it was; the index stays in its folder."""
        for t in self.tables:
            self._forget(t, files=False)

    def drop(self) -> None:
        """Removes the index. Labels that it gave are tables of their own."""
        self.close()
        remove(self.spark, self.path)


def drop_copies(docs: DataFrame, index: DigestIndex, text: str = "text", key: str = "doc_id", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each text that no earlier batch has, that with the largest key.

    Of rows with the same text and key any one stays. A row without a key goes if its text has a row with a key, and of several
    such rows any one stays; of those that have no text either one stays in any case. A named batch that comes again keeps the same rows.
    """

    def place(digest: Column, number: Column) -> Column:
        """Names a text and a key; just the text if the key is null."""
        return F.concat(digest, F.coalesce(F.unhex(F.lpad(F.hex(number), 16, "0")), F.unhex(F.lit(""))))

    names = docs.columns
    gone = index.add(docs, text, key, batch).filter(~F.col("kept")).select(place(F.col("digest"), F.col(key)).alias("gone")).distinct()
    bare = F.col(key).isNull() & F.col(text).isNull()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.when(~bare, place(digest_of(F.col(text)), F.col(key).cast("long"))).alias("place"))
    # Partial sums take a repeated row once before rows are dealt out, and the join finds them dealt by place.
    once = rows.groupBy("place").agg(F.first("row").alias("row"))
    return once.join(gone, F.col("place") == F.col("gone"), "left_anti").select(*[F.col("row").getField(c).alias(c) for c in names])
