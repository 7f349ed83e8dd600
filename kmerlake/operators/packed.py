"""Reads against fresh sequences where k-mers would be too many rows: they travel as packed sets.

A task turns its sequences into sorted sets of k-mers, a few million at a time, and cuts each set into buckets. A row is
a set's part in a bucket: two bytes for a 16-mer, where a row for each k-mer takes several times that and a sort. Reads are
dealt into batches by key; a batch asks each bucket once for each k-mer it has, gets back one bit for each of them and
group that has any, and folds its reads' places itself. Every k-mer of both sides is looked at; the sets are exact.

Made for few groups of many sequences: rows are at least sets times groups. With many small groups, score.hit_scores() fits better.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import check_k
from ..shared import arrow
from .score import EPS, FORWARD, REVERSE

#: Bases that a task turns into one set; longer sequences are cut, with an overlap.
PIECE = 4 << 20
#: Bases of a batch of reads, about.
BATCH_BASES = 1 << 19
#: Leading bits of a k-mer that name its bucket, and those that are counted instead of written, at most.
BUCKET_BITS, PREFIX_BITS = 12, 16
#: Up to so many bits a bucket's set is a table of flags, else a sorted list.
FLAG_BITS = 24

# Bytes to bases: 4 is none, 5 the second or a later byte of a sign, which is one place.
_DIGITS = np.full(256, 4, np.uint8)
_DIGITS[0x80:0xC0] = 5
for _i, _b in enumerate("ACGT"):
    _DIGITS[[ord(_b), ord(_b.lower())]] = _i


def prefix_bits(k: int) -> int:
    return min(PREFIX_BITS, 2 * k - 8)


def bucket_bits(k: int) -> int:
    return min(BUCKET_BITS, prefix_bits(k))


def digits(text: bytes) -> np.ndarray:
    d = _DIGITS[np.frombuffer(text, np.uint8)]
    return d[d != 5] if (d == 5).any() else d


def mixed(codes: np.ndarray, k: int) -> np.ndarray:
    """One to one on numbers of 2k bits, so that buckets hold about as many k-mers each."""
    kind = codes.dtype.type
    mask = kind((1 << 2 * k) - 1)
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        codes = ((codes ^ (codes >> kind(k))) * kind(factor & int(np.iinfo(kind).max))) & mask
    return codes ^ (codes >> kind(k))


def windows(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose k signs are all bases, and their k-mers, mixed."""
    kind = np.uint32 if k <= 16 else np.uint64
    if len(d) < k:
        return np.zeros(0, np.int64), np.zeros(0, kind)
    bad = np.zeros(len(d) + 1, np.int32)
    np.cumsum(d > 3, out=bad[1:])
    # Twice as wide each time; the widths that add up to k are joined on the way.
    part, width, out, have, left = (d & 3).astype(kind), 1, None, 0, k
    while True:
        if left & 1:
            n = len(d) - have - width + 1
            out = part if out is None else (out[:n] << kind(2 * width)) | part[have:]
            have += width
        left >>= 1
        if not left:
            break
        part = (part[:-width] << kind(2 * width)) | part[width:]
        width *= 2
    places = np.flatnonzero(bad[k:] == bad[:-k])
    return places, mixed(out[places], k)


def distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)


def pack(found: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """A sorted set by bucket: the buckets it has, k-mers by the rest of the prefix, and what is behind the prefix."""
    low = 2 * k - prefix_bits(k)
    width = -(-low // 8)
    counts = np.bincount((found >> found.dtype.type(low)).astype(np.int64), minlength=1 << prefix_bits(k)).reshape(1 << bucket_bits(k), -1)
    sizes = counts.sum(1)
    there = np.flatnonzero(sizes)
    lows = (found.astype("<u8") & np.uint64((1 << low) - 1)).view(np.uint8).reshape(-1, 8)[:, :width]
    counts = counts[there].astype("<u4")
    return there.astype(np.int32), _binary(counts, np.arange(1, len(there) + 1) * counts.shape[1] * 4), _binary(lows, np.cumsum(sizes[there]) * width)


def unpack(counts: pa.Array, lows: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What is behind the bucket's bits of all k-mers of some rows, and the rows' sizes."""
    low = 2 * k - prefix_bits(k)
    width = -(-low // 8)
    by = _bytes(counts).view("<u4").reshape(len(counts), -1)
    data = _bytes(lows).reshape(-1, width)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, :width] = data
    prefix = np.repeat(np.tile(np.arange(by.shape[1], dtype=np.int64), len(by)), by.ravel())
    return wide.view("<i8").ravel() | (prefix << low), by.sum(1).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of a sorted column."""
    now, held = None, []
    for b in batches:
        v = b.column(column).to_numpy(zero_copy_only=False)
        for i, j in pairwise([0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)] if len(v) else []):
            if held and v[i] != now:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = int(v[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _one(table: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays(table.column(column).chunks)


def group_runs(groups: pa.Array) -> Iterator[tuple[object, int, int]]:
    """Value, begin and end of neighbours that are equal."""
    codes = groups.dictionary_encode().indices.to_numpy()
    for i, j in pairwise([0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)] if len(codes) else []):
        yield groups[i].as_py(), i, j


def fold(at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, next_valid: np.ndarray, k: int, mc: float, step: int, early_exit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """score.fold() and the quick pass over the sorted hit places of many reads side by side: reads, match, min_err."""
    read = np.searchsorted(starts, at, "right") - 1
    pos, length = at - starts[read], lengths[read]
    if step > 1:
        probes = read[(pos == 0) | ((pos % step == 0) & (pos + k < length) & next_valid)]
        through = np.zeros(len(starts), bool)
        through[probes] = True
        kept = through[read]
        read, pos, length = read[kept], pos[kept], length[kept]
    if not len(read):
        return read, read.astype(np.int32), read.astype(np.int32)
    first = np.concatenate(([True], read[1:] != read[:-1]))
    head, own = np.flatnonzero(first), np.cumsum(first) - 1
    tail = np.concatenate((head[1:], [len(read)])) - 1

    def stops(begin: np.ndarray, size: np.ndarray, match: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (size > 0) & (((begin + k) - match) / length.astype(float) - (1 - mc) > EPS) & early_exit

    before = np.concatenate(([-1], pos[:-1]))
    before[head] = -1
    gap = pos - before - 1
    add = np.where(first, k, np.where(gap == 0, 1, np.minimum(gap, k)))
    sums = np.cumsum(add) - add
    stop = stops(before + 1, gap, sums - sums[head][own], length)
    stopped = np.cumsum(stop)
    on = stopped == (stopped - stop)[head][own]
    match = np.add.reduceat(np.where(on, add, 0), head)
    errors = np.add.reduceat(np.where(on, -(-gap // k), 0), head)
    last, n = pos[tail], length[tail]
    rest = n - k + 1 - last - 1
    end = on[tail] & ~stops(last + 1, rest, match, n)
    return read[head], match.astype(np.int32), (errors + np.where(end, -(-rest // k), 0)).astype(np.int32)


def layout(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The reads' signs in a row, with one that is no base before, between and behind them; where reads begin; their lengths."""
    text = b"\n".join([b"", *_one(table, "seq").cast(pa.binary()).to_pylist(), b""])
    lengths = _one(table, "len").to_numpy().astype(np.int64)
    return digits(text), 1 + np.cumsum(lengths + 1) - (lengths + 1), lengths


def other_strand(d: np.ndarray) -> np.ndarray:
    return np.where(d > 3, d, 3 - d)[::-1]


def hit_scores(reads: DataFrame, seqs: DataFrame, k: int, mc: float = 0.05, step: int = 0, early_exit: bool = True, key: str = "read_key", group: str = "group", seq: str = "seq", piece: int = PIECE, batch_bases: int = BATCH_BASES) -> DataFrame:
    """key, strand, group, match, min_err as of score.hit_scores() with the database of seqs. Keys name one read each.

    Sums the reads' lengths at once, for the number of batches; the rest is lazy.
    """
    step, bits = step or check_k(k), bucket_bits(k)
    rest = 2 * k - bits
    spark = reads.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in reads.select(F.col(key).alias("key")).schema.fields + seqs.select(F.col(group).alias("grp")).schema.fields}
    own = reads.select(F.col(key).alias("key"), F.col(seq).alias("seq")).filter(F.col("seq").isNotNull()).withColumn("len", F.length("seq"))
    n_batches = max(spark.sparkContext.defaultParallelism, -(-(own.agg(F.sum("len")).first()[0] or 0) // batch_bases))
    own = own.select(F.pmod(F.xxhash64("key"), F.lit(n_batches)).alias("batch"), "key", "seq", "len")

    sets_schema = f"bucket int, batch long, grp {kinds['grp']}, counts binary, lows binary"
    kind_of_group = seqs.select(F.col(group).alias("grp")).limit(0).toArrow().schema.field("grp").type
    sets_types = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("grp", kind_of_group), ("counts", pa.binary()), ("lows", pa.binary())])

    def rows_of(found: np.ndarray, batch: int, name: object) -> pa.RecordBatch:
        there, counts, lows = pack(found, k)
        return pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), batch)), pa.array([name] * len(there), kind_of_group), counts, lows], schema=sets_types)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[bytes]] = {}
        sizes: dict[object, int] = {}

        def flush(name: object) -> Iterator[pa.RecordBatch]:
            sizes.pop(name)
            d = digits(b"\n".join(held.pop(name)))
            for i in range(0, max(1, len(d) - k + 1), piece):
                yield rows_of(distinct(windows(d[i : i + piece + k - 1], k)[1]), -1, name)

        for b in batches:
            for name, text in zip(b.column("grp").to_pylist(), b.column("seq").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(name, []).append(text)
                sizes[name] = sizes.get(name, 0) + len(text) + 1
                if sizes[name] >= piece:
                    yield from flush(name)
            if sum(sizes.values()) >= 4 * piece:
                for name in list(held):
                    yield from flush(name)
        for name in list(held):
            yield from flush(name)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, table in runs(batches, "batch"):
            d = layout(table)[0]
            yield rows_of(distinct(np.concatenate([windows(x, k)[1] for x in (d, other_strand(d))])), batch, None)

    answer_types = pa.schema([("batch", pa.int64()), ("grp", kind_of_group), ("bucket", pa.int32()), ("hits", pa.binary())])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << rest if rest <= FLAG_BITS else 0, bool)
        out: list[tuple[int, object, int, bytes]] = []
        for bucket, table in runs(batches, "bucket"):
            batch = _one(table, "batch").to_numpy()
            n = int(np.searchsorted(batch, 0))  # the sets come first
            if n in (0, len(batch)):
                continue
            counts, lows = _one(table, "counts"), _one(table, "lows")
            wanted, sizes = unpack(counts[n:], lows[n:], k)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            for name, i, j in group_runs(_one(table, "grp")[:n]):
                there = unpack(counts[i:j], lows[i:j], k)[0]
                if len(flags):
                    flags[there] = True
                    hit = flags[wanted]
                    flags[there] = False
                else:
                    there = distinct(there)
                    hit = there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted
                for r in np.flatnonzero(np.logical_or.reduceat(hit, begins)).tolist():
                    out.append((int(batch[n + r]), name, bucket, np.packbits(hit[begins[r] : ends[r]]).tobytes()))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), answer_types, strict=True)], schema=answer_types)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), answer_types, strict=True)], schema=answer_types)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "batch"):
            n = len(table) - table.column("seq").null_count  # reads come first
            d, starts, lengths = layout(table.slice(0, n))
            keys, answered = _one(table, "key"), table.slice(n)
            # The other strand runs through the reads from the last to the first.
            strands = [(FORWARD, d, starts, lengths, np.arange(n)), (REVERSE, other_strand(d), (len(d) - starts - lengths)[::-1], lengths[::-1], np.arange(n)[::-1])]
            found = [windows(x[1], k) for x in strands]
            kmers, inverse = np.unique(np.concatenate([f[1] for f in found]), return_inverse=True)
            by_bucket = np.bincount((kmers >> kmers.dtype.type(rest)).astype(np.int64), minlength=1 << bits)
            ends = np.cumsum(by_bucket)
            buckets, bitmaps = _one(answered, "bucket").to_pylist() if len(answered) else [], _one(answered, "hits").to_pylist() if len(answered) else []
            for name, i, j in group_runs(_one(answered, "grp")) if len(answered) else ():
                hit = np.zeros(len(kmers), bool)
                for b, x in zip(buckets[i:j], bitmaps[i:j], strict=True):
                    hit[ends[b] - by_bucket[b] : ends[b]] = np.unpackbits(np.frombuffer(x, np.uint8), count=int(by_bucket[b]))
                hits = hit[inverse]
                for (strand, x, begin, length, which), (places, _), h in zip(strands, found, np.split(hits, [len(found[0][0])]), strict=True):
                    at = places[h]
                    read, match, errors = fold(at, begin, length, x[at + k] < 4, k, mc, step, early_exit)
                    if len(read):
                        columns = [keys.take(pa.array(which[read])), pa.array([strand] * len(read)), pa.array([name] * len(read), kind_of_group), pa.array(match), pa.array(errors)]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "strand", "grp", "match", "min_err"])

    named = seqs.select(F.col(group).alias("grp"), F.col(seq).alias("seq")).filter(F.col("grp").isNotNull() & F.col("seq").isNotNull())
    questions = arrow(own.repartition("batch").sortWithinPartitions("batch"), asked, sets_schema)
    by_bucket = arrow(named, sets, sets_schema).unionAll(questions).repartition("bucket").sortWithinPartitions("bucket", "batch", "grp")
    back = arrow(by_bucket, answers, f"batch long, grp {kinds['grp']}, bucket int, hits binary")
    both = own.unionByName(back, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", "grp", "bucket")
    out = arrow(both, folded, f"key {kinds['key']}, strand string, grp {kinds['grp']}, match int, min_err int")
    return out.select(F.col("key").alias(key), "strand", F.col("grp").alias(group), "match", "min_err")
