"""Substring dedup: words covered by a long window that also starts in an earlier document go.

A count-min sketch over all windows comes first. Equal windows have equal anchors (the smallest of the hashes of
the shorter runs inside a window), and neighbouring windows mostly share theirs, so the sketch counts the documents
of each anchor: never fewer than those of any window under it. A document's digest is one more key. Partitions send
the cells that they fill; ranges of cells are merged apart. A second pass groups exactly the documents whose digest
is estimated to be repeated, and the windows whose anchor is; a later copy of a document goes whole, and only the
first one's windows take part.

The sketch grows with the data, and no machine holds it as a whole: it is a table, and the keys go to its cells. All cells
of a key lie in blocks side by side, so that a key has one place to ask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, drop_staged, staged, staged_so_far
from .shingles import U, mix, runs, word_hashes, words

WINDOW, ANCHOR, ROWS = 50, 38, 3
_MULTIPLIERS = (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9FB21C651E98DF25))
_SPREAD = U(0xD6E8FEB86659FD93)
BLOCK_BITS, FLUSH = 16, 1 << 19
#: Into so many units at most the sketch is dealt; a task holds one at a time.
UNIT_BITS = 17


def anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Each window's anchor: the least hash of the runs of anchor words inside it."""
    least, span = runs(hashes, anchor), window - anchor + 1
    if len(hashes) < window:
        return np.zeros(0, U)
    have = 1
    while have * 2 <= span:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    return np.minimum(least[: len(least) - (span - have)], least[span - have :]) if have < span else least


def digest(hashes: np.ndarray) -> bytes:
    """16 bytes that name a text's words."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def whole_key(hashes: np.ndarray) -> np.ndarray:
    """A text's own key in the sketch."""
    return mix(np.frombuffer(digest(hashes)[:8], "<u8"))


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of the 2**(bits - BLOCK_BITS) stretches of the sketch holds each key's cells; a stretch is one block of every row."""
    return ((keys * _SPREAD) >> U(64 - bits + BLOCK_BITS)).astype(np.int64) if bits > BLOCK_BITS else np.zeros(len(keys), np.int64)


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    """The sketch's cells of each key, those of a row after those of another; a stretch's blocks lie side by side."""
    first = places(keys, bits) * ROWS
    return np.concatenate([((first + r) << BLOCK_BITS) + ((keys * m) >> U(64 - BLOCK_BITS)).astype(np.int64) for r, m in enumerate(_MULTIPLIERS)])


def _stretches(sorted_ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """The runs of equal ids, from and to."""
    edge = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
    return zip(edge.tolist(), [*edge[1:].tolist(), len(sorted_ids)], strict=True)


def _send(keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The cells of keys by block: those filled once, and those filled more often."""
    at, n = np.unique(cells(keys, bits), return_counts=True)
    block = at >> BLOCK_BITS
    ids, once, more = [], [], []
    for a, b in _stretches(block):
        low, several = (at[a:b] & ((1 << BLOCK_BITS) - 1)).astype("<u2"), n[a:b] > 1
        ids.append(int(block[a]))
        once.append(low[~several].tobytes())
        more.append(low[several].tobytes())
    yield pa.RecordBatch.from_pydict({"block": pa.array(ids, pa.int64()), "once": pa.array(once, pa.binary()), "more": pa.array(more, pa.binary())})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partitions' cells. A task holds two bits for each cell of its blocks, whatever the number of partitions."""
    size = 1 << BLOCK_BITS
    seen: dict[int, np.ndarray] = {}  # by block: cells filled, and filled again
    for b in batches:
        for i, once, more in zip(*(b.column(c).to_pylist() for c in ("block", "once", "more")), strict=True):
            bits = np.zeros((2, size), bool) if i not in seen else np.unpackbits(seen[i], axis=1, bitorder="little").view(bool)
            once = np.frombuffer(once, "<u2")
            bits[1, once[bits[0, once]]] = True
            bits[0, once] = True
            bits[:, np.frombuffer(more, "<u2")] = True
            seen[i] = np.packbits(bits, axis=1, bitorder="little")
    full = [(i, x[1].tobytes()) for i, x in seen.items() if x[1].any()]
    for at in range(0, len(full), 256):
        ids, bitmaps = zip(*full[at : at + 256], strict=True)
        yield pa.RecordBatch.from_pydict({"block": pa.array(ids, pa.int64()), "full": pa.array(bitmaps, pa.binary())})


def sketch_bits(n_bytes: int, least: int = 16) -> int:
    """Cells in a row of the sketch: four to eight for each anchor that the bytes will have, an anchor being about 42 bytes.

    An anchor that stands once passes with the chance (1 - exp(-1 / 4))**ROWS = 1.1 % at most, at any size.
    """
    return int(max(least, np.ceil(np.log2(max(1, n_bytes / 42 * 4)))))


def _keyed(bits: int, side: int, window: int, anchor: int):
    """The keys of documents (doc, text), with their documents, by unit of the sketch (2**side stretches): as many rows as a group of FLUSH keys fills units."""

    def send(keys: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit = places(keys, bits) >> side
        order = np.lexsort((keys, unit))
        unit, keys, docs = unit[order], keys[order], docs[order]
        rows = [(int(unit[a]), keys[a:b].tobytes(), docs[a:b].tobytes()) for a, b in _stretches(unit)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["unit", "keys", "docs"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, size = [], [], 0
        for b in batches:
            for doc, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                hashes = word_hashes(words(t))
                if len(keys := np.unique(anchors(hashes, window, anchor))):
                    held.append(np.concatenate([keys, whole_key(hashes)]))
                    of.append(np.full(len(keys) + 1, doc, np.int64))
                    size += len(keys) + 1
                if size >= FLUSH:
                    yield from send(np.concatenate(held), np.concatenate(of))
                    held, of, size = [], [], 0
        if held:
            yield from send(np.concatenate(held), np.concatenate(of))

    return part


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for unit, keys, docs in zip(*(b.column(c).to_pylist() for c in ("unit", "keys", "docs")), strict=True):
        yield unit, np.frombuffer(keys, U), np.frombuffer(docs, np.int64)


def _fill(bits: int):
    """The sketch of rows of _keyed(): a partition's cells."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _send(np.concatenate([keys for _, keys, _ in _unpacked(b)]), bits)

    return part


def _alone(keys: np.ndarray) -> np.ndarray:
    """Which of the sorted keys stand once."""
    edge = np.concatenate([[True], keys[1:] != keys[:-1], [True]])
    return edge[:-1] & edge[1:]


def _answer(docs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys.view(np.int64))], ["doc", "key"])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that a group itself shows to be repeated: no need to ask, however many documents have them."""
    for b in batches:
        for _, keys, docs in _unpacked(b):
            if not (one := _alone(keys)).all():
                yield _answer(docs[~one], keys[~one])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The others, of which a group has each once: no unit gets more of a key than there are groups."""
    for b in batches:
        rows = [(unit, keys[one].tobytes(), docs[one].tobytes()) for unit, keys, docs in _unpacked(b) if (one := _alone(keys)).any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["unit", "keys", "docs"])


def _ask(bits: int):
    """A unit's blocks come first, then the keys that ask: those whose cells all count two or more."""
    size = (1 << BLOCK_BITS) // 8

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, {}
        empty = np.zeros(size, np.uint8)
        for b in batches:
            for unit, block, full, keys, docs in zip(*(b.column(c).to_pylist() for c in ("unit", "block", "full", "keys", "docs")), strict=True):
                if unit != now:
                    now, blocks = unit, {}
                if full is not None:
                    blocks[block] = np.frombuffer(full, np.uint8)
                    continue
                keys, docs = np.frombuffer(keys, U), np.frombuffer(docs, np.int64)
                at = cells(keys, bits)
                good, order = np.zeros(len(at), bool), np.argsort(at >> BLOCK_BITS, kind="stable")
                for x, y in _stretches((at >> BLOCK_BITS)[order]):
                    own = order[x:y]
                    low = at[own] & ((1 << BLOCK_BITS) - 1)
                    good[own] = (blocks.get(int(at[own[0]] >> BLOCK_BITS), empty)[low >> 3] >> (low & 7).astype(np.uint8)) & 1
                good = good.reshape(ROWS, -1).all(0)
                if good.any():
                    yield _answer(docs[good], keys[good])

    return part


def repeated_keys(docs: DataFrame, bits: int, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, repeated: which keys of each of docs (doc, text) the sketch estimates to be repeated, by its merged cells."""
    side = max(0, bits - BLOCK_BITS - UNIT_BITS)
    keyed = staged(docs.transform(arrow, _keyed(bits, side, window, anchor), "unit long, keys binary, docs binary"), "keyed")
    cells_of = keyed.transform(arrow, _fill(bits), "block long, once binary, more binary")
    blocks = cells_of.repartition("block").transform(arrow, _merge, "block long, full binary")
    unit = F.shiftright((F.col("block") / ROWS).cast("long"), side)
    none = F.lit(None).cast("binary")
    blocks = blocks.select(unit.alias("unit"), "block", "full", none.alias("keys"), none.alias("docs"))
    asked = keyed.transform(arrow, _asked, "unit long, keys binary, docs binary").select("unit", F.lit(-1).cast("long").alias("block"), none.alias("full"), "keys", "docs")
    asked = blocks.unionAll(asked).repartition("unit").sortWithinPartitions("unit", F.col("full").isNull()).transform(arrow, _ask(bits), "doc long, key long")
    # As many keys as a document has words, at most. A table of its own, for who joins it with a doc that has many rows.
    known = keyed.transform(arrow, _known, "doc long, key long")
    return staged(known.unionAll(asked).groupBy("doc").agg(F.collect_set("key").alias("repeated")), "repeated-keys")


_FOUND = "h long, g int, pos int, doc long, n_words long, sha binary, copy binary, text string"


def _windows(key: int, hashes: np.ndarray, pos: np.ndarray, window: int) -> pa.RecordBatch:
    """h and g, 96 bits that name a window's words, with its place."""
    h, g = runs(hashes, window)[pos].view(np.int64), (runs(hashes, window, 1)[pos] >> U(32)).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(pos.astype(np.int32)), pa.array(np.full(len(pos), key, np.int64))], ["h", "g", "pos", "doc"])


def second_pass(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """From doc, text and repeated (repeated_keys()) rows of two kinds: for every document doc, n_words, sha (of all its words), copy (its digest, if it is estimated repeated) and
    text (only if it may lose words); and h, g, pos, doc of the windows estimated repeated in documents that aren't."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, windows, size = [], [], 0
            for key, t, own in zip(*(b.column(c).to_pylist() for c in ("doc", "text", "repeated")), strict=True):
                repeated = np.array(own or [], np.int64).view(U)
                found = words(t)
                hashes = word_hashes(found)
                keys = anchors(hashes, window, anchor) if key is not None else np.zeros(0, U)
                copy = digest(hashes) if len(keys) and np.isin(whole_key(hashes), repeated).all() else None
                pos = np.flatnonzero(np.isin(keys, repeated)) if len(keys) and not copy else np.zeros(0, np.int64)
                rows.append((key, len(found), hashlib.sha256(b" ".join(found)).digest(), copy, t if copy or len(pos) else None))
                if len(pos):
                    windows.append(_windows(key, hashes, pos, window))
                size += 1 + len(pos)
                if size > FLUSH:
                    yield from _both(rows, windows)
                    rows, windows, size = [], [], 0
            yield from _both(rows, windows)

    return docs.transform(arrow, part, _FOUND)


_NAMES = ["h", "g", "pos", "doc", "n_words", "sha", "copy", "text"]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]


def _both(rows: list[tuple], windows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if rows:
        values = [pa.nulls(len(rows), k) for k in _KINDS[:3]] + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS[3:], strict=True)]
        yield pa.RecordBatch.from_arrays(values, _NAMES)
    if windows:
        values = [pa.concat_arrays([w.column(c) for w in windows]) for c in _NAMES[:4]]
        yield pa.RecordBatch.from_arrays(values + [pa.nulls(len(values[0]), k) for k in _KINDS[4:]], _NAMES)


def _first_copies(window: int):
    """All windows of documents."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                hashes = word_hashes(words(t))
                yield _windows(key, hashes, np.arange(max(0, len(hashes) - window + 1)), window)

    return part


def covered(found: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """From the second pass: doc of the later copies; and doc, starts: where a document's windows start that also start in one with a smaller key."""
    copies = found.filter("copy is not null")
    # A group of copies may hold any share of the rows: its one first document meets many rows, which Spark splits as a skewed
    # join. It can do so only where both sides are dealt out for the join, so the firsts are a table of their own.
    firsts = staged(copies.groupBy("copy").agg(F.min("doc").alias("first")), "firsts")
    ranked = staged(copies.select("copy", "doc").join(firsts.hint("merge"), "copy").select("doc", (F.col("doc") > F.col("first")).alias("later")).distinct(), "copies")
    texts = copies.select("doc", "text").join(ranked.filter("not later").select("doc"), "doc", "left_semi")
    more = staged(texts.transform(arrow, _first_copies(window), "h long, g int, pos int, doc long"), "copies-windows")
    windows = found.filter("h is not null").select("h", "g", "pos", "doc").unionAll(more)
    # Likewise a window that stands in any share of the documents.
    first = staged(windows.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("h", "g", "first"), "first-windows")
    after = windows.join(first.hint("merge"), ["h", "g"]).filter("doc > first")
    # As many starts as a document has words, at most.
    return ranked.filter("later").select("doc"), after.groupBy("doc").agg(F.collect_set("pos").alias("starts"))


def strip(found: list[bytes], starts: np.ndarray, window: int = WINDOW) -> list[bytes]:
    """The words that no window covers."""
    edge = np.zeros(len(found) + 1, np.int64)
    starts = starts[starts + window <= len(found)]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return [w for w, gone in zip(found, np.cumsum(edge[:-1]).tolist(), strict=True) if not gone]


def _found(docs: DataFrame, text: str, key: str, window: int, anchor: int, bits: int | None) -> DataFrame:
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    bits = bits or sketch_bits(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    some = own.filter("doc is not null and text is not null")
    # Rows without a key or text, which may be any share, aren't dealt out by it.
    mark = staged_so_far()
    told = some.join(repeated_keys(some, bits, window, anchor).hint("merge"), "doc", "left")
    rest = own.filter("doc is null or text is null").withColumn("repeated", F.lit(None).cast("array<long>"))
    found = staged(second_pass(told.unionAll(rest), window, anchor), "second-pass")
    drop_staged(docs.sparkSession, mark, keep=(found,))
    return found


def drop_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, bits: int | None = None) -> DataFrame:
    """key and text of every row, without the words that dedup_substrings() counts; texts that lose none are unchanged."""
    later, starts = covered(_found(docs, text, key, window, anchor, bits), window)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).join(starts, "doc", "left").join(later.withColumn("later", F.lit(True)), "doc", "left")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("text", "starts", "later")), strict=True)
            texts = ["" if copy else b" ".join(strip(words(t), np.array(at, np.int64), window)).decode() if at else t for t, at, copy in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    return rows.transform(arrow, part, "doc long, text string").toDF(key, text)


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, bits: int | None = None) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 for every row; drop_substrings() gives the texts.

    - Words are runs of anything but ASCII white space, unchanged; what is left is joined by single spaces.
    - A word goes if a window of window words that covers it also starts in a document with a smaller key. Windows are judged on
      the input; repeats inside one document stay; texts shorter than a window stay whole.
    - A null or empty text has no words. A row with a null key neither loses words nor makes others lose any.
    - Rows that share a key are taken for copies of one row, and get the same result. Other columns aren't read.
    """
    found = _found(docs, text, key, window, anchor, bits)
    later, starts = covered(found, window)
    rows = found.filter("n_words is not null").select("doc", "n_words", "sha", "text")
    rows = rows.join(starts, "doc", "left").join(later.withColumn("later", F.lit(True)), "doc", "left")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, sha = [], []
            for t, at, n, whole, copy in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "n_words", "sha", "later")), strict=True):
                left = [] if copy else strip(words(t), np.array(at, np.int64), window) if at else None
                gone.append(0 if left is None else n - len(left))
                sha.append(whole.hex() if left is None else hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("n_words"), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc", "n_words", "n_removed", "kept_sha256"])

    return rows.transform(arrow, part, "doc long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("doc", key)
