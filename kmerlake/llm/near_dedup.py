"""Near-duplicate classes by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its least and its greatest, so a signature
takes half the hash evaluations. Four values make a band. Documents with equal shingle sets are one class first;
classes that share a band are compared by their signatures, in groups of bounded size, and a pair that may be
similar enough is decided on the full shingle sets.

Only classes of different components need comparing. A first round links each class with its likeliest neighbour,
which joins nearly all there is to join. A last round then takes all classes that share a band with
a likely partner in another component, gathers them into families, and decides on the full sets within each family,
so that no link between components that the bands show is left out. A family is dealt into parts of GROUP, and everything
in it but its largest component meets all of it part by part: with m classes, of which l are leftovers, about 2 m l / GROUP
rows with their sets are sent. That is a quadratic term where a large family doesn't link, as with shared boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, staged
from .shingles import U, mix, runs, word_hashes, words

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
SIMILAR = (75, 100)
PERMUTATIONS, BAND = 64, 4
#: Sets of up to so many shingles have as many bands again: of few shingles a permutation's least and greatest value depend on each other, so a
#: band of similar sets differs more often.
FEW = 32
#: A pair whose signatures agree on fewer values isn't checked: at similarity 0.75 that is over 4 (mostly over 6) standard deviations off.
AGREE = PERMUTATIONS
#: Classes that are compared at once.
GROUP = 512
_ODD = (np.random.default_rng(11).integers(0, 1 << 63, 2 * PERMUTATIONS, dtype=np.uint64) << U(1)) | U(1)
_MIX = (np.random.default_rng(12).integers(0, 1 << 63, BAND, dtype=np.uint64) << U(1)) | U(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles; with fewer words of all its words; empty without words."""
    hashes = word_hashes(words(text, lower=True))
    if 0 < len(hashes) < SHINGLE:
        return mix(runs(hashes, len(hashes)) + U(len(hashes)))
    return np.unique(runs(hashes, SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, in turn; for FEW shingles or less under twice as many permutations."""
    odd = _ODD if len(shingles) <= FEW else _ODD[:PERMUTATIONS]
    least, most = np.full(len(odd), ~U(0)), np.zeros(len(odd), U)
    for i in range(0, len(shingles), 4096):
        p = shingles[i : i + 4096, None] * odd
        least, most = np.minimum(least, p.min(0)), np.maximum(most, p.max(0))
    return mix(np.stack([least, most], 1).reshape(-1))


def bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(-1, BAND)
    return mix((rows * _MIX).sum(1, dtype=U) + np.arange(len(rows), dtype=U))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, keys, band, short = [], [], [], []
        for t in b.column("text").to_pylist():
            shingles = shingle_set(t)
            n.append(len(shingles))
            values = signature(shingles) if len(shingles) else None
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            band.append(bands(values).view(np.int64) if len(shingles) else None)
            short.append((values[: 2 * PERMUTATIONS] >> U(56)).astype(np.uint8).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc", "n", "set_key", "bands", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingle_set(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            keep.append(_similar(np.frombuffer(x, U), np.frombuffer(y, U)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.Table]]:
    """The runs of rows with equal keys, in pieces as they come: (a new run begins, rows)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.flatnonzero(np.any([np.concatenate([[True], c[1:] != c[:-1]]) for c in cols], axis=0))
        for i, j in zip(edge, [*edge[1:], b.num_rows], strict=True):
            key = tuple(c[i] for c in cols)
            yield key != last, b.slice(i, j - i)
            last = key


def _unpack(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, comps = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("id", "comp"))
    return ids, comps, np.frombuffer(b"".join(s for r in rows for s in r.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)


def _agreement(one: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    return (sigs == one).sum(1)


def _pairs(a: list, b: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(n).astype(np.int32))], ["a", "b", "n"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a group the class of another component that agrees most with it."""

    def of(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, comps, sigs = _unpack(rows)
        if len(ids) < 2 or (comps == comps[0]).all():
            return
        at, n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for i in range(len(ids)):
            agree = np.where(comps == comps[i], -1, _agreement(sigs[i], sigs))
            at[i] = agree.argmax()
            n[i] = agree[at[i]]
        good = n >= AGREE
        if good.any():
            yield _pairs([ids[good]], [ids[at[good]]], [n[good]])

    yield from _by_group(batches, of)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties (a, b) between the classes of a group that have a likely partner in another component; who is tied has all likely partners in its family."""

    def of(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, comps, sigs = _unpack(rows)
        if len(ids) < 2 or (comps == comps[0]).all():
            return
        order = np.argsort(ids)  # a family's smallest id stands for it, which other bands will mostly choose, too
        ids, comps, sigs = ids[order], comps[order], sigs[order]
        family, tied = np.arange(len(ids)), np.zeros(len(ids), bool)
        for i in range(len(ids)):
            hit = (comps != comps[i]) & (_agreement(sigs[i], sigs) >= AGREE)
            if hit.any():
                hit[i] = True
                tied |= hit
                own = np.unique(family[hit])
                family[np.isin(family, own)] = own[0]
        if tied.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[family[tied]])], ["a", "b"])

    yield from _by_group(batches, of)


def _by_group(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for new, rows in _groups(batches, ["band", "part"]):
        if new and held:
            yield from of(held)
            held = []
        held.append(rows)
    if held:
        yield from of(held)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes of a group against its residents: links that join components, as many as there are to join. Residents come first.

    Pairs of components that a link of the group has joined aren't compared any more.
    """
    home: list[pa.RecordBatch] = []
    known = None
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := joined.get(c, c)) != c:
            joined[c] = c = joined.get(up, up)
        return c

    for new, rows in _groups(batches, ["family", "part", "against"]):
        if new:
            home, known = [], None
            joined.clear()
        n = int((rows.column("probe").to_numpy() == 0).sum())
        if n:
            home.append(rows.slice(0, n))
        probes = rows.slice(n)
        if not probes.num_rows or not home:
            continue
        if known is None:
            known = *_unpack(home), [s for r in home for s in r.column("shingles").to_pylist()]
        ids, comps, sigs, sets = known
        a, b = [], []
        for i, c, s, own in zip(*_unpack([probes]), probes.column("shingles").to_pylist(), strict=True):
            agree = np.where(comps == c, 0, _agreement(s, sigs))
            near = np.flatnonzero(agree >= AGREE)
            own = np.frombuffer(own, U)
            for j in near[np.argsort(-agree[near], kind="stable")].tolist():
                if (x := root(int(c))) != (y := root(int(comps[j]))) and _similar(own, np.frombuffer(sets[j], U)):
                    joined[x] = y
                    a.append(i)
                    b.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of a link (a, b): comp is the smallest id that can be reached.

    Each step ties all neighbours of an id to the smallest of them, first the greater ones, then the smaller ones, until
    every id has one tie, and none leads to an id that has one itself. Steps are sums by key and joins; what a step leaves
    is a written table.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("low")).filter("n > 1 or (n = 1 and low = 0)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("v")), "least")
        small = large.join(least.withColumnRenamed("v", "m"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionAll(least).distinct(), "edges")


class NearDuplicates:
    """The near-duplicate classes of documents: members (doc, n, rep) and links between class representatives."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", group: int = GROUP, rounds: int = 1):
        self.group, self.text = group, docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
        sketches = staged(self.text.filter("doc is not null").transform(arrow, _sketch, "doc long, n long, set_key binary, bands array<long>, sig binary"), "sketches")
        # One row per distinct set, whatever the number of its copies.
        classes = sketches.filter("set_key is not null").groupBy("set_key").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        classes = staged(classes, "classes")
        self.members = staged(sketches.select("doc", "n", "set_key").join(classes.select("set_key", "rep"), "set_key", "left").select("doc", "n", "rep"), "members")
        filled = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
        # A band may be that of any share of the classes. Spark splits a skewed join only where both sides are dealt out for it, so
        # sums by a key that meet the key's rows again are tables of their own, here and below.
        shared = staged(filled.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared-bands")
        self.buckets = staged(filled.join(shared, "band"), "buckets")
        ids = self.buckets.select("id").distinct()
        self.sigs = staged(classes.select(F.col("rep").alias("id"), "sig").join(ids, "id", "left_semi"), "signatures")
        rows = self.text.withColumnRenamed("doc", "id").join(ids, "id", "left_semi").dropDuplicates(["id"]).select("id", "text")
        self.sets = staged(rows.transform(arrow, _sets, "id long, shingles binary"), "sets")
        self.comps = self.sigs.select("id", F.col("id").alias("comp"))
        for step in range(rounds + 1):
            links = staged(self._confirmed(self._likely(step == 0)) if step < rounds else self._rest(), "links")
            if not links.isEmpty():
                # Between components, of which there are fewer each time.
                for end in ("a", "b"):
                    links = links.join(self.comps.select(F.col("id").alias(end), F.col("comp").alias("_comp")), end).withColumn(end, F.col("_comp")).drop("_comp")
                linked = components(links).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
                self.comps = staged(self.comps.join(linked, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "components")

    def _open(self, first: bool = False) -> DataFrame:
        """band, m, low, id, comp, sig of the buckets that still hold more than one component."""
        if first:  # every bucket does
            return self.buckets.withColumn("comp", F.col("id")).join(self.sigs, "id").withColumn("low", F.lit(None).cast("long")).select("band", "m", "low", "id", "comp", "sig")
        rows = self.buckets.join(self.comps, "id")
        several = staged(rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("low")).filter("lo < hi").select("band", "low"), "open-bands")
        return rows.join(several, "band").join(self.sigs, "id").select("band", "m", "low", "id", "comp", "sig")

    def _parts(self, rows: DataFrame) -> DataFrame:
        """A large bucket is dealt into parts, anew for each band, so that parts meet in other bands."""
        part = F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("m") / self.group)).cast("int")
        return rows.select("band", part.alias("part"), "id", "comp", "sig").repartition("band", "part").sortWithinPartitions("band", "part")

    def _likely(self, first: bool) -> DataFrame:
        """Pairs (a, b): each class and its best neighbour over all its buckets."""
        near = self._parts(self._open(first)).transform(arrow, _nearest, "a long, b long, n int")
        best = near.groupBy("a").agg(F.max(F.struct("n", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _rest(self) -> DataFrame:
        """Links (a, b) that join all components with a link between classes that share a band.

        All of a bucket that is dealt into parts is one family. Everything in a family but its largest component goes past the
        whole family, part by part on either side, so that no task gets more than a part of each.
        """
        rows = staged(self._open(), "open-rows")
        ties = self._parts(rows).transform(arrow, _families, "a long, b long").unionAll(rows.filter(F.col("m") > self.group).select(F.col("id").alias("a"), F.col("low").alias("b")))
        rows = components(ties).withColumnRenamed("comp", "family").join(self.comps, "id")
        counts = rows.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("family").agg(F.sum("k").alias("m"), F.max(F.struct("k", "comp")).alias("x"))
        dealt = lambda n: F.ceil(n / self.group).cast("int")
        counts = counts.filter("m > x.k").select("family", dealt(F.col("m")).alias("parts"), dealt(F.col("m") - F.col("x.k")).alias("sides"), F.col("x.comp").alias("main"))
        rows = rows.join(staged(counts, "families"), "family").join(self.sigs, "id").join(self.sets, "id")
        what = ["id", "comp", "sig", "shingles"]
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n, salt: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.col(n)).cast("int")
        home = rows.select("family", own("parts", 1).alias("part"), each("sides").alias("against"), F.lit(0).alias("probe"), *what)
        probes = rows.filter("comp <> main").select("family", each("parts").alias("part"), own("sides", 2).alias("against"), F.lit(1).alias("probe"), *what)
        by = ["family", "part", "against"]
        return home.unionAll(probes).repartition(*by).sortWithinPartitions(*by, "probe").transform(arrow, _across, "a long, b long")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough. An id in many pairs is a skewed join, which Spark splits."""
        left = self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        right = self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").transform(arrow, _confirm, "a long, b long")

    def labels(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept; see near_duplicates()."""
        out = self.members.join(self.comps.filter("comp <> id").withColumnRenamed("id", "rep"), "rep", "left")
        return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every document with a key.

    - A document's set: distinct shingles of 5 words, lower-cased in A-Z; of all words if there are fewer; empty for a null text or
      one without words, which links with nothing and is its own component.
    - Documents are linked if 100 * intersection >= 75 * union, decided on the full sets; component_id is the smallest key that
      links reach; kept: the document is that one.
    - Repeated rows are one document and get the same label each. Rows without a key have none. Other columns aren't read.
    """
    return NearDuplicates(docs, text, key, group).labels()


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that aren't kept; all columns stay.

    Rows without a key, and the further texts of a key that has several, are documents with made-up keys behind all others (which
    must be under 2^62 then). Rows with the same key and text stay or go together.
    """
    names = docs.columns
    number, content = F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), number.alias("doc"), F.col(text).alias("text"), content.alias("content"))
    several = rows.filter("doc is not null").groupBy("doc").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low < high")
    several = staged(several.select(F.col("doc").alias("odd"), "low"), "keys-of-several-texts")
    plain = rows.filter("doc is not null")
    further = plain.join(several, (F.col("doc") == F.col("odd")) & (F.col("content") != F.col("low")), "left_semi")
    odd = staged(rows.filter("doc is null").withColumn("made", F.xxhash64(F.monotonically_increasing_id())).unionAll(further.withColumn("made", F.lit(None).cast("long"))), "odd-rows")
    if not odd.isEmpty():
        plain = plain.join(several, (F.col("doc") == F.col("odd")) & (F.col("content") != F.col("low")), "left_anti")
        # Behind all keys; 61 bits of a hash of the row, or of key and text.
        made = F.lit(1 << 62) + F.shiftrightunsigned(F.coalesce("made", F.xxhash64("doc", "content")), 3)
        plain = plain.unionAll(odd.select("row", made.alias("doc"), "text", "content"))
    gone = near_duplicates(plain, "text", "doc").filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return plain.join(gone, F.col("doc") == F.col("gone"), "left_anti").select(*[F.col("row").getField(c).alias(c) for c in names])
