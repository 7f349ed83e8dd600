"""SentencePiece encoding by sampling, and lossless decoding.

A text's lattice has an edge for every piece that spells a part of it, with weight exp(theta * score); a character
that no piece spells has one edge of byte pieces. Forward filtering sums the weights of all ways to each place,
backward sampling draws from the end one edge after another, so each segmentation comes with its probability.
Draws follow from the row's key, a place's number and the step, so reruns and other machines draw the same.

No piece reaches across the start of a word or across a character that is only ever a piece of its own, so the
lattice falls into units there. The distinct units of many texts are filtered at once, and all their units sampled
at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow
from .shingles import U, mix
from .token_count import vocabulary

GAP = "▁"
#: Stands for GAP where the text itself has one: no text can hold it, and it is spelt in bytes, so decoding tells the two apart.
OWN_GAP = "\udfff"
THETA, SEED = 2e-4, 6
UNITS, LONG = 25_000, 1 << 20
_STEP, _PLACE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


class Lattice:
    """The filtered lattices of some units. Nodes are the places in units; a node's edges lead back from it and lie together."""

    def __init__(self, pieces: Pieces, units: list[str]):
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), size)
        stop = np.cumsum(size)[unit]
        self.first_node = np.cumsum(size) - size + np.arange(len(units))
        self.last_node = self.first_node + size
        node = np.arange(len(points)) + unit  # before each character
        # Edges of one character: its piece, or its bytes. Their ids lie in one list, which begins with all pieces.
        one = pieces.single[points]
        ids, n = one.copy(), np.ones(len(one), np.int32)
        unspelt = np.flatnonzero(one < 0)
        odd, which = np.unique(points[unspelt], return_inverse=True)
        spelt = [pieces.spelt(chr(c)) for c in odd]
        lengths = np.array([*map(len, spelt)], np.int32)
        ids[unspelt] = (len(pieces.spells) + np.cumsum(lengths) - lengths)[which]
        n[unspelt] = lengths[which]
        self.ids = np.concatenate([np.arange(len(pieces.spells)), *spelt]).astype(np.int32)
        starts, lens, ids, n, scores = [node], [np.ones(len(node), np.int32)], [ids], [n], [np.where(one < 0, 0.0, pieces.score[one])]
        # Longer ones: all places go down the pieces' tree together.
        tree, width = pieces.tree.reshape(-1), pieces.tree.shape[1]
        kind = pieces.kind[points].astype(np.int32)
        state = tree[kind]
        live = np.flatnonzero(state)
        state, room = state[live], (stop - np.arange(len(points)))[live]
        for length in range(2, pieces.longest + 1):
            inside = room >= length
            live, state, room = live[inside], state[inside], room[inside]
            state = tree[state.astype(np.int32) * width + kind[live + (length - 1)]]
            inside = state > 0
            live, state, room = live[inside], state[inside], room[inside]
            found = pieces.ends[state]
            hit = found >= 0
            found = found[hit]
            starts.append(node[live[hit]])
            lens.append(np.full(len(found), length, np.int32))
            ids.append(found)
            n.append(np.ones(len(found), np.int32))
            scores.append(pieces.score[found])
        start = np.concatenate(starts)
        end = start + np.concatenate(lens)
        # By node: a merge of runs that are in order already.
        order = np.argsort(end, kind="stable")
        #: By edge: the node it comes from; where its ids start, and how many.
        self.back, self.ids_at, self.n = start[order], np.concatenate(ids)[order], np.concatenate(n)[order]
        end, weight = end[order], pieces.theta * np.concatenate(scores)[order]
        # Forward filtering, one distance from the units' starts after the other.
        place = np.arange(len(points) + len(units)) - np.repeat(self.first_node, size + 1)
        far = place[end]
        order = np.argsort(far.astype(np.uint16) if size.max() < 1 << 16 else far, kind="stable")
        total, share = np.zeros(len(place)), np.empty(len(end))
        levels = np.cumsum(np.bincount(far))
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            if a == b:
                continue
            at = order[a:b]
            to = end[at]
            w = total[self.back[at]] + weight[at]
            first = np.empty(len(to), bool)
            first[0] = True
            np.not_equal(to[1:], to[:-1], out=first[1:])
            head = np.flatnonzero(first)
            own = np.cumsum(first) - 1
            top = np.maximum.reduceat(w, head)
            w = np.exp(w - top[own])
            whole = np.add.reduceat(w, head)
            total[to[head]] = top + np.log(whole)
            run = np.cumsum(w)
            run -= (run[head] - w[head])[own]
            run /= whole[own]
            np.minimum(run, 1.0, out=run)
            run[head[1:] - 1] = 1.0
            run[-1] = 1.0
            share[at] = run
        #: By edge: its node plus the shares of the node's edges up to it.
        self.reach = end + share

    def draw(self, number: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of units, given by number: all their ids one after another, and how many each has."""
        at, first = self.last_node[number], self.first_node[number]
        live, owner, edges = np.argsort(number, kind="stable"), [], []  # in the order of the edges, for the sake of caches
        while len(live):
            u = (mix(seeds[live] + np.full(1, len(edges), U) * _STEP) >> U(11)) * 2.0**-53
            edge = np.searchsorted(self.reach, at[live] + u, side="right")
            owner.append(live)
            edges.append(edge)
            at[live] = self.back[edge]
            live = live[at[live] > first[live]]
        step = np.repeat(np.arange(len(edges)), [len(x) for x in edges])
        owner, edges = np.concatenate(owner), np.concatenate(edges)
        # From the end back: the last step drawn comes first.
        count = np.bincount(owner, minlength=len(number))
        to = (np.cumsum(count)[owner] - 1) - step
        ordered = np.empty_like(edges)
        ordered[to] = edges
        n = self.n[ordered]
        flat = self.ids[np.repeat(self.ids_at[ordered] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return flat, np.add.reduceat(n, np.cumsum(count) - count)


class Pieces:
    """The pieces of a SentencePiece model file with a gap before the text, no other rewriting, and byte pieces."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("a  b ", out_type=str)[0][:1] != GAP or model.decode(model.encode("a  b ")) != "a  b ":
            raise ValueError("a model with a gap before the text and no rewriting is needed")
        size, self.theta = model.get_piece_size(), theta
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("a model with byte pieces is needed")
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(GAP in names[i].lstrip(GAP) for i in plain):
            raise ValueError("pieces that reach across a gap aren't supported")
        self.score = np.array([model.get_score(i) for i in range(size)])
        #: What a piece decodes to.
        self.spells = [b""] * size
        for b, i in self.byte_ids.items():
            self.spells[i] = bytes([b])
        self.single = np.full(0x110000, -1, np.int32)
        many = sorted({c for i in plain if len(names[i]) > 1 for c in names[i]})
        self.kind = np.zeros(0x110000, np.uint8 if len(many) < 256 else np.uint16)
        self.kind[[ord(c) for c in many]] = np.arange(1, len(many) + 1)
        nodes, last = [{}], {}
        self.longest = max(len(names[i]) for i in plain)
        for i in plain:
            self.spells[i] = names[i].replace(GAP, " ").encode()
            if len(names[i]) == 1:
                self.single[ord(names[i])] = i
                continue
            at = 0
            for c in names[i]:
                if (k := int(self.kind[ord(c)])) not in nodes[at]:
                    nodes[at][k] = len(nodes)
                    nodes.append({})
                at = nodes[at][k]
            last[at] = i
        #: The tree of longer pieces: next node by node and kind of character (0: none), and the piece that ends at a node.
        self.tree = np.zeros((len(nodes), len(many) + 1), np.uint16 if len(nodes) < 1 << 16 else np.int32)
        for at, down in enumerate(nodes):
            self.tree[at, list(down)] = list(down.values())
        self.ends = np.full(len(nodes), -1, np.int32)
        self.ends[list(last)] = list(last.values())
        own = "".join(re.escape(c) for c in many if c != GAP)
        self.unit = re.compile(f"{GAP}+[{own}]*|[{own}]+|.", re.DOTALL)

    def spelt(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (GAP if char == OWN_GAP else char).encode()]

    def split(self, text: str) -> Iterator[list[str]]:
        """A text's units, a bounded number at a time."""
        marked = GAP + text.replace(GAP, OWN_GAP).replace(" ", GAP)
        if len(marked) <= LONG:
            yield self.unit.findall(marked)
            return
        found = (m[0] for m in self.unit.finditer(marked))
        while part := list(islice(found, UNITS)):
            yield part

    def encode(self, texts: list[str | None], keys: list) -> list[np.ndarray | None]:
        """Piece ids of each text, drawn by its key. None for None; an empty text has no pieces."""
        out: list[list[np.ndarray] | None] = [None if t is None else [] for t in texts]
        held, size = [], 0
        for i, (t, key) in enumerate(zip(texts, keys, strict=True)):
            if not t:
                continue
            seed, at = np.full(1, xxhash.xxh3_64_intdigest(repr(key).encode(), seed=SEED), U), 0
            for part in self.split(t):
                held.append((i, part, mix(seed + np.arange(at, at + len(part), dtype=U) * _PLACE)))
                at += len(part)
                size += len(part)
                if size >= UNITS:
                    self._draw(held, out)
                    held, size = [], 0
        self._draw(held, out)
        return [None if x is None else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def _draw(self, held: list[tuple], out: list) -> None:
        if not held:
            return
        units = list(chain.from_iterable(part for _, part, _ in held))
        known = {u: i for i, u in enumerate(dict.fromkeys(units))}
        number = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        flat, n = Lattice(self, list(known)).draw(number, np.concatenate([x for _, _, x in held]))
        stops = np.cumsum(n)[np.cumsum([len(part) for _, part, _ in held]) - 1]
        for (i, _, _), a, b in zip(held, [0, *stops[:-1]], stops, strict=True):
            out[i].append(flat[a:b])

    def decode(self, ids: np.ndarray | None) -> str | None:
        """The text of piece ids, exactly as it was encoded."""
        if ids is None:
            return None
        raw = b"".join(map(self.spells.__getitem__, ids.tolist()))
        return (raw[1:] if len(ids) else raw).decode()


_held: dict[tuple[str, float], Pieces] = {}


def _pieces(name: str, theta: float) -> Pieces:
    if (name, theta) not in _held:
        _held[name, theta] = Pieces(name if name.startswith("/") else vocabulary(name), theta)
    return _held[name, theta]


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", theta: float = THETA, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """key, n_pieces, ids_sha256, lossless (and ids, if with_ids) for every row: a sampled segmentation of its whole text, decoded again.

    name: a file of the installed vocabularies, or an absolute path that every machine has.
    - ids_sha256 is the digest of the ids as 32-bit little-endian numbers; lossless tells that decoding gave the text back.
    - A null text has null ids, 0 pieces, the digest of nothing, and is lossless; an empty one has no ids.
    - The key seeds the draws: equal rows get equal ids, equal texts under other keys mostly others. Other columns aren't read.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(name, theta)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):  # bounds the ids that are held
                b = whole.slice(i, 1000)
                texts = b.column("text").to_pylist()
                ids = own.encode(texts, b.column("key").to_pylist())
                none = np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("key"),
                        pa.array([0 if x is None else len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256((none if x is None else x).astype("<i4").tobytes()).hexdigest() for x in ids]),
                        pa.array([own.decode(x) == t for x, t in zip(ids, texts, strict=True)]),
                        pa.array(ids if with_ids else [None] * len(ids), pa.list_(pa.int32())),
                    ],
                    ["key", "n_pieces", "ids_sha256", "lossless", "ids"],
                )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).transform(arrow, part, f"key {kind}, n_pieces long, ids_sha256 string, lossless boolean, ids array<int>")
    return (out if with_ids else out.drop("ids")).withColumnRenamed("key", key)


def decode(rows: DataFrame, name: str = "piece_bpe_32k.model", ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and text, from piece ids; null ids give a null text."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(name, THETA)
        for b in batches:
            texts = [own.decode(None if x is None else np.array(x, np.int32)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).transform(arrow, part, f"key {kind}, text string").withColumnRenamed("key", key)
