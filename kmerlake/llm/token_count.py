"""Token counts by a compiled finite-state tokenizer (byte-level BPE).

Two deterministic transducers, the second fed by the first:
- Splitter. Characters, with a look at the next two, become symbols; its few states tell where a piece begins.
  Text is cut into chunks; each chunk's map from entry state to exit state is made for all chunks at once,
  a parallel prefix scan composes the maps, and a second sweep from the now known entry states emits.
- Merger. Reads a piece's bytes. A state is what later merges can depend on: the longest text end that some
  token may go on from, with the last token and the token count at each place in it. A transition carries the
  number of tokens (also a negative one) by which the count of what was read changes. The splitter's scan tells where
  pieces begin, so every piece starts from the same state: all distinct pieces of a group of texts run side by side, a byte
  at a time, over arrays of transitions. States are compiled when first met and kept while they fit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

LETTER, NUMBER, OTHER, SPACE, SPACE_END, WHITE, WHITE_END, SHORT, LONG, RESET = range(10)
#: Splitter states: at the start; in letters, numbers, others; after a space, other white space; in a contraction of one or two letters; behind one.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_SHORT, S_LONG, S_LONG2, S_DONE = range(10)
CHUNK, GROUP, KEEP = 128, 1 << 21, 600_000
#: Pieces of up to SHORT_PIECE bytes are told apart by their bytes and length in 16 bytes.
SHORT_PIECE = 15
#: Fixed pattern of the splitter that is compiled here; a file with another one is refused.
CONTRACTIONS = {"short": "stmd", "long": ("re", "ve", "ll")}


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a piece begins here', by symbol and state."""
    to, cut = np.zeros((10, 10), np.uint8), np.ones((10, 10), np.uint8)
    to[LETTER], to[NUMBER], to[OTHER], to[SHORT], to[LONG] = S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG
    to[[SPACE, SPACE_END]], to[[WHITE, WHITE_END]], to[RESET] = S_SPACE, S_WHITE, S_START
    for symbol, state in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER)):
        cut[symbol, [state, S_SPACE]] = 0
    for apostrophe in (SHORT, LONG):  # among other signs, or behind a space, it is one of them
        to[apostrophe, [S_OTHER, S_SPACE]], cut[apostrophe, [S_OTHER, S_SPACE]] = S_OTHER, 0
    for state, then in ((S_SHORT, S_DONE), (S_LONG, S_LONG2), (S_LONG2, S_DONE)):
        to[LETTER, state], cut[LETTER, state] = then, 0
    # The last white space before something else begins a piece of its own; the rest of its run goes on.
    cut[np.ix_([SPACE, WHITE], [S_SPACE, S_WHITE])] = 0
    cut[RESET] = 0
    return to, cut


@cache
def char_kinds(path: str) -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER by code point, as the library's own splitter has them: it is asked which neighbours it leaves together."""
    from tokenizers import Tokenizer

    splitter = Tokenizer.from_file(path).pre_tokenizer
    # No Unicode version has letters, numbers or white space beyond the third plane.
    points = np.array([c for c in range(0x40000) if not 0xD800 <= c < 0xE000])
    kinds = np.full(0x110000, OTHER, np.uint8)
    kinds[:0x40000] = WHITE
    for kind, beside in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        for part in np.array_split(points, 16):
            starts = {a for _, (a, _) in splitter.pre_tokenize_str("".join(f"{beside}{chr(c)}\n" for c in part))}
            kinds[[c for i, c in enumerate(part) if 3 * i + 1 not in starts]] = kind
    kinds[ord("'")] = OTHER
    return kinds


class Splitter:
    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds
        self.to, self.cut = _machine()

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """points: the texts one after the other, each followed by one place that becomes RESET; ends: those places."""
        kind = self.kinds[points]
        out = kind.copy()
        white = kind == WHITE
        last = np.zeros(len(out), bool)
        last[:-1] = white[:-1] & ~white[1:]
        last[np.maximum(ends - 1, 0)] = False  # at a text's end the run stays whole
        space = white & (points == 32)
        out[space] = SPACE
        out[space & last] = SPACE_END
        out[white & ~space & last] = WHITE_END
        at = np.flatnonzero(points == 39)
        if at.size:
            after = np.concatenate([points, [0, 0]])
            one, two = after[at + 1], after[at + 2]
            out[at[np.isin(one, [ord(c) for c in CONTRACTIONS["short"]])]] = SHORT
            out[at[np.any([(one == ord(a)) & (two == ord(b)) for a, b in CONTRACTIONS["long"]], axis=0)]] = LONG
        out[ends] = RESET
        return out

    def begins(self, symbols: np.ndarray) -> np.ndarray:
        """Where pieces begin, for symbols that start at a text's start."""
        n = -(-len(symbols) // CHUNK)
        grid = np.full((n, CHUNK), RESET, np.uint8)
        grid.reshape(-1)[: len(symbols)] = symbols
        grid = np.ascontiguousarray(grid.T)
        flat = self.to.reshape(-1)
        maps = np.tile(np.arange(10, dtype=np.uint8), (n, 1))
        for column in grid:
            maps = flat[column[:, None] * np.uint8(10) + maps]
        step = 1
        while step < n:  # prefix scan: maps[i] becomes the map of all chunks up to i
            later = maps.copy()
            later[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
            maps, step = later, step * 2
        state = np.concatenate([[np.uint8(S_START)], maps[:-1, S_START]]).astype(np.uint8)
        out, cut = np.empty_like(grid), self.cut.reshape(-1)
        for j, column in enumerate(grid):
            at = column * np.uint8(10) + state
            out[j], state = cut[at], flat[at]
        return np.flatnonzero(out.T.reshape(-1)[: len(symbols)])


def byte_letters() -> dict[str, int]:
    """The byte that a letter of the vocabulary file stands for: printable ones themselves, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Counts the tokens of a piece. keep: transitions and pieces that are held at once; beyond it they are compiled anew."""

    def __init__(self, path: str, keep: int = KEEP):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.tokens = {raw(t) for t in model["vocab"]}
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"])}
        self.heads = {t[:i] for t in self.tokens for i in range(len(t))}
        self.keep, self.fits = keep, {}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, tuple[int, int]] = {}
        #: The same, sorted: state and byte, next state, tokens more.
        self.sorted = tuple(np.zeros(0, np.int64) for _ in range(3))
        #: (text end, last token at each place in it, count at each place less the count now)
        self.states: list[tuple[bytes, tuple, tuple]] = [(b"", (None,), (0,))]
        self.ids = {self.states[0]: 0}
        self.known: dict[bytes, int] = {}

    def merged(self, s: bytes) -> list[bytes]:
        """Tokens of a short string, by applying the best-ranked merge again and again."""
        parts = [s[i : i + 1] for i in range(len(s))]
        while len(parts) > 1:
            rank, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, a: bytes | None, b: bytes) -> bool:
        """Whether b can stand as the token after a: the two stay as they are when merged together."""
        if (a, b) not in self.fits:
            if len(self.fits) > self.keep:
                self.fits.clear()
            self.fits[a, b] = self.merged(b) == [b] if a is None else self.merged(a + b) == [a, b]
        return self.fits[a, b]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        end, last, count = self.states[state]
        text = end + bytes([byte])
        for k in range(len(text)):
            if text[k:] in self.tokens and self.follows(last[k], text[k:]):
                token, more = text[k:], count[k] + 1
                break
        else:
            raise ValueError(f"no token ends at byte {byte}")
        cut = next(k for k in range(len(text) + 1) if text[k:] in self.heads)
        new = (text[cut:], (*last, token)[cut:], tuple(c - more for c in (*count, more)[cut:]))
        if new not in self.ids:
            self.ids[new] = len(self.states)
            self.states.append(new)
        self.next[state << 8 | byte] = out = (self.ids[new], more)
        return out

    def count(self, piece: bytes) -> int:
        """Tokens of one piece of any length."""
        state = total = 0
        for byte in piece:
            state, more = self.next.get(state << 8 | byte) or self.compile(state, byte)
            total += more
        return total

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Tokens of distinct short pieces, each a row of SHORT_PIECE bytes and its length."""
        blob, known = rows.tobytes(), self.known
        out = np.array([known.get(blob[i : i + 16], -1) for i in range(0, len(blob), 16)], np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            if len(self.next) > self.keep or len(known) > 2 * self.keep:
                self.clear()
            out[new] = self._run(rows[new])
            for i, n in zip(new.tolist(), out[new].tolist(), strict=True):
                self.known[blob[16 * i : 16 * i + 16]] = n
        return out

    def _run(self, rows: np.ndarray) -> np.ndarray:
        """All pieces side by side. What is compiled on the way is looked up in a table of its own until the end."""
        state, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        fresh = tuple(np.zeros(0, np.int64) for _ in range(3))
        for j in range(int(rows[:, SHORT_PIECE].max())):
            on = np.flatnonzero(rows[:, SHORT_PIECE] > j)
            key = state[on] << 8 | rows[on, j]
            to, more = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
            left = np.arange(len(on))
            for table in (self.sorted, fresh):
                left = _look_up(table, key, left, to, more)
            if len(left):
                keys = np.unique(key[left])
                got = np.array([self.next.get(k) or self.compile(k >> 8, k & 255) for k in keys.tolist()], np.int64)
                _look_up((keys, got[:, 0], got[:, 1]), key, left, to, more)
                fresh = _merged(fresh, (keys, got[:, 0], got[:, 1]))
            state[on] = to
            total[on] += more
        self.sorted = _merged(self.sorted, fresh)
        return total


def _look_up(table: tuple, key: np.ndarray, left: np.ndarray, to: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Fills to and more where the table has the key; which of left it hasn't."""
    if not len(table[0]) or not len(left):
        return left
    at = np.minimum(np.searchsorted(table[0], key[left]), len(table[0]) - 1)
    hit = table[0][at] == key[left]
    to[left[hit]], more[left[hit]] = table[1][at[hit]], table[2][at[hit]]
    return left[~hit]


def _merged(a: tuple, b: tuple) -> tuple:
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


class Tokenizer:
    """The compiled tokenizer of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, kinds: np.ndarray):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split != split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splitter, self.merger = Splitter(kinds), Merger(path)

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and their number. A special string inside a text is one token."""
        parts, n = [text], 0
        for s in self.special:
            if any(s in p for p in parts):
                cut = [p.split(s) for p in parts]
                n += sum(len(c) - 1 for c in cut)
                parts = [x for c in cut for x in c]
        return [x for p in parts for x in _short(p)], n

    def counts(self, texts: list[str]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0
        for i, t in enumerate(texts):
            parts, out[i] = self.parts(t)
            for p in parts:
                if p:
                    held.append((i, p))
                    size += len(p)
                if size >= GROUP:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, str]], out: list[int]) -> None:
        if not held:
            return
        blob = "\n".join([*(p for _, p in held), ""])
        points = np.frombuffer(blob.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for _, p in held]) - 1
        begins = self.splitter.begins(self.splitter.symbols(points, ends))
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width)])
        stop = np.concatenate([begins[1:], [len(points) - 1]])
        # A text's last piece ends at its own end, not where the next text begins.
        owner = np.searchsorted(ends, begins)
        stop = np.minimum(stop, ends[owner])
        raw, a, b = blob.encode(), offset[begins], offset[stop]
        n = np.zeros(len(a), np.int64)
        short = np.flatnonzero(b - a <= SHORT_PIECE)
        if len(short):
            rows = _short_rows(np.frombuffer(raw + bytes(SHORT_PIECE), np.uint8), a[short], b[short] - a[short])
            low, high = rows.view("<u8").T
            order = np.lexsort((low, high))
            new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            n[short[order]] = self.merger.counts(rows[order[new]])[np.cumsum(new) - 1]
        for i in np.flatnonzero(b - a > SHORT_PIECE).tolist():
            n[i] = self.merger.count(raw[a[i] : b[i]])
        totals = np.bincount(owner, n, len(held)).astype(np.int64)
        for (i, _), k in zip(held, totals.tolist(), strict=True):
            out[i] += k


def _short_rows(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row for each piece: its bytes, zeros, and in the last place its length."""
    rows = np.zeros((len(start), SHORT_PIECE + 1), np.uint8)
    for j in range(SHORT_PIECE):
        rows[:, j] = np.where(j < size, raw[start + j], 0)
    rows[:, SHORT_PIECE] = size
    return rows


def _short(text: str) -> list[str]:
    """A text in parts of about GROUP characters, cut between a sign and a space, where a piece begins whatever came before."""
    out, a = [], 0
    while len(text) - a > GROUP:
        b = a + GROUP
        while (b := text.find(" ", b)) > 0 and text[b - 1].isspace():
            b += 1
        if b < 0:
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]] if a else [text]


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path, char_kinds(path))


def vocabulary(name: str) -> str:
    """A vocabulary file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row: the tokens of its whole text without added ones.

    name: a file of the installed vocabularies, or an absolute path that every machine has.
    - A null or empty text has 0 bytes and 0 tokens. Special strings inside a text are one token each.
    - Rows are independent; repeated rows count each; other columns aren't read.
    """
    where = (lambda: name) if name.startswith("/") else (lambda: vocabulary(name))
    kinds = char_kinds(where())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _held.get(name)
        if own is None:
            own = _held[name] = Tokenizer(where(), kinds)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(own.counts(b.column("text").to_pylist()), pa.int64())], ["key", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = next(part(iter([b])))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_bytes"), n.column("n_tokens")], ["key", "n_bytes", "n_tokens"])

    return rows.transform(arrow, sized, f"key {kind}, n_bytes long, n_tokens long").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: The worker's compiled tokenizers, by name.
_held: dict[str, Tokenizer] = {}
