"""Personal data by candidate gradient boosting.

Exact patterns give the base spans, which always stay. High-recall generators propose further, overlapping
spans (obfuscated addresses, unusual separators, phone numbers without a plus). Boosted trees, trained here on
made-up examples and look-alikes, weigh a span's format and context; a threshold per kind, calibrated for
precision on held-out examples, selects what is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

#: Fixed patterns of the base spans. The address is found from its @, and a run of digits is tried once, so no text takes quadratic time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (done := m.end())
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches by kind that pass their test; what fails is dropped without another try."""
    out: dict[str, list[Span]] = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# --- candidates -----------------------------------------------------------------------------------------------

#: Longest runs of all characters that the generators for numbers take, from a digit or a bracket on, as the shortest number has 7:
#: every match lies in one run, whose neighbours are no digits, so that the generators find there what they find in the whole text.
_REGION = re.compile(r"[0-9(][0-9()\[\]., _/-]{6,}")
_NUMBERS = {
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(]?[.,][\])]? ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{3,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])\(?(?:00)?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){1,4}[0-9]*(?![0-9])"),
}
_DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (9, 15)}
#: Case is that of ASCII, as without that flag [a-z] would take two letters beyond it.
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE | re.ASCII)
#: Every match of _SPELLED has one of these.
_AT = re.compile(r" at |[\[(] ?at ?[\])]", re.IGNORECASE | re.ASCII)
#: Words near a span that speak for a kind, and words that speak for something else.
_WORDS = {"email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "credit", "pay", "amex"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell")}
_OTHER = ("order", "isbn", "version", "invoice", "part", "ref", "no.", "#", "sku", "total", "dated", "page", "serial")
NEAR = 24
#: Candidates that are weighed at once.
AT_ONCE = 4096


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans, which may overlap one another and the base spans."""
    out = []
    if _AT.search(text):
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    for region in _REGION.finditer(text):
        a, b = region.span()
        for kind, pattern in _NUMBERS.items():
            least, most = _DIGITS[kind]
            out += [(kind, *m.span()) for m in pattern.finditer(text, a, b) if least <= len(digits_of(m[0])) <= most]
    return out


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span and what stands beside it."""
    s, digits = text[a:b].lower(), digits_of(text[a:b])
    before, after = text[max(0, a - NEAR) : a].lower(), text[b : b + NEAR].lower()
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    own = [w in before for w in _WORDS[kind]]
    return [
        KINDS.index(kind), b - a, len(digits), len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0), float(np.std(groups)) if groups else 0,
        len(set(re.sub("[A-Za-z0-9]", "", s))), len(set(digits)), s.count("."), s.count("-"), s.count(" "), s.count("("), s.count("/"), s.count("@"), s.count("["),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(all(int(g) <= 255 for g in re.findall("[0-9]{1,3}", s)) and len(groups) == 4), float(s.startswith("00") or s.startswith("(")),
        float("at" in s and "dot" in s), float("(" in s and "at" in s or "[" in s and "at" in s), sum(own), sum(w in before for k in KINDS if k != kind for w in _WORDS[k]), sum(w in before for w in _OTHER),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("$", "€", "£", "-", "/")), float(after[:1] in ("%", "/", "-")),
    ]


# --- boosted trees --------------------------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted trees for the logistic loss; splits at quantiles of each feature."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 24, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.cuts, self.ridge = rounds, depth, rate, cuts, ridge
        self.trees: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) for j in range(x.shape[1])]
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            grad, hess = y - p, p * (1 - p)
            tree, leaf = [], np.zeros(len(y), np.int64)
            for level in range(self.depth):  # one split for all nodes of a level
                n = 1 << level
                best = (-1.0, 0, 0.0)
                for j, cuts in enumerate(edges):
                    for c in cuts:
                        side = leaf * 2 + (x[:, j] > c)
                        g, h = np.bincount(side, grad, 2 * n), np.bincount(side, hess, 2 * n)
                        gain = float((g * g / (h + self.ridge)).sum())
                        if gain > best[0] + 1e-12:
                            best = (gain, j, float(c))
                tree.append(best[1:])
                leaf = leaf * 2 + (x[:, best[1]] > best[2])
            value = self.rate * np.bincount(leaf, grad, 1 << self.depth) / (np.bincount(leaf, hess, 1 << self.depth) + self.ridge)
            self.trees.append(tree)
            self.leaves.append(value)
            z += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for tree, value in zip(self.trees, self.leaves, strict=True):
            leaf = np.zeros(len(x), np.int64)
            for j, c in tree:
                leaf = leaf * 2 + (x[:, j] > c)
            z += value[leaf]
        return 1 / (1 + np.exp(-z))


def examples(n: int = 2400, seed: int = 4) -> list[tuple[str, str, int, int, int]]:
    """Made-up (text, kind, start, end, is personal data), half of them look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghiklmnoprstuvw") for _ in range(rng.integers(3, 9)))
    out = []
    for i in range(n):
        kind, good = KINDS[i % 4], bool(i // 4 % 2)
        if kind == "email":
            at, dot = pick([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", ".")])
            s = f"{word()}{pick(['', '.' + word(), num(2)])}{at}{word()}{dot}{pick(['com', 'org', 'net', 'de'])}" if good else f"{word()} at {word()}.{word().title()}"
        elif kind == "ip":
            sep = pick(["[.]", "(.)", " . "])
            s = sep.join(str(rng.integers(1, 256)) for _ in range(4)) if good else pick([f"{rng.integers(1, 30)}, {rng.integers(1, 999)}, {rng.integers(1, 999)}, {rng.integers(1, 999)}", f"{rng.integers(1, 9)}.{rng.integers(300, 999)}.{rng.integers(0, 99)}.{rng.integers(300, 999)}", f"{num(3)},{num(3)},{num(3)},{num(3)}"])
        elif kind == "card":
            sep = pick([".", "_", "/", "--", " - "][:4])
            body = num(15)
            digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
            if not good:
                digits = digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(0, 8))) % 10)
            s = sep.join(digits[j : j + 4] for j in range(0, 16, 4))
        else:
            s = pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(3)}", f"{num(3)}.{num(3)}.{num(4)}"]) if good else pick([f"{num(4)}-{num(2)}-{num(2)}", f"{num(3)}-{num(1)}-{num(2)}-{num(4)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(5)}-{num(4)}-{num(5)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(1)}.{num(2)}.{num(3)}.{num(4)}"])
        told = rng.random()
        lead = pick(_WORDS[kind]) + pick([": ", " ", " is ", " me at "]) if told < (0.7 if good else 0.15) else pick(_OTHER) + " " if told > (0.95 if good else 0.5) else word() + " "
        before = f"{word()} {word()} {lead}"
        out.append((f"{before}{s} {word()} {word()}.", kind, len(before), len(before) + len(s), int(good)))
    return out


@cache
def model(precision: float = 0.99) -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold: the lowest score from which on held-out examples reach the precision; 2, which selects nothing, if there is none."""
    rows = examples()
    x, y = np.array([features(t, k, a, b) for t, k, a, b, _ in rows]), np.array([r[4] for r in rows], float)
    held = np.arange(len(rows)) // 8 % 3 == 0
    trees = Boosted().fit(x[~held], y[~held])
    p = trees.predict(x)
    limits = {}
    for i, kind in enumerate(KINDS):
        own = held & (x[:, 0] == i)
        scores = np.sort(np.unique(p[own]))
        limits[kind] = max(0.5, next((float(s) for s in scores if y[own & (p >= s)].mean() >= precision), 2.0))
    return trees, limits


def all_spans(text: str) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans: base ones and, by kind from the best down, selected ones that touch no span yet taken."""
    base = base_spans(text)
    spans = [(k, a, b) for k in KINDS for a, b in base[k]]
    proposed = candidates(text)
    if proposed:
        # A mark for every place that a span takes, so that a look costs a span's own length, whatever their number.
        taken = bytearray(len(text))
        for _, a, b in spans:
            taken[a:b] = b"\1" * (b - a)
        proposed = [c for c in proposed if taken.find(1, c[1], c[2]) < 0]
    if proposed:
        trees, limits = model()
        scores = np.concatenate([trees.predict(np.array([features(text, *c) for c in proposed[i : i + AT_ONCE]])) for i in range(0, len(proposed), AT_ONCE)])
        for s, c in sorted(zip(scores, proposed, strict=True), key=lambda x: (-x[0], x[1][1], KINDS.index(x[1][0]))):
            if s >= limits[c[0]] and taken.find(1, c[1], c[2]) < 0:
                spans.append(c)
                taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
    return base, sorted(spans, key=lambda c: (c[1], KINDS.index(c[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first covers the rest."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans (and redacted, if with_text) for every row.

    - The counts and base_sha256 tell of base spans, spans of all; a place is kind:start:end in code points, end exclusive.
    - A null text counts as empty: no spans, and the digest of the empty string; its redacted text is null.
    - Base spans of different kinds may overlap; added ones overlap nothing. Rows are independent; other columns aren't read.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column("text").to_pylist():
                base, spans = all_spans(t or "")
                first = sorted(((k, x, y) for k in KINDS for x, y in base[k]), key=lambda c: (c[1], KINDS.index(c[0])))
                row = [*(len(base[k]) for k in KINDS), hashlib.sha256(joined(first).encode()).hexdigest(), joined(spans), None if t is None or not with_text else redact(t, spans)]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).transform(arrow, part, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
    return out.withColumnRenamed("key", key) if with_text else out.drop("redacted").withColumnRenamed("key", key)
