"""Words of whole texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

U = np.uint64
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """bytes.split() parts at exactly the six ASCII white-space characters; bytes.lower() changes A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), U, len(found))


@cache
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[U(1)], np.cumprod(np.full(n, U(b)))]) for b in (base, pow(base, -1, 1 << 64)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over all bits; one to one."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def runs(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each run of so many words, by differences of prefix sums; empty if there are fewer words."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, U)
    power, inverse = _powers(max(12, n.bit_length()), _BASES[which])
    sums = np.concatenate([[U(0)], np.cumsum(hashes * power[:n])])
    return mix((sums[length:] - sums[:-length]) * inverse[: n - length + 1])
