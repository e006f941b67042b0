"""Words of many texts at once, as numpy arrays over one byte buffer.

Texts are UTF-8 bytes; the classes of bytes that separate words are ASCII, so no character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Blank bytes: x20 and x09-x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: All ASCII but digits and a-z (after A-Z are lower-cased).
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes hashed at a time.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Polynomial hashes modulo 2**64 of any spans of a sequence, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.back, self.pow, self.inv = base, pow(base, -1, 1 << 64), np.ones(1, U), np.ones(1, U)

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.pow) <= n:
            self.pow, self.inv = _powers(self.base, max(n + 1, SLICE)), _powers(self.back, max(n + 1, SLICE))
        sums = np.zeros(n + 1, U)
        np.cumsum(values * self.pow[:n], out=sums[1:])
        return (sums[end] - sums[start]) * self.inv[start]


_BYTES, _WORDS = Roller(0x9E3779B97F4A7C15 | 1), Roller(0xD1B54A32D192ED03 | 1)
_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


@dataclass
class Scan:
    """``first[i]:first[i + 1]`` are the words of text i; word w is ``data[start[w]:end[w]]``."""

    data: np.ndarray
    raw: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out, n, lo = np.empty(len(self.start), U), len(self.start), 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + SLICE)))
            at = int(self.start[lo])
            part = self.data[at : int(self.end[hi - 1])]
            out[lo:hi] = mix(_BYTES.spans(_CODE[part], self.start[lo:hi] - at, self.end[lo:hi] - at))
            lo = hi
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words (also of those that span two texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U)
    start = np.arange(n)
    return mix(_WORDS.spans(hashes, start, start + k))


def scan(texts: list[bytes | None], separators: np.ndarray = BLANK, lower: bool = False) -> Scan:
    raw = b" ".join(t or b"" for t in texts) + b" "
    raw = raw.translate(LOWER) if lower else raw
    data = np.frombuffer(raw, np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=at[1:])
    blank = separators[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    return Scan(data, raw, start, end, np.searchsorted(start, at))


def chunks(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` bytes together; a longer text is alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
