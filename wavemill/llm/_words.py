"""Words of many texts at once: numpy over the bytes of an Arrow string array.

A word is a maximal run of bytes other than x20 and x09 to x0D. All of these are ASCII, so words of
UTF-8 bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_MULT_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each element."""
    h = h + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 7)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, (1 << 18) + (1 << 16))
        for name, base in (("up", _MULT), ("down", _MULT_INV)):
            x = np.full(m, base, U)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"]


def pieces(texts: pa.Array, most: int = 1 << 18) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes (one text at least), so that working arrays stay small."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


class Words:
    """data: bytes; off: of each text, and the end; start, end: of each word; doc: its text; first: each text's first word, and the end."""

    def __init__(self, texts: pa.Array, kind: np.ndarray | None = None, space: np.ndarray = SPACE):
        """``kind``: a number for each byte; between bytes of kinds 1 and 2, either way round, a word also ends. ``space``: which bytes stand between words."""
        self.kind = kind
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        n = len(self.data)
        inked = ~space[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        starts, ends = inked.copy(), inked.copy()
        starts[1:] &= ~inked[:-1] | edge[1:n]
        ends[:-1] &= ~inked[1:] | edge[1:n]
        if kind is not None and n:
            k = kind[self.data]
            inner = (k[:-1] + k[1:] == 3) & (k[:-1] * k[1:] == 2)
            starts[1:] |= inner
            ends[:-1] |= inner
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``table`` maps bytes first, such as A-Z to a-z."""
        return self.spans(self.start, self.end, table)

    def spans(self, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        n = len(self.data)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[self.data if table is None else table[self.data]] * up[:n], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))

    def grams(self, h: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of a text, and the index of the first word of each."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        parts, width, out, done = mix(h, seed + 1), 1, None, 0
        base = np.array([(2 * seed + 1) * 0xD1342543DE82EF95 & (2**64 - 1) | 1], U)
        power = base
        while True:  # by doubling: the hash of 2w words from two of w
            if k & width:
                have = parts[done : done + n]
                out = have.copy() if out is None else out * power + have
                done += width
            width *= 2
            if width > k:
                break
            m = len(parts) - width // 2
            parts = parts[:m] * power + parts[width // 2 :][:m]
            power = power * power
        return mix(out, seed)[at], at
