"""Vectorised word and shingle hashing over Arrow text columns.

Every function works on the raw UTF-8 bytes of a block of documents. Words are maximal runs of
bytes other than space and 0x09-0x0D, which in UTF-8 are exactly the runs of such code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(0x5EED)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Odd multipliers, one for each place in a shingle of up to 16 words, and one for its length.
PLACE = _RNG.integers(1, 2**63, 17, dtype=np.uint64) | np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
#: A prime below 2^31, so that products of two residues fit in 64 bits.
PRIME = np.uint64(2147483629)
BYTE_RESIDUE = _RNG.integers(1, 2147483629, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(2, 2147483628))


def _residues(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo PRIME, and of its inverse."""
    if "r" not in _powers or len(_powers["r"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("r", _BASE), ("b", pow(_BASE, -1, int(PRIME)))):
            x = np.ones(1, np.uint64)
            while len(x) < size:
                x = np.concatenate([x, x * np.uint64(pow(base, len(x), int(PRIME))) % PRIME])
            _powers[key] = x
    return _powers["r"][:n], _powers["b"][:n]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "f" not in _powers or len(_powers["f"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("f", _R), ("i", _RINV)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[key] = np.cumprod(x)
    return _powers["f"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and n + 1 offsets. A null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


class Words:
    """Word positions of a block of documents; word k covers bytes start[k]:end[k] of buf."""

    def __init__(self, column: pa.Array, lower: bool = True):
        buf, self.offsets = raw(column)
        self.raw = buf
        self.buf = _LOWER[buf] if lower else buf
        gap = _GAP[buf]
        inside = ~gap
        cut = np.zeros(len(buf) + 1, bool)
        cut[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        if len(buf):
            first[1:] &= gap[:-1] | cut[1:-1]
            last[:-1] &= gap[1:] | cut[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: Document k has words first_word[k]:first_word[k + 1].
        self.first_word = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.first_word) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return Hasher(self.buf).spans(self.start, self.end)


class Hasher:
    """64-bit hashes of any spans of a byte string, from one pass of prefix sums.

    Sums modulo 2^64 alone give equal values to some texts made for it; strong spans are mixed with a sum modulo a prime,
    whose base is no power-of-two matter, so such texts differ too.
    """

    def __init__(self, buf: np.ndarray, strong: bool = False):
        f, self.inv = _power(len(buf) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(BYTE_CODE[buf] * f[: len(buf)], out=self.sums[1:])
        if strong:
            f, self.back = _residues(len(buf) + 1)
            self.rests = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(BYTE_RESIDUE[buf] * f[: len(buf)] % PRIME, out=self.rests[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.inv[start]
            return mix(h + (end - start).astype(np.uint64) * PLACE[16])

    def strong_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        rest = (self.rests[end] - self.rests[start]) % PRIME * self.back[start] % PRIME
        return mix(self.spans(start, end) ^ mix(rest))


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words of one document; with fewer words, one of them all; none without words."""
    n = len(w)
    if not n:
        return w[:0]
    k = min(n, k)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64) * PLACE[16]
        for i in range(k):
            h += w[i : n - k + 1 + i] * PLACE[i]
    return mix(h)


def shingle_at(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, wherever documents end."""
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(w) - k + 1), np.uint64)
        for i in range(k):
            h += w[i : len(w) - k + 1 + i] * PLACE[i]
    return mix(h)


class MinHash:
    """count independent minwise values of a set of 64-bit hashes, 32 bits each."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, count, dtype=np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.uint64(2**64 - 1))
        with np.errstate(over="ignore"):
            for at in range(0, len(x), 4096):
                y = self.a[:, None] * x[None, at : at + 4096]
                y += self.b[:, None]
                np.minimum(low, y.min(axis=1), out=low)
        return (low >> np.uint64(32)).astype(np.uint32)
