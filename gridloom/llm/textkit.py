"""Whole texts as flat numpy arrays: words, hashes and per-document sums without a Python loop over words.

A word is a maximal run of characters other than space and U+0009..U+000D. Those are single bytes in
UTF-8, so all of this works on the bytes of an Arrow string column. Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are handled in groups of about this many bytes (one text at least), which bounds the scratch arrays.
GROUP_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, GROUP_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * GROUP_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(items: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Prefix sums from which :func:`span` takes the hash of any span of ``items``."""
    out = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * powers(base, len(items)), out=out[1:])
    return out


#: Bytes beyond which a stretch of text is hashed by xxh3: polynomials modulo 2**64 have long inputs that collide whatever the base.
LONG = 64


def stretches(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of the bytes data[start:end], of which ``prefix`` is the rolling hash."""
    out = span(prefix, start, end)
    for k in np.flatnonzero(end - start > LONG):
        raw = data[start[k] : end[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(raw.translate(_LOWER) if fold else raw)
    return out


def run_names(items: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A name of every run of ``width`` items, by doubling: each step mixes the names of two shorter runs, so no structure of the items cancels."""
    left, right = mix(np.array([salt, salt + 1], dtype=np.uint64)) | np.uint64(1)
    power, size, out, done = mix(items ^ left), 1, None, 0
    while True:
        if width & size:
            if out is None:
                out = power
            else:
                k = max(len(items) - done - size + 1, 0)
                out = mix(out[:k] * left + power[done : done + k] * right + np.uint64(size))
            done += size
        if done == width:
            return out[: max(len(items) - width + 1, 0)]
        k = max(len(power) - size, 0)
        power = mix(power[:k] * left + power[size : size + k] * right)
        size *= 2


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, ibase: np.uint64 = _IBASE) -> np.ndarray:
    """Position-free hash of items[start:end]; for short stretches."""
    return mix((prefix[end] - prefix[start]) * powers(ibase, len(prefix))[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of several texts; those of text i are first[i]:first[i+1]."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def per_doc(self, flag: np.ndarray) -> np.ndarray:
        """Sum over each text of a per-byte flag."""
        return sums(flag, self.off)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its texts; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, fold: bool = False) -> Words:
    """Words and their hashes; ``fold`` takes A-Z as a-z."""
    n = len(data)
    inside = ~_BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (edge[:-1] | ~before))
    end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    prefix = rolling((_FOLD if fold else _BYTE)[data])
    return Words(data, off, start, end, np.searchsorted(start, off), stretches(data, prefix, start, end, fold), prefix)


def each(col: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(from, to, their words) over a column of texts."""
    data, off = buffers(col)
    for i, j in groups(off):
        yield i, j, words(data[off[i] : off[j]], off[i : j + 1] - off[i], fold)


def longs(x: np.ndarray) -> pa.Array:
    """64-bit hashes as signed numbers, as Spark has them."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
