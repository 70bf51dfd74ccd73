"""Prefix codes for symbols 0..size-1: lengths, canonical codes, the stored table, and the code stream."""

from __future__ import annotations

import heapq

import numpy as np

from . import bits
from .bits import Truncated


def code_lengths(histogram: np.ndarray) -> np.ndarray | None:
    """Bits of each symbol's code; None if fewer than two symbols occur or a code would pass 32 bits."""
    heap = [(int(c), int(s), (int(s),)) for s, c in enumerate(histogram) if c > 0]
    if len(heap) < 2:
        return None
    heapq.heapify(heap)
    lengths, tick = np.zeros(len(histogram), np.int64), len(histogram)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        both = a[2] + b[2]
        lengths[list(both)] += 1
        heapq.heappush(heap, (a[0] + b[0], tick, both))
        tick += 1
    return lengths if lengths.max() <= 32 else None


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by falling length, then rising symbol, counting up from 0."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, -lengths[used]))]
    code, length = 0, int(lengths[order[0]])
    for s in order.tolist():
        code >>= length - int(lengths[s])
        length = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def stretch(lengths: np.ndarray) -> tuple[int, int]:
    """The shortest range [a, b) of symbols, b possibly past the end and wrapping around, that holds all codes."""
    used = np.flatnonzero(lengths)
    size, a, b = len(lengths), int(used[0]), int(used[-1]) + 1
    # the longest stretch of unused symbols between or beside the used ones
    edges = np.concatenate([[-1], used, [size]])
    gaps = np.diff(edges) - 1
    g = int(np.argmax(gaps))
    if gaps[g] > 0 and size - gaps[g] < b - a:
        a, b = int(edges[g] + 1 + gaps[g]), int(edges[g] + 1 + size)
    return a, b


def table_bytes(lengths: np.ndarray) -> int:
    a, b = stretch(lengths)
    words = -(-int(lengths.sum()) // 32)
    return 16 + bits.plain_size(b - a, int(lengths.max())) + 4 * words


def stream_bytes(lengths: np.ndarray, histogram: np.ndarray) -> int:
    """Code stream and one word that a table-driven reader may look ahead into."""
    total = int((lengths * histogram).sum())
    return 4 * (-(-total // 32) + 1)


def _push(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Codes one after the other, from the top of little-endian 32-bit words."""
    end = np.cumsum(lengths)
    total = int(end[-1]) if len(end) else 0
    stream = np.zeros(-(-total // 32) * 32, np.uint8)
    begin = end - lengths
    for k in range(int(lengths.max()) if len(lengths) else 0):
        on = lengths > k
        stream[begin[on] + k] = (codes[on] >> (lengths[on] - 1 - k).astype(np.uint64)) & np.uint64(1)
    return np.packbits(stream).reshape(-1, 4)[:, ::-1].tobytes()


def write_table(lengths: np.ndarray, codes: np.ndarray, modern: bool = True) -> bytes:
    a, b = stretch(lengths)
    at = np.arange(a, b) % len(lengths)
    used = at[lengths[at] > 0]
    head = np.array([4, len(lengths), a, b], "<i4").tobytes()
    return head + bits.plain_block(lengths[at], modern) + _push(codes[used], lengths[used])


def _windows(raw: bytes, at: int, end: int) -> np.ndarray:
    """The 32 bits that begin at each bit of the stream."""
    words = np.frombuffer(raw, np.uint8, (end - at) // 4 * 4, at).reshape(-1, 4)[:, ::-1].ravel()
    padded = np.concatenate([words, np.zeros(8, np.uint8)]).astype(np.uint64)
    five = np.zeros(len(words), np.uint64)
    for k in range(5):
        five = five << np.uint64(8) | padded[k : k + len(words)]
    shift = np.arange(8, dtype=np.uint64)
    return ((five[:, None] >> (np.uint64(8) - shift)) & np.uint64(0xFFFFFFFF)).ravel()


def read_table(raw: bytes, at: int, modern: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(lengths, codes, place behind the table)."""
    if at + 16 > len(raw):
        raise Truncated("code table")
    version, size, a, b = np.frombuffer(raw, "<i4", 4, at).tolist()
    if version < 2 or not 0 < size <= 1 << 15 or not 0 <= a < b or b - a > size:
        raise Truncated("code table")
    stored, at = bits.read_block(raw, at + 16, b - a, modern)
    if len(stored) != b - a or (len(stored) and stored.max() > 32):
        raise Truncated("code lengths")
    lengths, codes = np.zeros(size, np.int64), np.zeros(size, np.uint64)
    symbols = np.arange(a, b) % size
    lengths[symbols] = stored
    used = symbols[stored > 0]
    begin = np.cumsum(lengths[used]) - lengths[used]
    words = -(-int(lengths[used].sum()) // 32)
    if at + 4 * words > len(raw):
        raise Truncated("codes")
    if len(used):
        codes[used] = _windows(raw, at, at + 4 * words)[begin] >> (32 - lengths[used]).astype(np.uint64)
    return lengths, codes, at + 4 * words


def write_stream(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    return _push(codes[symbols], lengths[symbols]) + b"\0\0\0\0"


def read_stream(raw: bytes, at: int, n: int, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int]:
    """(n symbols, place behind the stream). What every bit position would decode to is looked up at once; only the walk is sequential."""
    used = np.flatnonzero(lengths)
    if not len(used):
        raise Truncated("no codes")
    aligned = codes[used] << (32 - lengths[used]).astype(np.uint64)
    order = np.argsort(aligned, kind="stable")
    # no stream is longer than this
    end = min(len(raw), at + 4 * (-(-n * int(lengths.max()) // 32) + 1))
    windows = _windows(raw, at, end)
    which = np.searchsorted(aligned[order], windows, side="right") - 1
    step = lengths[used[order]][np.maximum(which, 0)].tolist()
    places = np.empty(n, np.int64)
    p, last = 0, len(step)
    for i in range(n):
        if p >= last:
            raise Truncated("code stream")
        places[i] = p
        p += step[p]
    after = at + 4 * (-(-p // 32) + 1)
    if after > len(raw):
        raise Truncated("code stream")
    symbols = used[order][which[places]]
    w = windows[places] >> (32 - lengths[symbols]).astype(np.uint64)
    if (which[places] < 0).any() or (w != codes[symbols]).any():
        raise Truncated("code stream")
    return symbols, after
