"""Lossless floats as byte planes: a predictor on the bit fields, then each byte plane differenced and coded."""

from __future__ import annotations

import numpy as np

from . import prefix, runs
from .bits import Truncated

NONE, ROWS, CROSS = 0, 1, 2
MOST_ORDER = 5
#: Bytes between those that are looked at to choose a predictor or an order.
STRIDE = 7
CODED, CONSTANT, STORED, RUNS = 0, 1, 2, 3

#: item bytes -> (unsigned type, bits of the mantissa field)
_FIELDS = {4: (np.uint32, 23), 8: (np.uint64, 52)}


def reorder(u: np.ndarray) -> np.ndarray:
    """32-bit floats with the exponent in front and the sign below it."""
    low, sign, exponent = u & np.uint32(0x7FFFFF), u >> np.uint32(31), (u >> np.uint32(23)) & np.uint32(0xFF)
    return low | sign << np.uint32(23) | exponent << np.uint32(24)


def restore_order(u: np.ndarray) -> np.ndarray:
    low, sign, exponent = u & np.uint32(0x7FFFFF), (u >> np.uint32(23)) & np.uint32(1), u >> np.uint32(24)
    return low | exponent << np.uint32(23) | sign << np.uint32(31)


def _halves(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    _, cut = _FIELDS[u.dtype.itemsize]
    t = u.dtype.type
    return u & t((1 << cut) - 1), u >> t(cut), cut


def _whole(low: np.ndarray, high: np.ndarray, cut: int, width: int) -> np.ndarray:
    t = low.dtype.type
    return low & t((1 << cut) - 1) | (high & t((1 << (width - cut)) - 1)) << t(cut)


def difference(u: np.ndarray, axis: int) -> np.ndarray:
    """Each value less the one before it on the axis, mantissa and exponent fields apart; the first stays."""
    low, high, cut = _halves(u)
    first = [slice(None)] * u.ndim
    first[axis] = slice(0, 1)
    step = lambda x: np.concatenate([x[tuple(first)], np.diff(x, axis=axis)], axis=axis)
    return _whole(step(low), step(high), cut, 8 * u.dtype.itemsize)


def accumulate(u: np.ndarray, axis: int) -> np.ndarray:
    """The inverse of :func:`difference`."""
    low, high, cut = _halves(u)
    return _whole(np.cumsum(low, axis=axis, dtype=u.dtype), np.cumsum(high, axis=axis, dtype=u.dtype), cut, 8 * u.dtype.itemsize)


def derive(b: np.ndarray, order: int) -> np.ndarray:
    """Differences of bytes, ``order`` times, the k-th leaving the first k bytes alone."""
    b = b.copy()
    for k in range(1, order + 1):
        b[k:] = np.diff(b[k - 1 :])
    return b


def integrate(b: np.ndarray, order: int) -> np.ndarray:
    b = b.copy()
    for k in range(order, 0, -1):
        b[k - 1 :] = np.cumsum(b[k - 1 :], dtype=np.uint8)
    return b


def entropy_bytes(b: np.ndarray) -> int:
    """Bytes that a perfect code of every STRIDE-th byte would take."""
    c = np.bincount(b[::STRIDE], minlength=256)
    c = c[c > 0]
    return int((c * np.log2(c.sum() / c)).sum() + 7) // 8 if len(c) else 0


def best_order(b: np.ndarray, most: int) -> int:
    """The order before the first one that makes it worse."""
    best = entropy_bytes(b)
    for k in range(1, most + 1):
        size = entropy_bytes(derive(b, k))
        if size >= best:
            return k - 1
        best = size
    return most


def code_plane(b: np.ndarray) -> bytes:
    histogram = np.bincount(b, minlength=256)
    lengths = prefix.code_lengths(histogram)
    if lengths is None:
        return bytes([CONSTANT, int(b[0])]) + len(b).to_bytes(4, "little")
    size = prefix.table_bytes(lengths) + prefix.stream_bytes(lengths, histogram)
    packed = runs.nibble_runs(b)
    if len(packed) < min(size, len(b)):
        return bytes([RUNS]) + packed
    if size >= len(b):
        return bytes([STORED]) + b.tobytes()
    codes = prefix.canonical(lengths)
    return bytes([CODED]) + prefix.write_table(lengths, codes) + prefix.write_stream(b, lengths, codes)


def read_plane(raw: bytes, at: int, end: int, n: int) -> np.ndarray:
    kind = raw[at] if at < end else -1
    if kind == CONSTANT and at + 6 <= end:
        if int.from_bytes(raw[at + 2 : at + 6], "little") != n:
            raise Truncated("constant plane")
        return np.full(n, raw[at + 1], np.uint8)
    if kind == STORED and at + 1 + n <= end:
        return np.frombuffer(raw, np.uint8, n, at + 1).copy()
    if kind == RUNS:
        return runs.read_nibble_runs(raw, at + 1, end, n)
    if kind == CODED:
        part = raw[:end]
        lengths, codes, at = prefix.read_table(part, at + 1)
        return prefix.read_stream(part, at, n, lengths, codes)[0].astype(np.uint8)
    raise Truncated("byte plane")


def _grid(values: np.ndarray) -> np.ndarray:
    """(rows, cols, depth) as a plane: depth, where there is one, runs along a row."""
    r, c, d = values.shape
    return values.reshape(r, c) if d == 1 else values.reshape(r * c, d)


def encode(values: np.ndarray) -> bytes:
    u = np.ascontiguousarray(_grid(values)).view(_FIELDS[values.dtype.itemsize][0])
    u = reorder(u) if u.dtype.itemsize == 4 else u
    rows = difference(u, 1)
    tries = [u, rows, difference(rows, 0)]
    planes_of = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.dtype.itemsize).T
    predictor = int(np.argmin([sum(entropy_bytes(p) for p in planes_of(x)) for x in tries]))
    out = [bytes([predictor])]
    for k, plane in enumerate(planes_of(tries[predictor])):
        plane = np.ascontiguousarray(plane)
        order = best_order(plane, MOST_ORDER - predictor)
        coded = code_plane(derive(plane, order))
        out.append(bytes([k, order]) + len(coded).to_bytes(4, "little") + coded)
    return b"".join(out)


def decode(raw: bytes, at: int, shape: tuple[int, int, int], dtype: np.dtype) -> tuple[np.ndarray, int]:
    r, c, d = shape
    rows, cols = (r, c) if d == 1 else (r * c, d)
    size = np.dtype(dtype).itemsize
    if at >= len(raw) or raw[at] > CROSS:
        raise Truncated("predictor")
    predictor, at = raw[at], at + 1
    planes = np.zeros((rows * cols, size), np.uint8)
    for _ in range(size):
        if at + 6 > len(raw):
            raise Truncated("plane header")
        k, order, n = raw[at], raw[at + 1], int.from_bytes(raw[at + 2 : at + 6], "little")
        if k >= size or order > MOST_ORDER or at + 6 + n > len(raw):
            raise Truncated("plane header")
        planes[:, k] = integrate(read_plane(raw, at + 6, at + 6 + n, rows * cols), order)
        at += 6 + n
    u = planes.view(_FIELDS[size][0]).reshape(rows, cols)
    if predictor == CROSS:
        u = accumulate(u, 0)
    if predictor != NONE:
        u = accumulate(u, 1)
    u = restore_order(u) if size == 4 else u
    return np.ascontiguousarray(u).view(dtype).reshape(shape), at
