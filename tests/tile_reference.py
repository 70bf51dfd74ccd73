"""Tiles one by one: what the tiles of a band are to be, byte for byte."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gridloom.functions import bits, dtypes
from gridloom.functions.bits import Truncated
from gridloom.functions.container import CONSTANT, PACKED, RAW, ZERO, Header, top_quantum


@dataclass
class _Tile:
    """How one tile of one depth is stored, and what it costs."""

    mode: int
    size: int
    z_min: float = 0.0
    quanta: np.ndarray | None = None
    table: bool = False
    offset: tuple[int, int] = (0, 0)
    delta: bool = False


def _repeats(v: np.ndarray, from_zero: bool) -> int:
    return int(np.count_nonzero(v[1:] == v[:-1])) + int(from_zero and len(v) > 0 and v[0] == 0)


def plan_tile(v: np.ndarray, code: int, item: int, e: float, limit: int, lossless: bool, delta: bool = False) -> _Tile:
    """v: a tile's valid values (or their differences to the depth before, as 64-bit integers)."""
    n = len(v)
    low, high = (v.min(), v.max()) if n else (0, 0)
    if low == 0 and high == 0:
        return _Tile(ZERO, 1, delta=delta)
    raw = 1 + n * item
    z_min, z_max = float(low), float(high)
    top = top_quantum(z_min, z_max, e) if e > 0 else 0.0
    if (e == 0 and high > low) or top > limit:
        return _Tile(RAW, raw, delta=delta)
    offset = dtypes.narrow(z_min, code)
    size = 1 + dtypes.DTYPES[offset[1]].itemsize
    most = int(top + 0.5)
    quanta, table = None, False
    if most > 0:
        quanta = (v.astype(np.int64) - int(low)).astype(np.uint32) if lossless else ((v.astype(np.float64) - z_min) * (1 / (2 * e)) + 0.5).astype(np.uint32)
        plain = bits.plain_size(n, most)
        if n > 4 and z_max > z_min + 3 * e and 2 * _repeats(v, delta) > n:
            distinct = len(np.unique(quanta)) - 1
            tabled = bits.table_size(n, distinct, int(quanta.max())) if 1 <= distinct < 255 else plain
            table = tabled < plain
        size += tabled if table else plain
    if size >= raw:
        return _Tile(RAW, raw, delta=delta)
    return _Tile(PACKED if most > 0 else CONSTANT, size, z_min, quanta, table, offset, delta)


def _tile_bytes(t: _Tile, v: np.ndarray, col: int, version: int) -> bytes:
    check = ((col >> 3) & 15) << 2
    if version >= 5:
        check = check & 56 | 4 * t.delta
    if t.mode == RAW:
        return bytes([check]) + v.tobytes()
    if t.mode == ZERO:
        return bytes([check | ZERO])
    head = bytes([check | t.mode | t.offset[0] << 6]) + np.array(t.z_min).astype(dtypes.DTYPES[t.offset[1]]).tobytes()
    if t.mode == CONSTANT:
        return head
    return head + (bits.table_block if t.table else bits.plain_block)(t.quanta, version >= 3)


def blocks(h: Header, size: int):
    """(row from, to, col from, to) of the tiles, row by row."""
    for i in range(0, h.n_rows, size):
        for j in range(0, h.n_cols, size):
            yield i, min(i + size, h.n_rows), j, min(j + size, h.n_cols)


def write_tiles(a: np.ndarray, mask: np.ndarray | None, h: Header, size: int, emit: bool = True) -> tuple[int, list[bytes]]:
    """(bytes, the bytes themselves if ``emit``)."""
    integer, item, limit = dtypes.is_integer(h.dtype), a.dtype.itemsize, dtypes.quanta_limit(h.dtype)
    lossless = integer and h.max_error == 0.5
    try_delta = h.version >= 5 and h.n_depth > 1 and lossless
    total, out = 0, []
    for i0, i1, j0, j1 in blocks(h, size):
        part = a[i0:i1, j0:j1]
        part = part.reshape(-1, h.n_depth) if mask is None else part[mask[i0:i1, j0:j1]]
        for d in range(h.n_depth):
            v = part[:, d]
            t = plan_tile(v, h.dtype, item, h.max_error, limit, lossless)
            if try_delta and d and len(v):
                step = v.astype(np.int64) - part[:, d - 1].astype(np.int64)
                if -(2**31) <= step.min() and step.max() < 2**31:
                    s = plan_tile(step, dtypes.INT32, 4, h.max_error, limit, True, delta=True)
                    if s.size < t.size and s.mode != RAW:
                        t = s
            total += t.size
            if emit:
                out.append(_tile_bytes(t, v, j0, h.version))
    return total, out


def read_tiles(raw: bytes, at: int, a: np.ndarray, mask: np.ndarray, h: Header, z_max: np.ndarray) -> int:
    for i0, i1, j0, j1 in blocks(h, h.block):
        inside = mask[i0:i1, j0:j1]
        n = int(np.count_nonzero(inside))
        for d in range(h.n_depth):
            if at >= len(raw):
                raise Truncated("tile")
            head, at = raw[at], at + 1
            delta = h.version >= 5 and bool(head & 4)
            same = 14 if h.version >= 5 else 15
            if (head >> 2) & same != (j0 >> 3) & same or (delta and d == 0):
                raise Truncated("tile out of step")
            before = a[i0:i1, j0:j1, d - 1][inside].astype(np.float64) if delta else 0.0
            mode = head & 3
            if mode == ZERO:
                v = np.zeros(n) + before
            elif mode == RAW:
                if delta or at + n * a.dtype.itemsize > len(raw):
                    raise Truncated("raw tile")
                v = np.frombuffer(raw, a.dtype, n, at)
                at += n * a.dtype.itemsize
            else:
                kind = dtypes.widened(dtypes.INT32 if delta and dtypes.is_integer(h.dtype) else h.dtype, head >> 6)
                if kind is None or at + dtypes.DTYPES[kind].itemsize > len(raw):
                    raise Truncated("tile offset")
                offset = float(np.frombuffer(raw, dtypes.DTYPES[kind], 1, at)[0])
                at += dtypes.DTYPES[kind].itemsize
                if mode == CONSTANT:
                    v = np.full(n, offset) + before
                    v = np.minimum(v, z_max[d]) if delta else v
                else:
                    q, at = bits.read_block(raw, at, (i1 - i0) * (j1 - j0), h.version >= 3)
                    if len(q) < n:
                        raise Truncated("tile values")
                    v = np.minimum(offset + q[:n] * (2 * h.max_error) + before, z_max[d])
            a[i0:i1, j0:j1, d][inside] = v.astype(a.dtype)
    return at
