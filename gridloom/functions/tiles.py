"""Tiles of a band, all at once: what each costs in each form, and their bytes.

A tile's values are a stretch of one flat array, so minima, quanta and sizes of all tiles are reductions over
stretches, and tiles are packed and unpacked together by bit width.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import bits, dtypes
from .bits import Truncated

RAW, PACKED, ZERO, CONSTANT = range(4)


def in_order(n_rows: int, n_cols: int, size: int, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(valid pixels, tile by tile and row by row in each; how many each tile has; pixels of each tile; its first column)."""
    down, across = -(-n_rows // size), -(-n_cols // size)
    at = np.full((down * size, across * size), -1, dtype=np.int64)
    at[:n_rows, :n_cols] = np.arange(n_rows * n_cols).reshape(n_rows, n_cols)
    at = at.reshape(down, size, across, size).transpose(0, 2, 1, 3).reshape(down * across, size * size)
    ok = at >= 0
    area = ok.sum(axis=1)
    if mask is not None:
        ok &= mask.ravel()[at]
    return at[ok], ok.sum(axis=1), area, np.arange(down * across) % across * size


def widths(top: np.ndarray) -> np.ndarray:
    """Bits that each number needs; 0 for 0."""
    return np.frexp(top.astype(np.float64))[1].astype(np.int64)


def _count_bytes(n: np.ndarray) -> np.ndarray:
    return np.where(n < 1 << 8, 1, np.where(n < 1 << 16, 2, 4))


def _narrow(z: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits and the type of the narrowest form that holds each z exactly."""
    two, kind = np.zeros(len(z), np.int64), np.full(len(z), code)
    open_ = np.ones(len(z), dtype=bool)
    for b, small in dtypes.narrower(code):
        low, high = dtypes.value_range(small)
        fits = open_ & (z >= low) & (z <= high)
        with np.errstate(over="ignore"):
            fits &= (z.astype(np.float32) == z) if small == dtypes.FLOAT32 else (np.floor(z) == z)
        two[fits], kind[fits] = b, small
        open_ &= ~fits
    return two, kind


_ITEM = np.array([d.itemsize for d in dtypes.DTYPES])


@dataclass
class Plan:
    """For each tile of one depth: its form, size, offset and whether it is a table or a difference; for each value its quantum."""

    mode: np.ndarray
    size: np.ndarray
    z_min: np.ndarray
    two: np.ndarray
    kind: np.ndarray
    width: np.ndarray
    table: np.ndarray
    delta: np.ndarray
    quanta: np.ndarray

    def instead(self, other: Plan, use: np.ndarray, n: np.ndarray) -> Plan:
        """``other`` where ``use``."""
        fields = {f: np.where(use, getattr(other, f), getattr(self, f)) for f in ("mode", "size", "z_min", "two", "kind", "width", "table", "delta")}
        return Plan(**fields, quanta=np.where(np.repeat(use, n), other.quanta, self.quanta))


def plan(v: np.ndarray, n: np.ndarray, code: int, item: int, e: float, limit: int, lossless: bool, delta: bool = False) -> Plan:
    """v: all tiles' valid values (or their differences to the depth before, as 64-bit integers), n of them each."""
    start = np.cumsum(n) - n
    some = n > 0
    low, high = np.zeros(len(n), v.dtype), np.zeros(len(n), v.dtype)
    if some.any():
        low[some], high[some] = np.minimum.reduceat(v, start[some]), np.maximum.reduceat(v, start[some])
    z_min, z_max = low.astype(np.float64), high.astype(np.float64)
    zero = (low == 0) & (high == 0)
    raw = 1 + n * item
    with np.errstate(over="ignore", invalid="ignore"):
        top = (z_max - z_min) * (1 / (2 * e)) if e > 0 else np.zeros(len(n))
    whole = ~zero & ((high > low) if e == 0 else ~(top <= limit))
    fine = ~zero & ~whole
    two, kind = _narrow(np.where(fine, z_min, 0), code)
    most = np.where(fine, top + 0.5, 0).astype(np.int64)
    packed = fine & (most > 0)
    quanta = np.zeros(len(v), np.uint32)
    inside = np.repeat(packed, n)
    if inside.any():
        x = v[inside]
        if lossless:
            quanta[inside] = (x.astype(np.int64) - np.repeat(low.astype(np.int64), n)[inside]).astype(np.uint32)
        else:
            quanta[inside] = ((x.astype(np.float64) - np.repeat(z_min, n)[inside]) * (1 / (2 * e)) + 0.5).astype(np.uint32)
    width = widths(most)
    counted = _count_bytes(n)
    block = np.where(packed, 1 + counted + ((n * width + 7) >> 3), 0)
    table = packed & (n > 4) & (z_max > z_min + 3 * e)
    if table.any():
        same = np.zeros(len(v) + 1, np.int64)
        np.cumsum(v[1:] == v[:-1], out=same[2:])
        twice = same[start + n] - same[np.minimum(start + 1, len(v))]
        if delta:
            twice = twice + (v[np.minimum(start, len(v) - 1)] == 0)
        table &= 2 * twice > n
    if table.any():
        inside = np.repeat(table, n)
        key = np.sort(np.repeat(np.arange(len(n)), n)[inside] << 32 | quanta[inside].astype(np.int64))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        distinct = np.bincount(key[new] >> 32, minlength=len(n)) - 1
        tabled = 2 + counted + ((distinct * width + 7) >> 3) + ((n * widths(np.maximum(distinct, 0)) + 7) >> 3)
        table &= (distinct >= 1) & (distinct < 255) & (tabled < block)
        block = np.where(table, tabled, block)
    size = np.where(fine, 1 + _ITEM[kind] + block, raw)
    worse = fine & (size >= raw)
    mode = np.where(zero, ZERO, np.where(whole | worse, RAW, np.where(packed, PACKED, CONSTANT)))
    return Plan(mode, np.where(zero, 1, np.where(worse, raw, size)), z_min, two, kind, width, table, np.full(len(n), delta), quanta)


def _put(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Bytes rows[i] at at[i]."""
    out[at[:, None] + np.arange(rows.shape[1])] = rows


def _emit(out: np.ndarray, at: np.ndarray, p: Plan, v: np.ndarray, n: np.ndarray, first_col: np.ndarray, version: int) -> None:
    start = np.cumsum(n) - n
    check = ((first_col >> 3) & 15) << 2
    if version >= 5:
        check = check & 56 | 4 * p.delta
    fine = (p.mode == PACKED) | (p.mode == CONSTANT)
    out[at] = check | p.mode | np.where(fine, p.two << 6, 0)
    raw = np.repeat(p.mode == RAW, n)
    if raw.any():
        place = (np.repeat(at + 1 - start * v.itemsize, n) + np.arange(len(v)) * v.itemsize)[raw]
        _put(out, place, np.ascontiguousarray(v[raw]).view(np.uint8).reshape(-1, v.itemsize))
    for kind in np.unique(p.kind[fine]):
        t = np.flatnonzero(fine & (p.kind == kind))
        d = dtypes.DTYPES[kind]
        _put(out, at[t] + 1, p.z_min[t].astype(d).view(np.uint8).reshape(-1, d.itemsize))
    base = at + 1 + _ITEM[p.kind]
    for t in np.flatnonzero((p.mode == PACKED) & (p.table | (version < 3))):
        block = (bits.table_block if p.table[t] else bits.plain_block)(p.quanta[start[t] : start[t] + n[t]], version >= 3)
        out[base[t] : base[t] + len(block)] = np.frombuffer(block, np.uint8)
    plain = (p.mode == PACKED) & ~p.table
    if version < 3 or not plain.any():
        return
    counted = _count_bytes(n)
    out[base[plain]] = np.where(counted == 4, 0, 3 - counted)[plain] << 6 | p.width[plain]
    for k in range(4):
        t = plain & (counted > k)
        out[base[t] + 1 + k] = n[t] >> 8 * k & 255
    most = int(n.max())
    for width in np.unique(p.width[plain]):
        t = np.flatnonzero(plain & (p.width == width))
        q = np.zeros((len(t), most), "<u4")
        row = np.repeat(np.arange(len(t)), n[t])
        col = np.arange(len(row)) - np.repeat(np.cumsum(n[t]) - n[t], n[t])
        q[row, col] = p.quanta[np.repeat(start[t], n[t]) + col]
        stream = np.unpackbits(q.view(np.uint8).reshape(len(t), most, 4), axis=2, bitorder="little")[:, :, :width]
        rows = np.packbits(stream.reshape(len(t), -1), axis=1, bitorder="little")
        used = np.arange(rows.shape[1]) < ((n[t] * width + 7) >> 3)[:, None]
        out[((base + 1 + counted)[t][:, None] + np.arange(rows.shape[1]))[used]] = rows[used]


def write(a: np.ndarray, mask: np.ndarray | None, size: int, code: int, e: float, version: int, emit: bool = True) -> tuple[int, bytes]:
    """(size, bytes: none unless ``emit``) of the tiles of a band [row, col, depth]."""
    n_rows, n_cols, n_depth = a.shape
    integer, item, limit = dtypes.is_integer(code), a.dtype.itemsize, dtypes.quanta_limit(code)
    lossless = integer and e == 0.5
    pixels, n, _, first_col = in_order(n_rows, n_cols, size, mask)
    values = a.reshape(-1, n_depth)[pixels]
    plans = []
    for d in range(n_depth):
        v = np.ascontiguousarray(values[:, d])
        p = plan(v, n, code, item, e, limit, lossless)
        if version >= 5 and lossless and d and len(v):
            step = v.astype(np.int64) - values[:, d - 1].astype(np.int64)
            some, start = n > 0, np.cumsum(n) - n
            held = np.zeros(len(n), dtype=bool)
            held[some] = (np.minimum.reduceat(step, start[some]) >= -(2**31)) & (np.maximum.reduceat(step, start[some]) < 2**31)
            clipped = np.where(np.repeat(held, n), step, 0)
            s = plan(clipped, n, dtypes.INT32, 4, e, limit, True, delta=True)
            p = p.instead(s, held & (s.size < p.size) & (s.mode != RAW), n)
        plans.append((p, v))
    sizes = np.stack([p.size for p, _ in plans], axis=1)
    total = int(sizes.sum())
    if not emit:
        return total, b""
    at = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
    out = np.zeros(total, np.uint8)
    for d, (p, v) in enumerate(plans):
        _emit(out, at[:, d], p, v, n, first_col, version)
    return total, out.tobytes()


def _unpacked(raw: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """The first n[i] numbers of ``width`` bits from each place, one after another."""
    most = int(n.max())
    rows = raw[np.minimum(at[:, None] + np.arange((most * width + 7) >> 3), len(raw) - 1)]
    stream = np.unpackbits(rows, axis=1, bitorder="little")[:, : most * width].reshape(len(at), most, width)
    out = np.zeros((len(at), most, 32), np.uint8)
    out[:, :, :width] = stream
    q = np.packbits(out, axis=2, bitorder="little").reshape(len(at), most, 4).view("<u4")[:, :, 0]
    return q[np.arange(most) < n[:, None]]


def read(raw: bytes, at: int, a: np.ndarray, mask: np.ndarray, size: int, code: int, e: float, version: int, z_max: np.ndarray) -> int:
    """Fill a [row, col, depth] with the tiles that begin at ``at``; returns the place behind them."""
    n_rows, n_cols, n_depth = a.shape
    pixels, n, area, first_col = in_order(n_rows, n_cols, size, mask)
    item, end, modern, same = a.dtype.itemsize, len(raw), version >= 3, 14 if version >= 5 else 15
    steps = (first_col >> 3) & same
    kinds = {False: [dtypes.widened(code, k) for k in range(4)], True: [dtypes.widened(dtypes.INT32 if dtypes.is_integer(code) else code, k) for k in range(4)]}
    length = _ITEM.tolist()
    # one walk finds where everything is; a row for each tile and depth: mode, delta, kind, place, width
    found, odd = [], {}
    for t, (m, most, step) in enumerate(zip(n.tolist(), area.tolist(), steps.tolist())):
        for d in range(n_depth):
            if at >= end:
                raise Truncated("tile")
            head = raw[at]
            at += 1
            delta = version >= 5 and bool(head & 4)
            if (head >> 2) & same != step or (delta and d == 0):
                raise Truncated("tile out of step")
            mode = head & 3
            if mode == ZERO:
                found.append((ZERO, delta, 0, 0, 0))
            elif mode == RAW:
                if delta or at + m * item > end:
                    raise Truncated("raw tile")
                found.append((RAW, False, 0, at, 0))
                at += m * item
            else:
                kind = kinds[delta][head >> 6]
                if kind is None or at + length[kind] > end:
                    raise Truncated("tile offset")
                place, at, width = at, at + length[kind], 0
                if mode == PACKED:
                    block = raw[at] if at < end else 32
                    if block & 32 or not modern:
                        q, at = bits.read_block(raw, at, most, modern)
                        if len(q) < m:
                            raise Truncated("tile values")
                        odd[t, d], width = q[:m], -1
                    else:
                        wide = 4 if block >> 6 == 0 else 3 - (block >> 6)
                        held, width = int.from_bytes(raw[at + 1 : at + 1 + wide], "little"), block & 31
                        at += 1 + wide
                        if wide < 1 or held > most:
                            raise Truncated("count of a block")
                        if at + ((held * width + 7) >> 3) > end:
                            raise Truncated("packed values")
                        if held < m:
                            raise Truncated("tile values")
                        at += (held * width + 7) >> 3
                        found.append((mode, delta, kind, place, width | wide << 8))
                        continue
                found.append((mode, delta, kind, place, width))
    table = np.array(found, dtype=np.int64).reshape(len(n), n_depth, 5)
    data, flat = np.frombuffer(raw, np.uint8), a.reshape(-1, n_depth)
    start = np.cumsum(n) - n
    for d in range(n_depth):
        mode, delta, kind, place, width = table[:, d].T
        wide, width = np.where(width > 0, width >> 8, 0), np.where(width > 0, width & 255, width)
        offset, fine = np.zeros(len(n)), (mode == PACKED) | (mode == CONSTANT)
        for k in np.unique(kind[fine]):
            t = np.flatnonzero(fine & (kind == k))
            offset[t] = data[place[t][:, None] + np.arange(length[k])].reshape(-1).view(dtypes.DTYPES[k]).astype(np.float64)
        v = np.repeat(offset, n)
        for w in np.unique(width[(mode == PACKED) & (width > 0)]):
            t = np.flatnonzero((mode == PACKED) & (width == w) & (n > 0))
            if len(t):
                v[np.repeat(start[t], n[t]) + np.arange(n[t].sum()) - np.repeat(np.cumsum(n[t]) - n[t], n[t])] += _unpacked(data, place[t] + _ITEM[kind[t]] + 1 + wide[t], n[t], int(w)) * (2 * e)
        for (t, depth), q in odd.items():
            if depth == d:
                v[start[t] : start[t] + n[t]] += q * (2 * e)
        if delta.any():
            v += np.where(np.repeat(delta.astype(bool), n), flat[pixels, d - 1].astype(np.float64), 0.0)
        capped = np.repeat((mode == PACKED) | ((mode == CONSTANT) & (delta > 0)), n)
        v = np.where(capped, np.minimum(v, z_max[d]), v).astype(a.dtype)
        whole = np.repeat(mode == RAW, n)
        if whole.any():
            at_ = (np.repeat(place - start * item, n) + np.arange(len(v)) * item)[whole]
            v[whole] = data[at_[:, None] + np.arange(item)].reshape(-1).view(a.dtype)
        flat[pixels, d] = v
    return at
