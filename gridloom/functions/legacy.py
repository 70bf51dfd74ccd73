"""The first-generation container, read only: 32-bit floats, a count part and a value part, both tiled."""

from __future__ import annotations

import struct

import numpy as np

from . import bits, runs
from .bits import Truncated

KEY = bytes.fromhex("436e745a496d61676520")
_HEAD = struct.Struct("<4id")
_PART = struct.Struct("<3if")
_SIZES = {0: 4, 1: 2, 2: 1}
_KINDS = {1: "<i1", 2: "<i2", 4: "<f4"}


def _offset(raw: bytes, at: int, form: int) -> tuple[np.float32, int]:
    size = _SIZES.get(form)
    if size is None or at + size > len(raw):
        raise Truncated("tile offset")
    return np.float32(np.frombuffer(raw, _KINDS[size], 1, at)[0]), at + size


def _block(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    if at >= len(raw):
        raise Truncated("block")
    head = raw[at]
    size = _SIZES.get(head >> 6)
    width = head & 63
    if size is None or width >= 32:
        raise Truncated("block")
    n = int.from_bytes(raw[at + 1 : at + 1 + size], "little")
    return bits.unpack(raw, at + 1 + size, n, width, modern=False)


def _tiles(rows: int, cols: int, n_down: int, n_across: int):
    """Tiles of equal size and, where the division leaves any, one more of the rest."""
    if not (0 < n_down <= rows and 0 < n_across <= cols):
        raise Truncated("tiling")
    cuts = lambda n, k: [(i * (n // k), (i + 1) * (n // k)) for i in range(k)] + ([(k * (n // k), n)] if n % k else [])
    for i0, i1 in cuts(rows, n_down):
        for j0, j1 in cuts(cols, n_across):
            yield i0, i1, j0, j1


def read_error(raw: bytes, at: int = 0) -> float:
    return _HEAD.unpack_from(raw, at + len(KEY))[4]


def decode_one(raw: bytes, at: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(values [row, col], mask, place behind). counts: those of the band before, for a band that has none of its own."""
    if raw[at : at + len(KEY)] != KEY or len(raw) < at + len(KEY) + _HEAD.size:
        raise Truncated("no blob begins here")
    version, kind, rows, cols, e = _HEAD.unpack_from(raw, at + len(KEY))
    if version != 11 or kind != 8 or not (0 < rows <= 40000 and 0 < cols <= 40000):
        raise Truncated("header")
    p = at + len(KEY) + _HEAD.size
    count, z = np.zeros((rows, cols), np.float32), np.zeros((rows, cols), np.float32)
    ignore = False
    for values in (False, True):
        if p + _PART.size > len(raw):
            raise Truncated("part")
        down, across, size, top = _PART.unpack_from(raw, p)
        p += _PART.size
        if size < 0 or p + size > len(raw):
            raise Truncated("part")
        part = raw[: p + size]
        if not values and down == 0 and across == 0:
            if size == 0:
                count[:], ignore = top, top > 0
            else:
                n = rows * cols
                count[:] = np.unpackbits(runs.expand(part, p, (n + 7) // 8))[:n].reshape(rows, cols)
        else:
            q = p
            for i0, i1, j0, j1 in _tiles(rows, cols, down, across):
                if q >= len(part):
                    raise Truncated("tile")
                box = np.s_[i0:i1, j0:j1]
                if values:
                    q = _read_values(part, q, z[box], count[box] > 0, e, np.float32(top), ignore)
                else:
                    q = _read_counts(part, q, count[box])
        p += size
    return np.where(count > 0, z, np.float32(0)), count > 0, p


def _read_counts(raw: bytes, at: int, out: np.ndarray) -> int:
    head, at = raw[at], at + 1
    if head in (2, 3, 4):
        out[:] = {2: 0, 3: -1, 4: 1}[head]
    elif head == 0:
        if at + 4 * out.size > len(raw):
            raise Truncated("counts")
        out[:] = np.frombuffer(raw, "<f4", out.size, at).reshape(out.shape)
        at += 4 * out.size
    elif head & 63 == 1:
        base, at = _offset(raw, at, head >> 6)
        q, at = _block(raw, at)
        if len(q) < out.size:
            raise Truncated("counts")
        out[:] = (base + q[: out.size].astype(np.float32)).reshape(out.shape)
    else:
        raise Truncated("count tile")
    return at


def _read_values(raw: bytes, at: int, out: np.ndarray, valid: np.ndarray, e: float, top: np.float32, ignore: bool) -> int:
    head, at = raw[at], at + 1
    mode, form = head & 63, head >> 6
    n = int(valid.sum())
    if mode == 2:
        out[valid] = 0
    elif mode == 0:
        if at + 4 * n > len(raw):
            raise Truncated("values")
        out[valid] = np.frombuffer(raw, "<f4", n, at)
        at += 4 * n
    elif mode in (1, 3):
        base, at = _offset(raw, at, form)
        if mode == 3:
            out[valid] = base
        else:
            q, at = _block(raw, at)
            place = np.ones_like(valid) if ignore else valid
            if len(q) < place.sum():
                raise Truncated("values")
            out[place] = np.minimum((float(base) + q[: place.sum()] * (2 * e)).astype(np.float32), top)
    else:
        raise Truncated("value tile")
    return at


def decode_all(raw: bytes, at: int = 0) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """All bands that follow each other, as (values, mask, place behind)."""
    out = []
    while raw[at : at + len(KEY)] == KEY:
        out.append(decode_one(raw, at))
        at = out[-1][2]
    if not out:
        raise Truncated("no blob begins here")
    return out
