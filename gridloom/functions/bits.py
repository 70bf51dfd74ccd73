"""Integers of few bits, packed; the two block forms (plain and table) around them."""

from __future__ import annotations

import numpy as np


class Truncated(ValueError):
    """The bytes end too early or contradict themselves."""


def width_of(top: int) -> int:
    """Bits that ``top`` needs; 0 for 0."""
    return int(top).bit_length()


def count_bytes(n: int) -> int:
    return 1 if n < 1 << 8 else 2 if n < 1 << 16 else 4


def packed_bytes(n: int, width: int) -> int:
    return (n * width + 7) >> 3


def pack(values: np.ndarray, width: int, modern: bool = True) -> bytes:
    """``modern``: one stream, low bits first. Else words of 32 bits are filled from the top, the last one moved down to the bytes that it needs."""
    v = np.asarray(values, dtype=np.uint64)
    if width == 0 or not len(v):
        return b""
    shifts = np.arange(width, dtype=np.uint64)
    if modern:
        return np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
    stream = np.packbits(((v[:, None] >> shifts[::-1]) & np.uint64(1)).astype(np.uint8).ravel())
    spare = -len(stream) % 4
    words = np.concatenate([stream, np.zeros(spare, np.uint8)]).reshape(-1, 4)[:, ::-1].copy()
    flat = words.tobytes()
    # little-endian, the spare low bytes of the last word are its first ones
    return flat[:-4] + flat[-4:][spare:]


def unpack(raw: bytes, at: int, n: int, width: int, modern: bool = True) -> tuple[np.ndarray, int]:
    """(values, place behind them)."""
    if width == 0 or n == 0:
        return np.zeros(n, np.uint32), at
    size = packed_bytes(n, width)
    if at + size > len(raw):
        raise Truncated("packed values")
    b = np.frombuffer(raw, np.uint8, size, at)
    if modern:
        bits = np.unpackbits(b, bitorder="little")[: n * width].reshape(n, width).astype(np.uint64)
        weight = np.uint64(1) << np.arange(width, dtype=np.uint64)
    else:
        spare = -size % 4
        whole = np.concatenate([b[: size - (4 - spare)], np.zeros(spare, np.uint8), b[size - (4 - spare) :]]).reshape(-1, 4)[:, ::-1]
        bits = np.unpackbits(np.ascontiguousarray(whole).ravel())[: n * width].reshape(n, width).astype(np.uint64)
        weight = np.uint64(1) << np.arange(width, dtype=np.uint64)[::-1]
    return (bits * weight).sum(axis=1, dtype=np.uint64).astype(np.uint32), at + size


def _put_count(n: int) -> tuple[int, bytes]:
    size = count_bytes(n)
    return (0 if size == 4 else 3 - size) << 6, n.to_bytes(size, "little")


def plain_size(n: int, top: int) -> int:
    return 1 + count_bytes(n) + packed_bytes(n, width_of(top))


def plain_block(values: np.ndarray, modern: bool = True) -> bytes:
    width = width_of(int(values.max()))
    form, count = _put_count(len(values))
    return bytes([form | width]) + count + pack(values, width, modern)


def table_size(n: int, distinct: int, top: int) -> int:
    """distinct: values other than the 0 that every table implies."""
    return 2 + count_bytes(n) + packed_bytes(distinct, width_of(top)) + packed_bytes(n, width_of(distinct))


def table_block(values: np.ndarray, modern: bool = True) -> bytes:
    table, index = np.unique(values, return_inverse=True)
    if table[0] != 0 or not 1 <= len(table) - 1 < 255:
        raise ValueError("a table holds 0 and 1 to 254 other values")
    width = width_of(int(table[-1]))
    form, count = _put_count(len(values))
    return bytes([form | 32 | width]) + count + bytes([len(table)]) + pack(table[1:], width, modern) + pack(index, width_of(len(table) - 1), modern)


def read_block(raw: bytes, at: int, most: int, modern: bool = True) -> tuple[np.ndarray, int]:
    """Either form. most: values that there can be."""
    if at >= len(raw):
        raise Truncated("block")
    head = raw[at]
    size = 4 if head >> 6 == 0 else 3 - (head >> 6)
    n, width, at = int.from_bytes(raw[at + 1 : at + 1 + size], "little"), head & 31, at + 1 + size
    if size < 1 or n > most:
        raise Truncated("count of a block")
    if not head & 32:
        return unpack(raw, at, n, width, modern)
    if at >= len(raw):
        raise Truncated("table")
    distinct = raw[at] - 1
    if width == 0 or distinct < 1:
        raise Truncated("table")
    table, at = unpack(raw, at + 1, distinct, width, modern)
    index, at = unpack(raw, at, n, width_of(distinct), modern)
    if len(index) and index.max() > distinct:
        raise Truncated("table index")
    return np.concatenate([np.zeros(1, np.uint32), table])[index], at


def checksum(raw: bytes) -> int:
    """Two running sums of big-endian 16-bit words modulo 65535, by their closed form."""
    b = np.frombuffer(raw + b"\0" * (len(raw) % 2), ">u2").astype(object if len(raw) > 1 << 30 else np.uint64)
    n = len(b)
    low = int(b.sum()) if n else 0
    high = sum(int((b[i : i + (1 << 20)] * (np.uint64(n - i) - np.arange(len(b[i : i + (1 << 20)]), dtype=np.uint64))).sum() % np.uint64(65535)) for i in range(0, n, 1 << 20)) if n else 0
    fold = lambda x: x % 65535 or 65535
    return fold(high) << 16 | fold(low)
