"""The binary container: arrays [band, row, col, depth] with a mask, every value within a stated error.

A blob is one sub-blob a band, each with its own header. Little-endian throughout. See :func:`encode`,
:func:`decode`, :func:`read_info`, :func:`read_ranges`.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np

from . import bits, dtypes, legacy, planes, prefix, runs, tiles
from .bits import Truncated

KEY = bytes.fromhex("4c6572633220")
LATEST = 6
RAW, PACKED, ZERO, CONSTANT = tiles.RAW, tiles.PACKED, tiles.ZERO, tiles.CONSTANT
TILES, DELTA_CODES, CODES, BYTE_PLANES = range(4)


class HasNoData(ValueError):
    """The blob mixes valid and no-data values in one pixel; ask for the no-data values as well."""


class NaNRefused(ValueError):
    """NaN beside valid depths needs a no-data value."""


@dataclass
class Header:
    version: int = LATEST
    checksum: int = 0
    n_rows: int = 0
    n_cols: int = 0
    n_depth: int = 1
    n_valid: int = 0
    block: int = 8
    size: int = 0
    dtype: int = 0
    more: int = 0
    no_data_used: bool = False
    all_int: bool = False
    max_error: float = 0.0
    z_min: float = 0.0
    z_max: float = 0.0
    no_data: float = 0.0
    no_data_orig: float = 0.0

    @property
    def codes_possible(self) -> bool:
        return self.version >= 2 and self.dtype <= dtypes.UINT8 and self.max_error == 0.5

    @property
    def planes_possible(self) -> bool:
        return self.version >= 6 and not dtypes.is_integer(self.dtype) and self.max_error == 0


def _layout(version: int) -> tuple[str, list[str]]:
    ints = ["n_rows", "n_cols", *["n_depth"] * (version >= 4), "n_valid", "block", "size", "dtype", *["more"] * (version >= 6)]
    flags = ["no_data_used", "all_int"] if version >= 6 else []
    reals = ["max_error", "z_min", "z_max", *["no_data", "no_data_orig"] * (version >= 6)]
    return f"<{len(ints)}i" + ("2?2x" if flags else "") + f"{len(reals)}d", ints + flags + reals


def header_size(version: int) -> int:
    return len(KEY) + 4 + 4 * (version >= 3) + struct.calcsize(_layout(version)[0])


def write_header(h: Header) -> bytes:
    form, names = _layout(h.version)
    return KEY + struct.pack("<i", h.version) + (struct.pack("<I", h.checksum) if h.version >= 3 else b"") + struct.pack(form, *(getattr(h, n) for n in names))


def read_header(raw: bytes, at: int = 0) -> tuple[Header, int]:
    """(header, place behind it)."""
    if raw[at : at + 6] != KEY or len(raw) < at + 10:
        raise Truncated("no blob begins here")
    (version,) = struct.unpack_from("<i", raw, at + 6)
    if not 0 <= version <= LATEST:
        raise Truncated(f"version {version}")
    form, names = _layout(version)
    end = at + header_size(version)
    if len(raw) < end:
        raise Truncated("header")
    h = Header(version, struct.unpack_from("<I", raw, at + 10)[0] if version >= 3 else 0)
    h = replace(h, **dict(zip(names, struct.unpack_from(form, raw, end - struct.calcsize(form)))))
    pixels = h.n_rows * h.n_cols
    sane = min(h.n_rows, h.n_cols, h.n_depth, h.block, h.size) > 0 and 0 <= h.n_valid <= pixels and 0 <= h.dtype <= 7 and h.block <= 32
    if not sane or pixels * h.n_depth * dtypes.DTYPES[h.dtype].itemsize > 2**31 - 1:
        raise Truncated("header with impossible numbers")
    return h, end


# ---- tiles -------------------------------------------------------------------------------------------

def top_quantum(z_min: float, z_max: float, e: float) -> float:
    """The range in quanta of 2e, as the decoder will see it."""
    return (z_max - z_min) * (1 / (2 * e))


def write_tiles(a: np.ndarray, mask: np.ndarray | None, h: Header, size: int, emit: bool = True) -> tuple[int, list[bytes]]:
    """(bytes, the bytes themselves if ``emit``)."""
    total, out = tiles.write(a, mask, size, h.dtype, h.max_error, h.version, emit)
    return total, [out]


def read_tiles(raw: bytes, at: int, a: np.ndarray, mask: np.ndarray, h: Header, z_max: np.ndarray) -> int:
    return tiles.read(raw, at, a, mask, h.block, h.dtype, h.max_error, h.version, z_max)


# ---- whole-band prefix codes ---------------------------------------------------------------------------

def neighbour_delta(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """8-bit values less the valid one to the left, else above, else the last valid one; valid pixels only, modulo 256."""
    left_ok, up_ok = np.zeros_like(mask), np.zeros_like(mask)
    left_ok[:, 1:], up_ok[1:] = mask[:, :-1], mask[:-1]
    left, up = np.zeros_like(a), np.zeros_like(a)
    left[:, 1:], up[1:] = a[:, :-1], a[:-1]
    valid = a[mask]
    last = np.concatenate([np.zeros(1, a.dtype), valid[:-1]])
    return valid - np.where(left_ok[mask], left[mask], np.where(up_ok[mask], up[mask], last))


def _undo_neighbour_delta(step: np.ndarray, mask: np.ndarray, dtype: np.dtype) -> np.ndarray:
    out = np.zeros(mask.shape, dtype)
    k, last = 0, 0
    for i in range(mask.shape[0]):
        row = mask[i]
        cols = np.flatnonzero(row)
        if not len(cols):
            continue
        v = step[k : k + len(cols)].astype(np.int64)
        k += len(cols)
        begins = np.concatenate([[True], np.diff(cols) > 1])
        first = np.flatnonzero(begins)
        for b, e in zip(first, np.append(first[1:], len(cols))):
            c = cols[b]
            base = int(out[i - 1, c]) if i and mask[i - 1, c] else last
            # a run of neighbours is a running sum
            out[i, cols[b:e]] = (base + np.cumsum(v[b:e])).astype(dtype)
            last = int(out[i, cols[e - 1]])
    return out


def _symbols(a: np.ndarray, mask: np.ndarray, delta: bool, signed: bool) -> np.ndarray:
    if delta:
        v = np.concatenate([neighbour_delta(a[:, :, d], mask) for d in range(a.shape[2])])
    else:
        v = a[mask].ravel()
    return v.astype(np.int64) + (128 if signed else 0)


def _code_plan(a: np.ndarray, mask: np.ndarray, h: Header) -> tuple[int, int, np.ndarray | None, np.ndarray | None]:
    """(bytes, mode, lengths, symbols) of the better code; on a tie the direct one."""
    best: tuple = (None, TILES, None, None)
    for mode in ([CODES] if h.version >= 4 else []) + [DELTA_CODES]:
        s = _symbols(a, mask, mode == DELTA_CODES, h.dtype == dtypes.INT8)
        histogram = np.bincount(s, minlength=256)
        lengths = prefix.code_lengths(histogram)
        if lengths is not None:
            size = prefix.table_bytes(lengths) + prefix.stream_bytes(lengths, histogram)
            if best[0] is None or size < best[0]:
                best = (size, mode, lengths, s)
    return best


# ---- one band ------------------------------------------------------------------------------------------

def raised_error(v: np.ndarray, e: float) -> float:
    """The largest error of the ladder 1/2, 1/4, 1/20 .. 1/20000 that costs the values nothing beyond e / 2 by rounding, else e."""
    for step, factor in zip((1, 0.5, 0.1, 0.05, 0.01, 0.005, 0.001, 0.0005, 0.0001), (1, 2, 10, 20, 100, 200, 1000, 2000, 10000)):
        if step / 2 > e:
            x = v.astype(np.float64) * factor
            if len(x) == 0 or np.abs(np.floor(x + 0.5) - x).max() / factor <= e / 2:
                return step / 2
    return e


def noise_error(a: np.ndarray, mask: np.ndarray, eps: float, least_pairs: int = 5000) -> float:
    """Half the value of the lowest bit plane worth keeping: planes that flip between neighbours like a coin are noise. 0 if that can't be told."""
    width = 8 * a.dtype.itemsize
    u = a.astype(np.int64)
    whole = a.shape[2] == 1 and mask.all()
    # without gaps, pairs are those of the pixels that have both a right and a lower neighbour
    right, down = mask[:, 1:] & mask[:, :-1], mask[1:] & mask[:-1]
    if whole:
        right, down = right[:-1], down[:, :-1]
    x, y = u[:, 1:] ^ u[:, :-1], u[1:] ^ u[:-1]
    x, y = (x[:-1][right], y[:, :-1][down]) if whole else (x[right], y[down])
    n = len(x) + len(y)
    if n < least_pairs:
        return 0.0
    flips = np.stack([((x >> s) & 1).sum(axis=0) + ((y >> s) & 1).sum(axis=0) for s in range(width)])
    return noise_cut((np.abs(1 - 2 * flips / n) < eps).all(axis=1))


def noise_cut(noisy: np.ndarray) -> float:
    """From the top plane down, the first noisy plane is the cut, unless the next noisy one lies apart from it, which then takes its place; two in a row end it."""
    found = kept = 0
    for s in range(len(noisy) - 1, -1, -1):
        if noisy[s] and found < 2:
            if found == 0:
                kept = s
            if found == 1 and s < kept - 1:
                kept, found = s, 0
            found += 1
    return float((1 << kept) >> 1)


@dataclass
class BandPlan:
    """What a band takes in each form (0: not possible or not tried), and the form chosen."""

    n_valid: int = 0
    max_error: float = 0.0
    mask_bytes: int = 0
    range_bytes: int = 0
    tiles_8: int = 0
    tiles_16: int = 0
    codes: int = 0
    planes: int = 0
    sweep: int = 0
    form: str = "header"
    n_bytes: int = 0


def encode_band(a: np.ndarray, mask: np.ndarray, max_error: float, h: Header, store_mask: bool, drop_noise_bits: float | None = None, plan: BandPlan | None = None) -> bytes:
    """One sub-blob. a: [row, col, depth] without NaN at valid pixels. With ``plan``, that is filled in and no bytes are made."""
    integer = dtypes.is_integer(h.dtype)
    n_valid, pixels = int(mask.sum()), mask.size
    every = n_valid == pixels
    if drop_noise_bits is not None:
        if not integer:
            raise ValueError("only integers have noise bits to drop")
        max_error = noise_error(a, mask, drop_noise_bits)
    e = max(0.5, float(np.floor(max_error))) if integer else max_error
    if not integer and e > 0 and n_valid:
        e = raised_error(a[mask].ravel(), e)
    h = replace(h, max_error=e, n_valid=n_valid, z_min=0.0, z_max=0.0, block=8)
    stored = 0 < n_valid < pixels and store_mask
    if plan is not None:
        plan.n_valid, plan.max_error = n_valid, e
        plan.mask_bytes = 4 + (runs.squeezed_size(np.packbits(mask.ravel())) if stored else 0)
    raw_mask = runs.squeeze(np.packbits(mask.ravel())) if stored and plan is None else b""
    body = [struct.pack("<i", len(raw_mask)) + raw_mask]
    if n_valid:
        values = a[mask]
        low, high = values.min(axis=0), values.max(axis=0)
        h = replace(h, z_min=float(low.min()), z_max=float(high.max()))
        if h.z_min != h.z_max:
            if h.version >= 4:
                body.append(low.astype(a.dtype).tobytes() + high.astype(a.dtype).tobytes())
                if plan is not None:
                    plan.range_bytes = len(body[-1])
            if h.version < 4 or (low != high).any():
                h, data = _encode_values(a, mask, None if every else mask, values, h, plan)
                body += data
    if plan is not None:
        plan.n_bytes += header_size(h.version) + plan.mask_bytes + plan.range_bytes
        return b""
    return _sealed(h, b"".join(body))


def _encode_values(a: np.ndarray, mask: np.ndarray, gaps: np.ndarray | None, values: np.ndarray, h: Header, plan: BandPlan | None) -> tuple[Header, list[bytes]]:
    emit, wide = plan is None, 0
    tiling, parts = write_tiles(a, gaps, h, 8, emit)
    mode, size, other, lengths, symbols, coded = TILES, tiling, 0, None, None, b""
    if h.codes_possible:
        found, code_mode, lengths, symbols = _code_plan(a, mask, h)
        other = found or 0
        if found is not None and found < tiling:
            mode, size = code_mode, found
    elif h.planes_possible:
        coded = planes.encode(np.where(mask[:, :, None], a, a.dtype.type(0)))
        other = len(coded)
        if other < tiling * 0.9:
            mode, size = BYTE_PLANES, other
    sweep = values.size * a.dtype.itemsize
    if tiling * 8 < mask.size * h.n_depth * 1.5 and tiling < 4 * sweep and (other == 0 or tiling < 2 * other) and max(h.n_rows, h.n_cols) > 8:
        wide, wide_parts = write_tiles(a, gaps, h, 16, emit)
        if wide <= size:
            mode, size, parts, h = TILES, wide, wide_parts, replace(h, block=16)
    flagged = h.codes_possible or h.planes_possible
    if plan is not None:
        plan.tiles_8, plan.tiles_16, plan.sweep = tiling, wide, sweep
        plan.codes, plan.planes = (other, 0) if h.codes_possible else (0, other)
        swept = sweep <= size + flagged
        plan.form = "sweep" if swept else (f"tiles {h.block}", "delta codes", "codes", "byte planes")[mode]
        plan.n_bytes = 1 + (sweep if swept else size + flagged)
        return h, []
    if sweep <= size + flagged:
        return h, [b"\x01", values.tobytes()]
    if mode == BYTE_PLANES:
        parts = [coded]
    elif mode != TILES:
        codes = prefix.canonical(lengths)
        parts = [prefix.write_table(lengths, codes, h.version >= 3), prefix.write_stream(symbols, lengths, codes)]
    return h, [b"\0", *([bytes([mode])] if flagged else []), *parts]


def _sealed(h: Header, body: bytes) -> bytes:
    h = replace(h, size=header_size(h.version) + len(body))
    if h.size > 2**31 - 1:
        raise OverflowError("a band's blob is more than 2 GB")
    raw = write_header(h) + body
    if h.version >= 3:
        raw = write_header(replace(h, checksum=bits.checksum(raw[14:]))) + body
    return raw


def decode_band(raw: bytes, at: int, before: np.ndarray | None) -> tuple[Header, np.ndarray, np.ndarray, int]:
    """(header, values [row, col, depth], mask, place behind it). before: the mask of the band before, for blobs that reuse it."""
    h, p = read_header(raw, at)
    end = at + h.size
    if end > len(raw):
        raise Truncated("blob")
    if h.version >= 3 and bits.checksum(raw[at + 14 : end]) != h.checksum:
        raise Truncated("checksum")
    raw = raw[:end]
    mask, p = _read_mask(raw, p, h, before)
    dtype = dtypes.DTYPES[h.dtype]
    a = np.zeros((h.n_rows, h.n_cols, h.n_depth), dtype)
    if h.n_valid == 0:
        return h, a, mask, end
    if h.z_min == h.z_max:
        a[mask] = dtype.type(h.z_min)
        return h, a, mask, end
    low = high = np.array([h.z_min] * h.n_depth), np.array([h.z_max] * h.n_depth)
    low, high = low
    if h.version >= 4:
        low, high, p = _read_ranges(raw, p, h)
        if (low == high).all():
            a[mask] = low.astype(dtype)
            return h, a, mask, end
        low, high = low.astype(np.float64), high.astype(np.float64)
    if p >= len(raw):
        raise Truncated("data")
    if raw[p]:
        n = h.n_valid * h.n_depth
        if p + 1 + n * dtype.itemsize > len(raw):
            raise Truncated("values")
        a[mask] = np.frombuffer(raw, dtype, n, p + 1).reshape(h.n_valid, h.n_depth)
        return h, a, mask, end
    p += 1
    mode = TILES
    if h.codes_possible or h.planes_possible:
        mode, p = (raw[p] if p < len(raw) else 255), p + 1
    limit = high if h.version >= 4 and h.n_depth > 1 else np.full(h.n_depth, h.z_max)
    if mode == TILES:
        read_tiles(raw, p, a, mask, h, limit)
    elif mode in (DELTA_CODES, CODES) and h.codes_possible:
        lengths, codes, p = prefix.read_table(raw, p, h.version >= 3)
        symbols, _ = prefix.read_stream(raw, p, h.n_valid * h.n_depth, lengths, codes)
        v = (symbols - (128 if h.dtype == dtypes.INT8 else 0)).astype(dtype)
        if mode == CODES:
            a[mask] = v.reshape(h.n_valid, h.n_depth)
        else:
            for d in range(h.n_depth):
                a[:, :, d] = _undo_neighbour_delta(v[d * h.n_valid : (d + 1) * h.n_valid], mask, dtype)
    elif mode == BYTE_PLANES and h.planes_possible:
        a, _ = planes.decode(raw, p, a.shape, dtype)
        a = np.where(mask[:, :, None], a, dtype.type(0))
    else:
        raise Truncated("mode")
    return h, a, mask, end


def _read_mask(raw: bytes, p: int, h: Header, before: np.ndarray | None) -> tuple[np.ndarray, int]:
    if p + 4 > len(raw):
        raise Truncated("mask")
    (n,) = struct.unpack_from("<i", raw, p)
    pixels, shape = h.n_rows * h.n_cols, (h.n_rows, h.n_cols)
    if n < 0 or (n and h.n_valid in (0, pixels)) or p + 4 + n > len(raw):
        raise Truncated("mask")
    if h.n_valid in (0, pixels):
        mask = np.full(shape, h.n_valid > 0)
    elif n:
        mask = np.unpackbits(runs.expand(raw[: p + 4 + n], p + 4, (pixels + 7) // 8))[:pixels].astype(bool).reshape(shape)
    elif before is not None and before.shape == shape:
        mask = before
    else:
        raise Truncated("mask of the band before")
    if int(mask.sum()) != h.n_valid:
        raise Truncated("mask")
    return mask, p + 4 + n


def _read_ranges(raw: bytes, p: int, h: Header) -> tuple[np.ndarray, np.ndarray, int]:
    dtype = dtypes.DTYPES[h.dtype]
    if p + 2 * h.n_depth * dtype.itemsize > len(raw):
        raise Truncated("ranges")
    both = np.frombuffer(raw, dtype, 2 * h.n_depth, p)
    return both[: h.n_depth], both[h.n_depth :], p + 2 * h.n_depth * dtype.itemsize


# ---- validity before encoding --------------------------------------------------------------------------

@dataclass
class Cleaned:
    values: np.ndarray
    mask: np.ndarray
    max_error: float
    mixed: bool = False
    no_data: float = 0.0
    all_int: bool = False


def new_no_data(low: float, e: float, all_int: bool, code: int) -> float | None:
    """A stand-in for the no-data value just below the valid minimum: the highest candidate that keeps a distance of 2e."""
    distances = [4 * e, *([] if all_int else [1e-4, 1e-3, 1e-2, 1e-1]), 1, 10, 100, 1000, 10000]
    half = low / 2 if low > 0 else low * 2
    to = dtypes.DTYPES[code].type
    bottom = dtypes.value_range(code)[0] if not all_int or dtypes.is_integer(code) else -float(1 << (23 if code == dtypes.FLOAT32 else 53))
    candidates = [low - d for d in distances] + [np.floor(half) if all_int else half]
    bound = low - 2 * e
    fits = [float(to(c)) for c in candidates if dtypes.is_integer(code) and c > bottom or not dtypes.is_integer(code)] if True else []
    for c in sorted(fits, reverse=True):
        if c > bottom and c < (bound if dtypes.is_integer(code) else float(to(bound))) and (not all_int or c == np.floor(c)):
            return c
    return None


def clean(a: np.ndarray, mask: np.ndarray, e: float, no_data: float | None, version: int) -> Cleaned:
    """Move NaN and no-data values into the mask where a whole pixel has none else; settle how the rest is kept."""
    code = dtypes.code_of(a.dtype)
    integer = dtypes.is_integer(code)
    a, mask, n_depth = a.copy(), mask.copy(), a.shape[2]
    if integer and no_data is None:
        return Cleaned(a, mask, e)
    if no_data is not None:
        low, high = dtypes.value_range(code)
        if not low <= no_data <= high:
            raise ValueError(f"no-data value {no_data} is outside of {dtypes.NAMES[code]}")
        no_data = float(a.dtype.type(no_data))
    nan = np.zeros(a.shape, bool) if integer else np.isnan(a)
    bad = (nan | (a == no_data) if no_data is not None else nan) & mask[:, :, None]
    n_bad = bad.sum(axis=2)
    has_nan = bool((nan & mask[:, :, None]).any())
    mixed = bool(((n_bad > 0) & (n_bad < n_depth)).any())
    mask &= n_bad < n_depth
    stand_in = no_data if no_data is not None else dtypes.value_range(code)[0]
    if version <= 5:
        a[nan] = stand_in if n_depth > 1 else 0
        return Cleaned(a, mask, e)
    if mixed and has_nan and no_data is None:
        raise NaNRefused("NaN beside valid depths of a pixel, and no no-data value given")
    a[nan] = stand_in if mixed else 0
    good = a[mask[:, :, None] & ~bad]
    if not good.size:
        return Cleaned(a, mask, 0.5 if integer else 0.0)
    low, high = float(good.min()), float(good.max())
    if integer:
        all_int, e = True, max(0.5, float(np.floor(e)))
    else:
        most = float(1 << (23 if code == dtypes.FLOAT32 else 53))
        all_int = bool((good == np.floor(good)).all()) and -most <= low and high <= most
        if mixed:
            all_int = all_int and float(stand_in).is_integer() and abs(stand_in) <= most
        e = max(0.5, float(np.floor(e))) if all_int else e
    if e == 0:
        return Cleaned(a, mask, e, mixed, stand_in, all_int)
    lossless = 0.5 if all_int else 0.0
    if no_data is not None:
        apart = np.floor(e) if all_int else 2 * e
        if low - apart <= no_data <= high + apart:
            return Cleaned(a, mask, lossless, mixed, stand_in, all_int)
    if mixed:
        other = new_no_data(low, e, all_int, code)
        if other is not None:
            a[bad] = other
            stand_in = other
        elif stand_in >= low:
            e = lossless
    return Cleaned(a, mask, e, mixed, stand_in, all_int and not integer)


# ---- blobs ---------------------------------------------------------------------------------------------

def as_four(values: np.ndarray) -> np.ndarray:
    """[row, col] or [band, row, col] or [band, row, col, depth] as the last."""
    v = np.asarray(values)
    if v.ndim == 2:
        return v[None, :, :, None]
    if v.ndim == 3:
        return v[:, :, :, None]
    if v.ndim != 4 or not v.size:
        raise ValueError(f"array of shape {v.shape}")
    return v


def encode(values: np.ndarray, mask: np.ndarray | None = None, max_error: float = 0.0, *, no_data: list[float | None] | None = None, version: int = LATEST, drop_noise_bits: float | None = None) -> bytes:
    """values [band, row, col, depth] as a blob whose decoded values differ by ``max_error`` at most.

    mask: None, [row, col] for all bands, or [band, row, col]. no_data: one value or None for each band.
    version: 2 to 6. drop_noise_bits: for integers, choose the error so that bit planes of noise go.
    NaN and no-data values become invalid where all depths of a pixel are; where only some are, version 6
    keeps them by the no-data value and earlier ones replace NaN by the type's lowest value.
    """
    out = [encode_band(c.values, c.mask, c.max_error, h, store, drop_noise_bits) for c, h, store in _prepared(values, mask, max_error, no_data, version)]
    raw = b"".join(out)
    if len(raw) > 2**32 - 1:
        raise OverflowError("the blob is more than 4 GB")
    return raw


def plan_encoding(values: np.ndarray, mask: np.ndarray | None = None, max_error: float = 0.0, *, no_data: list[float | None] | None = None, version: int = LATEST, drop_noise_bits: float | None = None) -> list[BandPlan]:
    """What :func:`encode` would choose for each band and the bytes it would take, without making them."""
    plans = []
    for c, h, store in _prepared(values, mask, max_error, no_data, version):
        plans.append(BandPlan())
        encode_band(c.values, c.mask, c.max_error, h, store, drop_noise_bits, plans[-1])
    return plans


def encoded_size(values: np.ndarray, mask: np.ndarray | None = None, max_error: float = 0.0, **options: object) -> int:
    """Bytes that :func:`encode` takes, without making them."""
    return sum(p.n_bytes for p in plan_encoding(values, mask, max_error, **options))


def _prepared(values: np.ndarray, mask: np.ndarray | None, max_error: float, no_data: list[float | None] | None, version: int):
    """(cleaned band, header, whether its mask is stored) of each band."""
    a = as_four(values)
    code = dtypes.code_of(a.dtype)
    a = a.astype(dtypes.DTYPES[code], copy=False)
    n_bands, n_rows, n_cols, n_depth = a.shape
    version = LATEST if version == -1 else version
    if not 2 <= version <= LATEST or (version < 4 and n_depth > 1):
        raise ValueError(f"version {version} for depth {n_depth}")
    if max_error < 0 or np.isnan(max_error):
        raise ValueError(f"max_error {max_error}")
    if no_data is not None and (len(no_data) != n_bands or (version < 6 and any(x is not None for x in no_data))):
        raise ValueError("no_data needs version 6 and an entry for each band")
    if n_rows * n_cols * n_depth * a.dtype.itemsize > 2**31 - 1:
        raise OverflowError("a band is more than 2 GB")
    masks = np.ones((n_bands, n_rows, n_cols), bool) if mask is None else np.broadcast_to(np.asarray(mask, bool), (n_bands, n_rows, n_cols))
    before = None
    for k in range(n_bands):
        c = clean(a[k], masks[k], max_error, no_data[k] if no_data else None, version)
        store = before is None or not np.array_equal(before, c.mask)
        given = no_data[k] if no_data and no_data[k] is not None else 0.0
        h = Header(version, 0, n_rows, n_cols, n_depth, dtype=code, more=n_bands - 1 - k, no_data_used=c.mixed, all_int=c.all_int)
        if c.mixed:
            h = replace(h, no_data=c.no_data, no_data_orig=float(given) if no_data and no_data[k] is not None else c.no_data)
        yield c, h, store
        before = c.mask


def bands(raw: bytes, at: int = 0):
    """(header, place) of each sub-blob. Version 6 says how many follow; before it, whatever begins like one does."""
    while True:
        h, _ = read_header(raw, at)
        yield h, at
        at += h.size
        if h.version >= 6:
            if h.more <= 0:
                return
        elif raw[at : at + 6] != KEY:
            return


@dataclass
class Info:
    version: int
    dtype: int
    n_depth: int
    n_cols: int
    n_rows: int
    n_bands: int
    n_valid: int
    blob_size: int
    n_masks: int
    uses_no_data: int
    z_min: float
    z_max: float
    max_z_error: float
    ranges: list[tuple[int, int, float, float]] = field(default_factory=list)


def read_info(raw: bytes, at: int = 0) -> Info:
    """What the headers tell, without decoding. The range is -1, -1 where no-data values are mixed in."""
    if raw[at : at + len(legacy.KEY)] == legacy.KEY:
        found = legacy.decode_all(raw, at)
        every = [a[m] for a, m, _ in found if m.any()]
        n_masks = 0 if all(m.all() for _, m, _ in found) else 1 if all(np.array_equal(m, found[0][1]) for _, m, _ in found) else len(found)
        rows, cols = found[0][0].shape
        return Info(1, dtypes.FLOAT32, 1, cols, rows, len(found), int(found[-1][1].sum()), found[-1][2] - at, n_masks, 0, float(min((x.min() for x in every), default=0)), float(max((x.max() for x in every), default=0)), legacy.read_error(raw, at))
    hs = list(bands(raw, at))
    h0 = hs[0][0]
    if any((h.n_rows, h.n_cols, h.n_depth, h.dtype) != (h0.n_rows, h0.n_cols, h0.n_depth, h0.dtype) for h, _ in hs):
        raise Truncated("bands that differ in shape")
    pixels = h0.n_rows * h0.n_cols
    stored = sum(int.from_bytes(raw[p + header_size(h.version) : p + header_size(h.version) + 4], "little") > 0 for h, p in hs)
    part = any(0 < h.n_valid < pixels for h, _ in hs)
    differ = stored > 1 or len({h.n_valid for h, _ in hs}) > 1
    n_masks = (len(hs) if differ else 1) if part or any(h.n_valid == 0 for h, _ in hs) else 0
    used = any(h.no_data_used for h, _ in hs)
    low, high = (-1.0, -1.0) if used else (min(h.z_min for h, _ in hs), max(h.z_max for h, _ in hs))
    return Info(h0.version, h0.dtype, h0.n_depth, h0.n_cols, h0.n_rows, len(hs), h0.n_valid, sum(h.size for h, _ in hs), n_masks, int(used) * len(hs), low, high, max(h.max_error for h, _ in hs))


def read_ranges(raw: bytes, at: int = 0) -> list[tuple[int, int, float, float]]:
    """(band, depth, min, max) from the headers and range vectors."""
    out = []
    for k, (h, p) in enumerate(bands(raw, at)):
        if h.no_data_used:
            raise HasNoData("ranges of a band with mixed no-data values")
        low, high = [h.z_min] * h.n_depth, [h.z_max] * h.n_depth
        if h.n_valid and h.z_min != h.z_max and h.version >= 4 and h.n_depth > 1:
            q = p + header_size(h.version)
            (n,) = struct.unpack_from("<i", raw, q)
            a, b, _ = _read_ranges(raw, q + 4 + n, h)
            low, high = a.tolist(), b.tolist()
        out += [(k, d, float(low[d]), float(high[d])) for d in range(h.n_depth)]
    return out


@dataclass
class Decoded:
    values: np.ndarray
    mask: np.ndarray
    no_data: list[float | None]


def decode(raw: bytes, at: int = 0, *, allow_no_data: bool = True) -> Decoded:
    """Values [band, row, col, depth] (0 where invalid), masks [band, row, col], and no-data values of bands that use them."""
    if raw[at : at + len(legacy.KEY)] == legacy.KEY:
        found = legacy.decode_all(raw, at)
        return Decoded(np.stack([a[:, :, None] for a, _, _ in found]), np.stack([m for _, m, _ in found]), [None] * len(found))
    values, masks, none = [], [], []
    before = None
    for h, p in list(bands(raw, at)):
        if h.no_data_used and not allow_no_data:
            raise HasNoData("the blob mixes valid and no-data values")
        h, a, before, _ = decode_band(raw, p, before)
        if h.no_data_used:
            if h.no_data != h.no_data_orig:
                a[(a == a.dtype.type(h.no_data)) & before[:, :, None]] = a.dtype.type(h.no_data_orig)
        none.append(h.no_data_orig if h.no_data_used else None)
        values.append(a)
        masks.append(before)
    return Decoded(np.stack(values), np.stack(masks), none)
