"""All tiles at once against tiles one by one."""

from __future__ import annotations


import numpy as np
import pytest
import tile_reference as one

from gridloom.functions import bits, container, dtypes


def rasters(code, rng):
    d = dtypes.DTYPES[code]
    top = 250 if d.itemsize == 1 and d.kind == "u" else 120
    for shape in ((1, 1, 1), (8, 8, 1), (17, 35, 1), (40, 23, 3), (64, 64, 2)):
        smooth = (np.add.outer(np.arange(shape[0]), np.arange(shape[1])) % top)[:, :, None] + np.arange(shape[2])
        yield smooth.astype(d)
        yield rng.integers(0, top, shape).astype(d)
        yield (rng.integers(0, 3, shape) * (top // 3)).astype(d)
        yield np.where(rng.random(shape) < 0.9, 7, rng.integers(0, top, shape)).astype(d)
        yield np.zeros(shape, d)
        if d.kind == "f" or d.itemsize > 1:
            yield (rng.standard_normal(shape) * (1e4 if d.kind == "f" or d.itemsize == 2 else 1e8)).astype(d)
        if d.kind == "f":
            yield (rng.standard_normal(shape) * 1e30).astype(d)


@pytest.mark.parametrize("code", range(8))
@pytest.mark.parametrize("version", [2, 3, 4, 5, 6])
def test_tiles_are_those_of_one_by_one(code, version):
    rng = np.random.default_rng(code * 10 + version)
    integer = dtypes.is_integer(code)
    modes = set()
    for a in rasters(code, rng):
        if version < 4 and a.shape[2] > 1:
            continue
        masks = [np.ones(a.shape[:2], bool), rng.random(a.shape[:2]) < 0.7, rng.random(a.shape[:2]) < 0.05]
        for mask in masks:
            for e in ((0.5, 3.0) if integer else (0.0, 0.01, 0.7, 40.0)):
                for size in (8, 16):
                    h = container.Header(version, 0, *a.shape, n_valid=int(mask.sum()), block=size, dtype=code, max_error=e)
                    gaps = None if mask.all() else mask
                    want, parts = one.write_tiles(a, gaps, h, size)
                    got, (raw,) = container.write_tiles(a, gaps, h, size)
                    assert got == want == len(raw) and raw == b"".join(parts)
                    assert container.write_tiles(a, gaps, h, size, emit=False)[0] == want
                    modes |= {raw[0] & 3}
                    if not mask.any():
                        continue
                    limit = np.array([float(a[:, :, k][mask].max()) for k in range(a.shape[2])])
                    x, y = np.zeros_like(a), np.zeros_like(a)
                    assert one.read_tiles(raw, 0, x, mask, h, limit) == container.read_tiles(raw, 0, y, mask, h, limit) == len(raw)
                    assert x.tobytes() == y.tobytes()
                    if e < 1e3:
                        assert np.abs(x[mask].astype(float) - a[mask].astype(float)).max() <= e * (1 + 1e-6) + (0 if e else 0) + (np.abs(a[mask].astype(float)).max() * 1e-6 if not integer else 0)
    assert len(modes) > 1


@pytest.mark.parametrize("code", [1, 4, 6])
def test_damaged_tiles_are_refused_alike(code):
    rng = np.random.default_rng(code)
    a = rng.integers(0, 100, (24, 30, 2)).astype(dtypes.DTYPES[code])
    a[:8] //= 40
    mask = rng.random(a.shape[:2]) < 0.8
    h = container.Header(6, 0, *a.shape, n_valid=int(mask.sum()), block=8, dtype=code, max_error=0.5)
    _, (raw,) = container.write_tiles(a, mask, h, 8)
    for _ in range(300):
        bad = bytearray(raw[: rng.integers(1, len(raw) + 1)])
        for _ in range(rng.integers(0, 3)):
            bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
        outs = []
        for read in (one.read_tiles, container.read_tiles):
            out = np.zeros_like(a)
            try:
                with np.errstate(all="ignore"):
                    outs.append((read(bytes(bad), 0, out, mask, h, np.full(2, 1e9)), out.tobytes()))
            except bits.Truncated:
                outs.append("refused")
        assert outs[0] == outs[1]


def test_speed_of_a_band():
    """Seconds a megapixel, far below what a loop over tiles takes."""
    import time

    rng = np.random.default_rng(0)
    i, j = np.mgrid[:512, :512]
    a = (np.sqrt(i**2 + j**2) + rng.integers(0, 20, (512, 512))).astype("<f4")
    mask = (i % 100 != 0) & (j % 100 != 0)
    raw = container.encode(a, mask, 0.0999)
    t = time.perf_counter()
    raw = container.encode(a, mask, 0.0999)
    u = time.perf_counter()
    container.decode(raw)
    w = time.perf_counter()
    assert (u - t) * 4 < 1.0 and (w - u) * 4 < 1.0


@pytest.mark.parametrize("code", range(8))
@pytest.mark.parametrize("depth", [1, 3])
def test_plan_is_what_encode_makes(code, depth):
    rng = np.random.default_rng(code + depth)
    integer, d, forms = dtypes.is_integer(code), dtypes.DTYPES[code], set()
    smooth = (np.add.outer(np.arange(60), np.arange(70)) // 9 % 100)[:, :, None] + np.arange(depth)
    rasters_ = [smooth, rng.integers(0, 100, smooth.shape), np.full(smooth.shape, 5), np.where(rng.random(smooth.shape) < 0.97, 3, 90), np.minimum(rng.geometric(0.4, smooth.shape), 120)]
    if not integer:
        rasters_ += [smooth / 7.0, rng.standard_normal(smooth.shape)]
    for a in rasters_:
        for mask in (None, rng.random(a.shape[:2]) < 0.8, np.zeros(a.shape[:2], bool)):
            for e in (0.5, 2.0) if integer else (0.0, 0.01, 1.0):
                for version in (6,) if depth > 1 else (2, 3, 4, 6):
                    both = np.stack([a, a[::-1]]).astype(d)
                    raw = container.encode(both, mask, e, version=version)
                    plans = container.plan_encoding(both, mask, e, version=version)
                    assert sum(p.n_bytes for p in plans) == len(raw) == container.encoded_size(both, mask, e, version=version)
                    forms |= {p.form for p in plans}
    assert "header" in forms and ({"codes", "delta codes"} & forms if code < 2 else "tiles 8" in forms or "tiles 16" in forms)
