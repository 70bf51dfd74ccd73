"""Encoding and decoding as DataFrame operators: a raster is the unit of work, and each crosses to Python once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import container, dtypes

HEADER = "version int, dtype int, n_depth int, n_cols int, n_rows int, n_bands int, n_valid long, blob_size long, n_masks int, uses_no_data int, z_min double, z_max double, max_z_error double"
HEADER_FIELDS = [x.split()[0] for x in HEADER.split(", ")]
PIXELS = "raster_id string, band int, row int, col int, depth int, value double, valid boolean"


def header_row(raw: bytes) -> list:
    i = container.read_info(raw)
    return [getattr(i, f) for f in HEADER_FIELDS]


def grid_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(values, valid) [band, row, col, depth] of a raster's pixels; absent ones are invalid. The extent is that of the largest indices."""
    at = [t.column(c).to_numpy() for c in ("band", "row", "col", "depth")]
    if any(len(x) and x.min() < 0 for x in at):
        raise ValueError("a pixel with a negative index")
    shape = tuple(int(x.max()) + 1 for x in at)
    if np.prod([float(s) for s in shape]) > 2**28:
        raise OverflowError(f"a raster of shape {shape} is too large for one value")
    values, valid = np.zeros(shape), np.zeros(shape, bool)
    v = t.column("value").to_numpy()
    ok = t.column("valid").to_numpy(zero_copy_only=False).astype(bool) & ~np.isnan(v)
    values[tuple(at)] = np.where(ok, v, 0)
    valid[tuple(at)] = ok
    return values, valid


def encode_pixels(pix: DataFrame, code: int, max_error: float = 0.0, *, no_data: float | None = None, version: int = container.LATEST, drop_noise_bits: float | None = None) -> DataFrame:
    """Pixels -> (raster_id, blob), one for each raster.

    Rows and columns count from 0, so sparse ids should be made dense before. Depths of a pixel that are
    absent or invalid while others are valid take ``no_data``, which is then needed. NaN and null are invalid.
    """
    dtype = dtypes.DTYPES[code]

    def run(t: pa.Table) -> pa.Table:
        values, any_valid, given = _filled(t, no_data)
        blob = container.encode(values.astype(dtype), any_valid, max_error, no_data=given, version=version, drop_noise_bits=drop_noise_bits)
        return pa.table({"raster_id": pa.array([t.column("raster_id")[0].as_py()], pa.string()), "blob": pa.array([blob], pa.binary())})

    return _by_raster(pix).applyInArrow(run, "raster_id string, blob binary")


PLAN = "raster_id string, band int, n_valid long, max_error double, mask_bytes long, range_bytes long, tiles_8 long, tiles_16 long, codes long, planes long, sweep long, form string, n_bytes long"
PLAN_FIELDS = [x.split()[0] for x in PLAN.split(", ")][2:]


def plan_bands(pix: DataFrame, code: int, max_error: float = 0.0, *, no_data: float | None = None, version: int = container.LATEST) -> DataFrame:
    """Pixels -> by raster and band, the bytes in each form, the form chosen and the bytes in all (those of :func:`encode_pixels`), without encoding."""
    dtype = dtypes.DTYPES[code]

    def run(t: pa.Table) -> pa.Table:
        values, any_valid, given = _filled(t, no_data)
        plans = container.plan_encoding(values.astype(dtype), any_valid, max_error, no_data=given, version=version)
        name = t.column("raster_id")[0].as_py()
        return pa.Table.from_pylist([{"raster_id": name, "band": k, **{f: getattr(p, f) for f in PLAN_FIELDS}} for k, p in enumerate(plans)], schema=_PLAN_ARROW)

    return _by_raster(pix).applyInArrow(run, PLAN)


_PLAN_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in PLAN.split(", ")])


def _by_raster(pix: DataFrame):  # noqa: ANN202
    cols = [F.coalesce("value", F.lit(float("nan"))).alias("value") if c == "value" else c for c in ("raster_id", "band", "row", "col", "depth", "value", "valid")]
    return pix.select(*cols).groupBy("raster_id")


def _filled(t: pa.Table, no_data: float | None) -> tuple[np.ndarray, np.ndarray, list[float] | None]:
    """(values with ``no_data`` at invalid depths of valid pixels, valid pixels, no-data value by band) of a raster's pixels."""
    values, valid = grid_of(t)
    any_valid = valid.any(axis=3)
    part = any_valid[..., None] & ~valid
    if part.any():
        if no_data is None:
            raise ValueError("depths of a pixel differ in validity and no no-data value is given")
        values[part] = no_data
    return values, any_valid, [no_data] * len(values) if no_data is not None else None


def encode_arrays(rasters: DataFrame, max_error: float = 0.0, *, version: int = container.LATEST, size_only: bool = False, check: bool = False) -> DataFrame:
    """Rows (raster_id, n_bands, n_rows, n_cols, n_depth, dtype, values, valid, no_data) -> raster_id and blob, or n_bytes with ``size_only``.

    values: array<double>, band after band, depths innermost. valid: array<boolean> of a band's pixels or of
    all bands', or null. no_data: array<double> with an entry for each band, or null. ``check`` decodes again
    and fails if a value is off by more than the bound (a tenth more for floats).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = []
            for r in b.to_pylist():
                dtype = dtypes.DTYPES[r["dtype"]]
                shape = (r["n_bands"], r["n_rows"], r["n_cols"], r["n_depth"])
                a = np.array([np.nan if x is None else x for x in r["values"]]).reshape(shape).astype(dtype)
                mask = None if r["valid"] is None else np.array(r["valid"], bool).reshape(-1, *shape[1:3])
                mask = mask[0] if mask is not None and len(mask) == 1 else mask
                if size_only:
                    blobs.append(container.encoded_size(a, mask, max_error, no_data=r["no_data"], version=version))
                    continue
                blob = container.encode(a, mask, max_error, no_data=r["no_data"], version=version)
                if check:
                    verify(a, blob, max_error)
                blobs.append(blob)
            out = pa.array(blobs, pa.int64()) if size_only else pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["raster_id", "n_bytes" if size_only else "blob"])

    cols = ["raster_id", "n_bands", "n_rows", "n_cols", "n_depth", "dtype", "values", "valid", "no_data"]
    return rasters.select(*cols).mapInArrow(run, "raster_id string, " + ("n_bytes long" if size_only else "blob binary"))


def verify(a: np.ndarray, blob: bytes, max_error: float) -> None:
    """Raise unless the blob decodes to ``a`` within the bound."""
    d = container.decode(blob)
    e = max(0.5, np.floor(max_error)) if a.dtype.kind in "iu" else max_error
    e = 0.0 if e == 0.5 and a.dtype.kind in "iu" else e * (1.0 if a.dtype.kind in "iu" else 1.1)
    ok = d.mask[..., None] & ~np.isnan(a.astype(np.float64))
    diff = np.abs(a.astype(np.float64) - d.values.astype(np.float64))[ok]
    if diff.size and diff.max() > max(e, 0.5 if max_error >= 0.5 and (a == np.floor(a)).all() else e):
        raise ValueError(f"a value is off by {diff.max()}, the bound is {max_error}")


def decode_pixels(blobs: DataFrame, *, only_valid: bool = False, first_band: int = 0, n_bands: int | None = None, strict: bool = True) -> DataFrame:
    """(raster_id, blob) -> pixels as doubles; no-data values of mixed pixels come out invalid.

    With ``strict`` off, a blob that can't be read gives no rows. Works on streams as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    d = container.decode(raw)
                except ValueError:
                    if strict:
                        raise
                    continue
                for k in range(first_band, min(len(d.values), first_band + n_bands if n_bands is not None else len(d.values))):
                    yield from _band_rows(rid, k, d, only_valid)

    return blobs.select("raster_id", "blob").mapInArrow(run, PIXELS)


def _band_rows(rid: str, k: int, d: container.Decoded, only_valid: bool, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    a = d.values[k].astype(np.float64)
    ok = np.repeat(d.mask[k][..., None], a.shape[2], axis=2)
    if d.no_data[k] is not None:
        ok &= d.values[k] != d.values.dtype.type(d.no_data[k])
    place = np.flatnonzero(ok.ravel()) if only_valid else np.arange(a.size)
    for i in range(0, len(place), step):
        p = place[i : i + step]
        row, col, depth = np.unravel_index(p, a.shape)
        flat_ok = ok.ravel()[p]
        cols = [pa.array([rid] * len(p), pa.string()), pa.array(np.full(len(p), k, np.int32)), *(pa.array(x.astype(np.int32)) for x in (row, col, depth)), pa.array(np.where(flat_ok, a.ravel()[p], 0.0)), pa.array(flat_ok)]
        yield pa.RecordBatch.from_arrays(cols, ["raster_id", "band", "row", "col", "depth", "value", "valid"])


def _from_headers(blobs: DataFrame, schema: str, rows: Callable[[bytes], list[list]], strict: bool) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for rid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = rows(raw)
                except ValueError:
                    if strict:
                        raise
                    continue
                ids += [rid] * len(found)
                out += found
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array(c, t) for c, t in zip(cols, types))], ["raster_id", *names])

    return blobs.select("raster_id", "blob").mapInArrow(run, f"raster_id string, {schema}")


def blob_info(blobs: DataFrame, *, strict: bool = True) -> DataFrame:
    """(raster_id, blob) -> raster_id and the header fields; no pixel is decoded."""
    return _from_headers(blobs, HEADER, lambda raw: [header_row(raw)], strict)


def data_ranges(blobs: DataFrame, *, strict: bool = True) -> DataFrame:
    """(raster_id, blob) -> raster_id, band, depth, z_min, z_max."""
    return _from_headers(blobs, "band int, depth int, z_min double, z_max double", lambda raw: [list(r) for r in container.read_ranges(raw)], strict)


def checksums(blobs: DataFrame) -> DataFrame:
    """(raster_id, blob) -> raster_id, band, ok: whether the stored checksum is right."""

    def rows(raw: bytes) -> list[list]:
        from ..functions.bits import checksum

        return [[k, h.version < 3 or checksum(raw[p + 14 : p + h.size]) == h.checksum] for k, (h, p) in enumerate(container.bands(raw))]

    return _from_headers(blobs, "band int, ok boolean", rows, True)


def split_bands(blobs: DataFrame) -> DataFrame:
    """(raster_id, blob) -> raster_id, band, first, size: where each band's sub-blob lies."""
    return _from_headers(blobs, "band int, first long, size long", lambda raw: [[k, p, h.size] for k, (h, p) in enumerate(container.bands(raw))], True)
