"""Containers from and to numpy arrays and masked arrays, for use without Spark or inside functions."""

from __future__ import annotations

import numpy as np

from . import container, dtypes


def encode_masked(a: np.ma.MaskedArray, max_error: float = 0.0, *, no_data: list[float | None] | None = None, version: int = container.LATEST) -> bytes:
    """A masked array [row, col], [band, row, col] or [band, row, col, depth]: masked in all depths is invalid, in some is no-data.

    Where depths of a pixel differ in validity a band needs its ``no_data`` value; NaN of valid pixels count as masked.
    """
    a = np.ma.asarray(a)
    values, bad = container.as_four(np.ma.getdata(a)).copy(), container.as_four(np.ma.getmaskarray(a))
    n_bad = bad.sum(axis=3)
    for k in range(len(values)):
        if ((n_bad[k] > 0) & (n_bad[k] < values.shape[3])).any():
            if no_data is None or no_data[k] is None:
                raise ValueError(f"band {k} mixes masked and other values in a pixel and has no no-data value")
            values[k][bad[k]] = no_data[k]
    return container.encode(values, n_bad < values.shape[3], max_error, no_data=no_data, version=version)


def decode_masked(raw: bytes, at: int = 0) -> np.ma.MaskedArray:
    """[band, row, col, depth] with invalid pixels and no-data values masked."""
    d = container.decode(raw, at)
    bad = np.repeat(~d.mask[..., None], d.values.shape[3], axis=3)
    for k, x in enumerate(d.no_data):
        if x is not None:
            bad[k] |= d.values[k] == d.values.dtype.type(x)
    return np.ma.masked_array(d.values, bad)


def max_error_between(a: np.ma.MaskedArray, b: np.ma.MaskedArray) -> float:
    """Largest absolute difference where neither is masked; 0 if there is no such value."""
    diff = np.ma.abs(np.ma.asarray(a).astype(np.float64) - np.ma.asarray(b).astype(np.float64)).compressed()
    return float(diff.max()) if diff.size else 0.0


def data_range(a: np.ma.MaskedArray) -> tuple[float, float]:
    """(min, max) of what is not masked; (-1, -1) if all is."""
    v = np.ma.asarray(a).compressed()
    return (float(v.min()), float(v.max())) if v.size else (-1.0, -1.0)


def planar(values: np.ndarray) -> np.ndarray:
    """[row, col, depth] as [depth, row, col]."""
    return np.ascontiguousarray(np.moveaxis(values, 2, 0))


def interleaved(values: np.ndarray) -> np.ndarray:
    """[depth, row, col] as [row, col, depth]."""
    return np.ascontiguousarray(np.moveaxis(values, 0, 2))


def from_first_generation(values: np.ndarray, code: int) -> np.ndarray:
    """32-bit floats as another type; integers round halves up."""
    return np.floor(values.astype(np.float64) + 0.5).astype(dtypes.DTYPES[code]) if dtypes.is_integer(code) else values.astype(dtypes.DTYPES[code])
