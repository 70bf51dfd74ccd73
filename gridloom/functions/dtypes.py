"""Type codes of array elements."""

from __future__ import annotations

import numpy as np

DTYPES = [np.dtype(x) for x in ("<i1", "<u1", "<i2", "<u2", "<i4", "<u4", "<f4", "<f8")]
NAMES = ["int8", "uint8", "int16", "uint16", "int32", "uint32", "float32", "float64"]
INT8, UINT8, INT16, UINT16, INT32, UINT32, FLOAT32, FLOAT64 = range(8)


def code_of(dtype: np.dtype) -> int:
    """Type code of a numpy type; other integers and half floats have none."""
    try:
        return DTYPES.index(np.dtype(dtype).newbyteorder("<"))
    except ValueError:
        raise TypeError(f"no type code for {dtype}") from None


def is_integer(code: int) -> bool:
    return code < FLOAT32


def value_range(code: int) -> tuple[float, float]:
    d = DTYPES[code]
    info = np.iinfo(d) if is_integer(code) else np.finfo(d)
    return float(info.min), float(info.max)


def quanta_limit(code: int) -> int:
    """Largest quantum that is packed; beyond it a tile is stored raw."""
    return (1 << 15) - 1 if code <= UINT16 else (1 << 30) - 1


#: type -> narrower types that an offset may take, by the two bits that say so
_NARROW: dict[int, dict[int, int]] = {
    INT16: {2: INT8, 1: UINT8},
    UINT16: {1: UINT8},
    INT32: {3: UINT8, 2: INT16, 1: UINT16},
    UINT32: {2: UINT8, 1: UINT16},
    FLOAT32: {2: UINT8, 1: INT16},
    FLOAT64: {3: INT16, 2: INT32, 1: FLOAT32},
}


def narrower(code: int) -> list[tuple[int, int]]:
    """(the two bits, type) that an offset may be narrowed to, narrowest first."""
    return sorted(_NARROW.get(code, {}).items(), reverse=True)


def narrow(z: float, code: int) -> tuple[int, int]:
    """(the two bits, type) of the narrowest form that holds z exactly."""
    for bits, small in narrower(code):
        low, high = value_range(small)
        if low <= z <= high and (float(np.float32(z)) == z if small == FLOAT32 else float(z).is_integer()):
            return bits, small
    return 0, code


def widened(code: int, bits: int) -> int | None:
    """The type that ``bits`` name for an offset of type ``code``."""
    return code if bits == 0 or code not in _NARROW else _NARROW[code].get(bits)
