"""Run-length forms of byte strings."""

from __future__ import annotations

import numpy as np

from .bits import Truncated

#: Equal bytes from which a run of its own pays, and the most that a 16-bit count says.
LEAST_RUN, LONGEST = 5, 32767
_END = (-32768).to_bytes(2, "little", signed=True)


def islands(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each maximal run."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
    return first, np.diff(np.append(first, len(b)))


def _counted(b: np.ndarray):
    """(count, bytes): a positive count of literal bytes or a negative one of a repeated byte."""
    first, length = islands(b)
    literal_from = 0

    def literals(to: int):
        for i in range(literal_from, to, LONGEST):
            yield min(LONGEST, to - i), b[i : min(i + LONGEST, to)].tobytes()

    for s, n in zip(first.tolist(), length.tolist()):
        # a run that ends the input needs one more byte to count as one
        if n >= LEAST_RUN and s + LEAST_RUN < len(b):
            yield from literals(s)
            for i in range(0, n, LONGEST):
                yield -min(LONGEST, n - i), b[s : s + 1].tobytes()
            literal_from = s + n
    yield from literals(len(b))


def squeeze(b: np.ndarray) -> bytes:
    """Literal stretches and repeats, each behind a signed 16-bit count; -32768 ends."""
    return b"".join(k.to_bytes(2, "little", signed=True) + x for k, x in _counted(np.asarray(b, np.uint8))) + _END


def squeezed_size(b: np.ndarray) -> int:
    return 2 + sum(2 + len(x) for _, x in _counted(np.asarray(b, np.uint8)))


def expand(raw: bytes, at: int, size: int) -> np.ndarray:
    """The bytes of :func:`squeeze`, of which there must be ``size``."""
    out, have, end = [], 0, len(raw)
    while True:
        if at + 2 > end:
            raise Truncated("runs")
        k = raw[at] | raw[at + 1] << 8
        at += 2
        if k == 32768:
            break
        if k > 32768:
            k = 65536 - k
            if at >= end:
                raise Truncated("runs")
            out.append(raw[at : at + 1] * k)
            at += 1
        else:
            # 0 says nothing and stands before a byte of its own, as a repeat does
            took = k or 1
            if at + took > end:
                raise Truncated("runs")
            out.append(raw[at : at + k])
            at += took
        have += k
        if have > size:
            raise Truncated("runs")
    if have != size:
        raise Truncated("runs")
    return np.frombuffer(b"".join(out), np.uint8)


def nibble_runs(b: np.ndarray) -> bytes:
    """Up to 128 literals behind count - 1, or 2 to 129 repeats of a byte behind count + 126."""
    first, length = islands(np.asarray(b, np.uint8))
    out, held = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(held), 128):
            part = held[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        held.clear()

    for s, n in zip(first.tolist(), length.tolist()):
        value = int(b[s])
        while n >= 2:
            flush()
            k = min(n, 129)
            out += bytes([k + 126, value])
            n -= k
        if n:
            held.append(value)
    flush()
    return bytes(out)


def read_nibble_runs(raw: bytes, at: int, end: int, size: int) -> np.ndarray:
    out, have = [], 0
    while at < end:
        k = raw[at]
        if k <= 127:
            part = np.frombuffer(raw, np.uint8, min(k + 1, max(0, end - at - 1)), at + 1)
            if len(part) != k + 1:
                raise Truncated("runs of a plane")
            at += k + 2
        else:
            if at + 1 >= end:
                raise Truncated("runs of a plane")
            part = np.full(k - 126, raw[at + 1], np.uint8)
            at += 2
        out.append(part)
        have += len(part)
    if have != size:
        raise Truncated("runs of a plane")
    return np.concatenate(out) if out else np.zeros(0, np.uint8)
