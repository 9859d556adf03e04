"""Golomb coding of sorted whole numbers, with a power of two as its parameter."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QIB")  # first value, how many values, bits of a remainder


def encode(values: np.ndarray) -> bytes:
    """Ascending values (unsigned, repeats allowed) as their first one and coded gaps.

    A gap is its quotient by 2**k in unary and k bits of remainder; k follows the mean gap, so that there are at
    most about three bits of quotient a value, whatever the gaps are.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.uint64))
    mean = float(values[-1] - values[0]) / max(1, n - 1)
    k = max(0, int(0.69 * mean).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]) if n > 1 else 0, np.uint8)
    unary[ends - 1] = 0
    rest = np.empty((n - 1, k), np.uint8)
    for bit in range(k):
        rest[:, bit] = (gaps >> np.uint64(bit)) & np.uint64(1)
    return _HEAD.pack(int(values[0]), n, k) + np.packbits(np.concatenate([rest.ravel(), unary])).tobytes()


def decode(code: bytes) -> np.ndarray:
    """The values of ``encode``, as uint64."""
    if not code:
        return np.zeros(0, np.uint64)
    first, n, k = _HEAD.unpack_from(code)
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=_HEAD.size))
    rest, unary = bits[: (n - 1) * k].reshape(n - 1, k), bits[(n - 1) * k :]
    zeros = np.flatnonzero(unary == 0)[: n - 1]
    gaps = (np.diff(zeros, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    for bit in range(k):
        gaps |= rest[:, bit].astype(np.uint64) << np.uint64(bit)
    values = np.full(n, first, np.uint64)
    values[1:] += np.cumsum(gaps, dtype=np.uint64)
    return values
