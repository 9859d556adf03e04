"""64-bit keys of many substrings at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME to the power of 0 .. n-1 modulo 2**64, and the inverses."""
    inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
    up, down = np.full(n, PRIME), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread the bits of keys."""
    keys = keys ^ (keys >> np.uint64(31))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(29))


def span_keys(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key of symbols[start:end] for each span; equal spans have equal keys."""
    n = len(symbols)
    up, down = _powers(1 << max(16, int(max(1, n) - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((symbols + np.uint32(7)).astype(np.uint64) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])
