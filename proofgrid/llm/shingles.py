"""Sets of five-word shingles as 64-bit keys."""

from __future__ import annotations

import numpy as np

from proofgrid.llm.hashing import mix, span_keys

WIDTH = 5
STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def shingle_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the shingles of all texts in order, and where each text's keys end.

    A text of fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    parts = [t.encode() for t in texts]
    joined = b"\n".join(parts) + b"\n"
    data = _LOWER[np.frombuffer(joined, np.uint8)]
    edges = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    gap = _GAP[data]
    change = np.flatnonzero(np.diff(np.concatenate([[True], gap])))  # word starts and ends alternate
    starts, ends = change[0::2], change[1::2]
    words = span_keys(data.astype(np.uint32), starts, ends)
    upto = np.searchsorted(starts, edges)
    counts = np.diff(upto, prepend=0)
    first = upto - counts
    whole = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        whole = whole * STEP + words[k : k + len(whole)]
    n_keys = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    key_ends = np.cumsum(n_keys)
    at = np.repeat(first - (key_ends - n_keys), n_keys) + np.arange(int(key_ends[-1]) if len(parts) else 0)
    keys = mix(np.append(whole, np.zeros(WIDTH, np.uint64))[np.minimum(at, len(whole))])
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    value = np.zeros(len(short), np.uint64)
    for k in range(WIDTH - 1):
        there = counts[short] > k
        value[there] = value[there] * STEP + words[first[short[there]] + k]
    keys[key_ends[short] - 1] = mix(value + counts[short].astype(np.uint64))
    return keys, key_ends


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct keys of each text."""
    keys, ends = shingle_keys(texts)
    return [np.unique(part) for part in np.split(keys, ends[:-1])] if texts else []
