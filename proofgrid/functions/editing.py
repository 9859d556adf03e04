"""Arrow helpers for comparisons that Spark's built-in functions cannot express or do slowly."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F, types as T


_STRIPE = 2_048  # columns at least that share the rows of one band
_NARROW = 1_024  # width of the first band; sides that are not much longer are compared whole


def edit_distance(left, right) -> int:
    """Unit-cost edit distance of two sequences, bit-parallel (Myers 1999, Hyyrö 2003) in a band (Ukkonen 1985).

    A band yields the cost of some way through the table, so never too little, and all ways of at most its
    width's cost lie inside. So a result within the width is the distance; else it is the width that suffices.
    """
    start, end_l, end_r = 0, len(left), len(right)
    while start < end_l and start < end_r and left[start] == right[start]:
        start += 1
    while end_l > start and end_r > start and left[end_l - 1] == right[end_r - 1]:
        end_l -= 1
        end_r -= 1
    left, right = left[start:end_l], right[start:end_r]
    if len(left) == 0 or len(right) == 0:
        return len(left) + len(right)
    longest, width = max(len(left), len(right)), abs(len(left) - len(right)) + _NARROW
    if longest > 8 * width:
        cost = _cost_in_band(left, right, width)
        return cost if cost <= width else _cost_in_band(left, right, cost)
    return _cost_in_band(left, right, longest)


def _cost_in_band(left, right, width: int) -> int:
    """Least cost of the ways that leave the diagonal by no more than a way of cost ``width`` can.

    Rows are the items of ``left``. Each stripe of columns works on the rows of its band only: those above
    have been left for good, those below are entered at one more per row. Values at the border of the band
    so grow by one per step, which is never less than they would.
    """
    n, m = len(left), len(right)
    # A way that costs at most width makes up for the difference in length and spends the rest in pairs.
    above = (width - abs(n - m)) // 2 + max(0, m - n)  # rows behind the diagonal
    below = (width - abs(n - m)) // 2 + max(0, n - m)
    stripe = max(_STRIPE, (above + below) // 4)
    first = last = plus = minus = value = 0  # rows first to last; value is that of the row before them
    for start in range(0, m, stripe):
        end = min(start + stripe, m)
        low, high = max(0, start - above), min(n, end + below)
        if low > first:
            gone = low - first
            part = (1 << gone) - 1
            value += (plus & part).bit_count() - (minus & part).bit_count()
            plus, minus = plus >> gone, minus >> gone
        if high > last:
            plus |= ((1 << (high - last)) - 1) << (last - low)
        first, last = low, high
        mask = (1 << (high - low)) - 1
        positions: dict = {}
        for i, item in enumerate(left[low:high]):
            positions.setdefault(item, []).append(i)
        positions = {item: _bits(places, high - low) for item, places in positions.items()}
        for item in right[start:end]:
            equal = positions.get(item, 0)
            diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
            up = ((minus | ((diagonal | plus) ^ mask)) << 1) | 1
            down = (plus & diagonal) << 1
            plus = (down | ~(diagonal | up)) & mask
            minus = up & diagonal
        value += end - start
    return value + plus.bit_count() - minus.bit_count()


def _bits(places: list[int], size: int) -> int:
    """A number with the bits at ``places`` set."""
    flags = bytearray(size // 8 + 1)
    for i in places:
        flags[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(flags, "little")


def _pairwise(fn, left: pd.Series, right: pd.Series, dtype: str) -> pd.Series:
    values = [None if a is None or b is None else fn(a, b) for a, b in zip(left, right)]
    return pd.Series(values, dtype=dtype)


@F.pandas_udf(T.IntegerType())
def long_char_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return _pairwise(edit_distance, left, right, "Int32")


@F.pandas_udf(T.IntegerType())
def long_word_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return _pairwise(
        lambda a, b: edit_distance(a.split(" "), b.split(" ")), left, right, "Int32"
    )


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; null when either side is null."""
    return _pairwise(
        lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(), left, right, "Float64"
    )


def _opcode_errors(left: str, right: str) -> int:
    total = 0
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, left, right).get_opcodes():
        if tag != "equal":
            total += max(i2 - i1, j2 - j1)
    return total


@F.pandas_udf(T.IntegerType())
def opcode_errors(left: pd.Series, right: pd.Series) -> pd.Series:
    """Errors counted over matching-block opcodes; a replaced span counts its longer side."""
    return _pairwise(_opcode_errors, left, right, "Int32")
