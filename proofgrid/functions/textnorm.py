"""Text clean-up as built-in expressions. Null always becomes the empty string."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, functions as F

# Every character Unicode counts as white space, plus the four separators U+001C to U+001F.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: Column | str) -> Column:
    return F.coalesce(column(value).cast("string"), F.lit(""))


def strip(value: Column | str) -> Column:
    """Drop white space at both ends; null stays null.

    A text that begins and ends with a printable ASCII character is left as it is, without a search
    for its ends among all characters of white space.
    """
    value = column(value)
    first, last = F.substring(value, 1, 1), F.substring(value, -1, 1)
    return F.when(first.between("!", "~") & last.between("!", "~"), value).otherwise(
        F.trim(value, F.lit(WHITESPACE))
    )


def normalize_text(value: Column | str) -> Column:
    """All white space removed; case and brackets kept."""
    return F.translate(text(value), WHITESPACE, "")


def normalize_words(value: Column | str) -> Column:
    """Ends stripped, every run of white space one space."""
    spaced = F.translate(text(value), WHITESPACE, " " * len(WHITESPACE))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def normalize_folded(value: Column | str) -> Column:
    """Older rule: white space removed, full-width brackets folded, lower case."""
    return F.lower(F.translate(normalize_text(value), "【】（）", "[]()"))


def is_blank(value: Column | str) -> Column:
    return strip(text(value)) == ""


def _one_of(keywords) -> Column:
    """Pattern of the keywords, which are tried only where a first character of one of them stands."""
    pattern = "|".join(map(re.escape, keywords))
    if pattern and all(keywords):
        firsts = "".join(sorted({re.escape(k[0]) for k in keywords}))
        pattern = f"(?=[{firsts}])(?:{pattern})"
    return F.lit(pattern)


def contains_any(value: Column | str, keywords) -> Column:
    """True when the text holds one of the keywords; null counts as holding none."""
    return F.rlike(text(value), _one_of(keywords))


def count_of(value: Column | str, keywords) -> Column:
    """How often keywords occur in the text, none over another; null counts as holding none."""
    return F.regexp_count(text(value), _one_of(keywords))


def has_text(values: Column) -> Column:
    """True when a cell of the array holds more than white space; null cells do not count."""
    return F.rlike(F.array_join(values, ""), F.lit(f"[^{WHITESPACE}]"))
