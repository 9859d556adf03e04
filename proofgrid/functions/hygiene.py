"""Clean-up of values and names before they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from proofgrid.functions.textnorm import column

# Limits of a spreadsheet cell and of a sheet name.
CELL_LIMIT, CELL_KEPT = 32767, 32760
NAME_LIMIT, NAME_KEPT = 31, 28
ELLIPSIS = "..."
NAME_BREAKERS = "\\/*?:[]"

# Control characters below U+0020 other than tab, line feed and carriage return.
CONTROL = "".join(chr(c) for c in range(32) if chr(c) not in "\t\n\r")


def clean_value(value, sheet_limits: bool = True) -> Column:
    """No control characters, no ``nan``, and with ``sheet_limits`` an ellipsis where a cell could not hold the text."""
    value = column(value)
    kept = F.translate(value, CONTROL, "")
    if sheet_limits:
        kept = F.when(
            F.char_length(kept) > CELL_LIMIT,
            F.concat(F.substring(kept, 1, CELL_KEPT), F.lit(ELLIPSIS)),
        ).otherwise(kept)
    return F.when(value.isNull() | (value == "") | (value == "nan"), "").otherwise(kept)


def clean_frame(df: DataFrame, sheet_limits: bool = False) -> DataFrame:
    """Text columns cleaned, and cut only with ``sheet_limits``; missing numbers become the empty string, as a sheet shows them."""
    cleaned = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = clean_value(c, sheet_limits)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c.isNull() | F.isnan(c), "").otherwise(c.cast("string"))
        else:
            c = F.coalesce(c.cast("string"), F.lit(""))
        cleaned.append(c.alias(f.name))
    return df.select(*cleaned)


def sheet_name(value) -> Column:
    """Name safe for a sheet or a partition, at most 31 characters."""
    safe = F.translate(column(value), NAME_BREAKERS, "_" * len(NAME_BREAKERS))
    return F.when(
        F.char_length(safe) > NAME_LIMIT,
        F.concat(F.substring(safe, 1, NAME_KEPT), F.lit(ELLIPSIS)),
    ).otherwise(safe)


def document_sheet_name(value) -> Column:
    """Document variant: cut first, then keep letters, numbers, space, ``_`` and ``-``."""
    cut = F.substring(column(value), 1, NAME_LIMIT)
    return F.regexp_replace(cut, r"[^\p{L}\p{N} _-]", "")


def _stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(?s)\.[^.]*\z", "")


def output_name(file_name, run_id) -> Column:
    """Name of the report made from a file; ``run_id`` comes from the caller."""
    stem = F.translate(_stem(column(file_name)), "/\\[]", "__")
    return F.concat(stem, F.lit("_accuracy_evaluation_"), column(run_id), F.lit(".xlsx"))


def document_output_name(file_name, run_id) -> Column:
    return F.concat(
        _stem(column(file_name)), F.lit("_外來函文評估結果_"), column(run_id), F.lit(".xlsx")
    )
