"""What the layout search must know of a workbook, in one row per workbook.

``workbook_profile`` reads the sheet rows once. Its state per workbook is bounded (six head rows, three
numbers, one word of flags) and merges, so the rows are combined before the one shuffle. Header row,
model census, column ranges and column mapping are then array work on the profile; sheet rows are
not read again for any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofgrid.functions.modelnames import UNKNOWN_MODEL, from_text, is_model_cell
from proofgrid.functions.textnorm import contains_any, strip
from proofgrid.operators import grid

HEAD_ROWS = 6

# Fallback positions of the fields (truth, prediction) and what their values look like.
FIELD_POSITIONS = {"障礙等級": (2, 6), "障礙類別": (3, 8), "ICD診斷": (4, 9)}
CONTENT_MARKS = {
    "障礙等級": ["輕度", "中度", "重度", "極重度"],
    "障礙類別": [
        "類", "其他", "第1類", "第2類", "第3類", "第4類", "第5類", "第6類", "第7類", "第8類",
    ],
    "ICD診斷": ["【", "】", "[", "]", "換", "第"],
}
_FITTING = 0b111  # truth filled, prediction filled, a mark on one side


def position_flags(values: Column) -> Column:
    """Three bits per field that tell how a row fills the fixed positions."""
    flags = F.lit(0)
    for i, (field, (truth, predicted)) in enumerate(FIELD_POSITIONS.items()):
        left, right = grid.cell(truth, values), grid.cell(predicted, values)
        marked = contains_any(left, CONTENT_MARKS[field]) | contains_any(right, CONTENT_MARKS[field])
        for bit, holds in enumerate((left.isNotNull(), right.isNotNull(), marked)):
            flags = flags.bitwiseOR(F.when(holds, 1 << (3 * i + bit)).otherwise(0))
    return flags


def fitting_fields(flags: Column) -> Column:
    """Fields whose fixed positions hold fitting values: both sides filled, one side with a mark."""
    return F.array_compact(
        F.array(*[
            F.when(flags.bitwiseAND(F.lit(_FITTING << (3 * i))) == _FITTING << (3 * i), F.lit(field))
            for i, field in enumerate(FIELD_POSITIONS)
        ])
    )


def workbook_profile(rows: DataFrame) -> DataFrame:
    """``(workbook, last_row, width, model_cells, tail_flags, head)``.

    ``head`` holds the rows before row 6 in order, ``tail_flags`` the position flags of all later rows.
    """
    in_head = F.col("row_idx") < HEAD_ROWS
    values = F.col("values")
    facts = rows.select(
        "workbook", "row_idx", F.size("values").alias("_width"),
        grid.model_cells_in(values).alias("_model_cells"),
        F.when(~in_head, position_flags(values)).alias("_flags"),
        F.when(in_head, F.struct("row_idx", "values")).alias("_head"),
    )
    return facts.groupBy("workbook").agg(
        F.max("row_idx").cast("bigint").alias("last_row"),
        F.max("_width").alias("width"),
        F.sum("_model_cells").alias("model_cells"),
        F.coalesce(F.bit_or("_flags"), F.lit(0)).alias("tail_flags"),
        F.array_sort(F.collect_list("_head")).alias("head"),
    )


def census(profile: DataFrame) -> DataFrame:
    """Model-naming cells per workbook; more than one makes the sheet a multi-model grid."""
    return profile.select(
        "workbook", "model_cells", (F.col("model_cells") > 1).alias("is_multi_model")
    )


def structure(profile: DataFrame) -> DataFrame:
    """Rows and columns per workbook; the first row is the header and not counted as data."""
    return profile.select(
        "workbook", F.col("last_row").alias("n_rows"), F.col("width").cast("bigint").alias("n_columns")
    )


def _before(head: Column, n: int) -> Column:
    return F.filter(head, lambda r: r["row_idx"] < n)


def with_header(profile: DataFrame) -> DataFrame:
    """Profiles of the workbooks that have a header row, with ``header_row`` and ``header``."""
    found = F.filter(
        _before(F.col("head"), grid.HEADER_SCAN_ROWS), lambda r: grid.is_header(r["values"])
    )
    return (
        profile.withColumn("_header", F.get(found, F.lit(0)))
        .filter(F.col("_header").isNotNull())
        .withColumns({"header_row": F.col("_header.row_idx"), "header": F.col("_header.values")})
        .drop("_header")
    )


def headers(profile: DataFrame) -> DataFrame:
    return with_header(profile).select("workbook", "header_row", "header")


def data_flags(header_row: Column) -> Column:
    """Position flags of all rows below the header, from the columns of a profile."""
    below = F.filter("head", lambda r: r["row_idx"] > header_row)
    return F.aggregate(
        below, F.col("tail_flags"), lambda flags, r: flags.bitwiseOR(position_flags(r["values"]))
    )


def first_model_name() -> Column:
    """Model named first, row by row, in the top five rows of a profile; null without one."""
    names = F.flatten(
        F.transform(
            _before(F.col("head"), grid.HEADER_SCAN_ROWS),
            lambda r: F.filter(F.transform(r["values"], from_text), lambda name: name != ""),
        )
    )
    return F.get(names, F.lit(0))


def model_names(
    profile: DataFrame, rows: DataFrame, headers: DataFrame, cfg
) -> DataFrame:
    """``(workbook, model)`` per row of ``headers``; ``profile`` and ``headers`` are stored tables.

    Only workbooks whose top rows name no model, though a cell does, have their sheet rows looked at.
    """
    named = profile.select("workbook", "model_cells", first_model_name().alias("model"))
    named = headers.select("workbook", "header_row", "header").join(named, "workbook")
    silent = named.filter(F.col("model").isNull())
    if silent.isEmpty():
        return named.select("workbook", "model")
    common = grid.common_model_name(rows, silent.filter("model_cells > 0"), cfg)
    return named.join(common, "workbook", "left").select(
        "workbook", F.coalesce("model", "common_name", F.lit(UNKNOWN_MODEL)).alias("model")
    )


def column_spans(profile: DataFrame) -> DataFrame:
    """Profiles with ``spans``: the column range of every model named in the top five rows.

    Only workbooks with two or more; of two names in one column the lower one counts.
    """
    top = _before(F.col("head"), grid.HEADER_SCAN_ROWS)

    def lowest_name(column: Column) -> Column:
        cells = F.filter(
            F.transform(top, lambda r: F.get(r["values"], column)), lambda v: is_model_cell(v)
        )
        return strip(F.get(cells, F.size(cells) - 1))

    columns = F.sequence(F.lit(0), F.greatest(F.col("width") - 1, F.lit(0)))
    starts = F.filter(
        F.transform(columns, lambda c: F.struct(c.alias("start_col"), lowest_name(c).alias("model"))),
        lambda s: s["model"].isNotNull(),
    )
    named = profile.withColumn("_starts", starts).filter(F.size("_starts") > 1)
    spans = F.transform(
        "_starts",
        lambda s, i: F.struct(
            s["model"].alias("model"), s["start_col"].alias("start_col"),
            F.coalesce(
                F.get(F.col("_starts"), i + 1)["start_col"] - 1, F.col("width") - 1
            ).alias("end_col"),
        ),
    )
    return named.withColumn("spans", spans).drop("_starts")
