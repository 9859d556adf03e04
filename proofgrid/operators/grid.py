"""Sheets as rows of cells.

``rows(workbook, row_idx, values)`` is the working form: one row per sheet row, its cells in an
array. ``cells(workbook, row_idx, col_idx, value)`` is the exchange form, one row per filled cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofgrid.config import ScoringConfig
from proofgrid.functions.modelnames import (
    MODEL_COLUMN_WORDS,
    UNKNOWN_MODEL,
    from_text,
    is_model_cell,
)
from proofgrid.functions.textnorm import contains_any, count_of, has_text, is_blank, text
from proofgrid.operators.joins import sliced_join

DEFAULT = ScoringConfig()

# Words of a header row. The first eight are used for side-by-side sheets.
HEADER_WORDS = [
    "編號", "受編", "障礙", "類別", "ICD", "備註", "證明", "手冊", "解答", "LLM", "辨識",
]
SHORT_HEADER_WORDS = HEADER_WORDS[:8]
ID_HEADER, SUBJECT_HEADER = "編號", "受編"
HEADER_SCAN_ROWS = 5


def rows_to_cells(rows: DataFrame) -> DataFrame:
    """One row per filled cell."""
    return rows.select(
        "workbook", "row_idx", F.posexplode("values").alias("col_idx", "value")
    ).filter(F.col("value").isNotNull())


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """Pack cells into sheet rows; a sheet row holds at most 16,384 cells."""
    packed = cells.groupBy("workbook", "row_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("_cells"),
        F.max("col_idx").alias("_last"),
    )
    return packed.select(
        "workbook",
        "row_idx",
        F.transform(
            F.sequence(F.lit(0), F.col("_last")), lambda i: F.element_at(F.col("_cells"), i)
        ).alias("values"),
    )


def cell(position, values: str | Column = "values") -> Column:
    """The cell at a 0-based position, null beyond the end of the row."""
    values = F.col(values) if isinstance(values, str) else values
    position = F.lit(position) if isinstance(position, int) else position
    return F.get(values, position)


def has_content(values: Column) -> Column:
    return has_text(values)


def names_model(values: Column) -> Column:
    """Cheap test on the whole row; only rows that pass it are looked at cell by cell."""
    return is_model_cell(F.array_join(values, "\n"))


def model_cell_of(values: Column) -> Column:
    """The first cell of a row that names a model, stripped; null when there is none."""
    return F.when(names_model(values), F.get(F.filter(values, is_model_cell), F.lit(0)))


def model_cells_in(values: Column) -> Column:
    return F.when(names_model(values), F.size(F.filter(values, is_model_cell))).otherwise(0)


def header_words_in(values: Column, words=HEADER_WORDS) -> Column:
    """Cells that hold a header word; rows without any such word are settled by one test."""
    return F.when(
        contains_any(F.array_join(values, "\n"), words),
        F.size(F.filter(values, lambda v: contains_any(v, words))),
    ).otherwise(0)


def holds_header_words(values: Column, least: int, words=HEADER_WORDS) -> Column:
    """Whether that many cells hold a header word; a row that holds fewer words needs no look at its cells."""
    enough = count_of(F.array_join(values, "\n"), words) >= least
    return F.when(enough, header_words_in(values, words) >= least).otherwise(False)


def model_census(rows: DataFrame) -> DataFrame:
    """Model-naming cells per workbook; more than one makes the sheet a multi-model grid."""
    return (
        rows.groupBy("workbook")
        .agg(F.sum(model_cells_in(F.col("values"))).alias("model_cells"))
        .withColumn("is_multi_model", F.col("model_cells") > 1)
    )


def is_header(values: Column) -> Column:
    """Whether a row is a header: ids and 4 known words, or 6 words."""
    named = F.filter(values, lambda v: ~F.startswith(text(v), F.lit("Unnamed")))
    has_ids = F.exists(named, lambda v: F.contains(text(v), F.lit(ID_HEADER))) & F.exists(
        values, lambda v: F.contains(text(v), F.lit(SUBJECT_HEADER))
    )
    words = header_words_in(named)
    return (has_ids & (words >= 4)) | (words >= 6)


def header_rows(rows: DataFrame) -> DataFrame:
    """The header row of each workbook, the first one among its first five rows."""
    return (
        rows.filter(F.col("row_idx") < HEADER_SCAN_ROWS)
        .filter(is_header(F.col("values")))
        .groupBy("workbook")
        .agg(F.min_by(F.struct("row_idx", "values"), "row_idx").alias("_header"))
        .select(
            "workbook",
            F.col("_header.row_idx").alias("header_row"),
            F.col("_header.values").alias("header"),
        )
    )


def structure_profile(rows: DataFrame) -> DataFrame:
    """Rows and columns per workbook; the first row is the header and not counted as data."""
    return rows.groupBy("workbook").agg(
        F.max("row_idx").cast("bigint").alias("n_rows"),
        F.max(F.size("values")).cast("bigint").alias("n_columns"),
    )


def preview(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` data rows of every workbook."""
    return rows.filter(F.col("row_idx").between(1, n))


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(has_content(F.col("values")))


def distinct_headers(header: Column) -> Column:
    """Header texts where the second, third … use of a name gets ``.1``, ``.2`` …"""

    def label(name: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(header, F.lit(1), i), lambda h: h == name))
        return F.when(earlier == 0, name).otherwise(
            F.concat(name, F.lit("."), earlier.cast("string"))
        )

    return F.transform(header, label)


def filled_headers(header: Column, prefix: str = "Unnamed: ") -> Column:
    """Header texts with a stand-in for blank cells."""
    return F.transform(
        header,
        lambda h, i: F.when(is_blank(h), F.concat(F.lit(prefix), i.cast("string"))).otherwise(h),
    )


def first_model_name(rows: DataFrame) -> DataFrame:
    """Model named first (row by row) in the top five rows of a workbook."""
    named = F.filter(
        F.transform("values", lambda v, i: F.struct(i.alias("col"), from_text(v).alias("name"))),
        lambda c: c["name"] != "",
    )
    return (
        rows.filter(F.col("row_idx") < HEADER_SCAN_ROWS)
        .select("workbook", "row_idx", F.get(named, F.lit(0))["name"].alias("_name"))
        .groupBy("workbook")
        .agg(
            F.coalesce(
                F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("row_idx"))),
                F.lit(UNKNOWN_MODEL),
            ).alias("model_name")
        )
    )


def named_cells(
    rows: DataFrame, headers: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Cells below the header that hold a model name, with whether their column suggests one.

    Every text rule holds a model word, so rows and cells without one need no rules.
    """
    hinted = F.transform("header", lambda h: contains_any(F.lower(text(h)), MODEL_COLUMN_WORDS))
    cells = F.filter(
        F.transform("values", lambda v, i: F.struct(i.alias("col_idx"), v.alias("value"))),
        lambda c: is_model_cell(c["value"]),
    )
    found = F.filter(
        F.transform(
            cells,
            lambda c: F.struct(c["col_idx"].alias("col_idx"), from_text(c["value"]).alias("name")),
        ),
        lambda c: c["name"] != "",
    )
    naming = rows.filter(names_model(F.col("values"))).select(
        "workbook", "row_idx", found.alias("_found")
    )
    hints = headers.select("workbook", "header_row", hinted.alias("_hinted"))
    return (
        sliced_join(naming, hints, ["workbook"], "row_idx", cfg.hot_splits)
        .filter(F.col("row_idx") > F.col("header_row"))
        .select("workbook", "row_idx", "_hinted", F.inline("_found"))
        .select(
            "workbook", "row_idx", "col_idx", "name",
            F.coalesce(cell(F.col("col_idx"), "_hinted"), F.lit(False)).alias("hinted"),
        )
    )


def most_common(cells: DataFrame, value: str, name: str) -> DataFrame:
    """Most frequent value per workbook; among equals the one seen first, column by column."""
    counted = cells.groupBy("workbook", value).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("col_idx", "row_idx")).alias("_first")
    )
    return counted.groupBy("workbook").agg(
        F.min_by(value, F.struct(-F.col("n"), F.col("_first"))).alias(name)
    )


def common_model_name(
    rows: DataFrame, headers: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """``(workbook, common_name)``: the most common name in hinted columns, else in any column."""
    cells = named_cells(rows, headers, cfg)
    per_name = cells.groupBy("workbook", "name", "hinted").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("col_idx", "row_idx")).alias("first")
    )
    rank = F.struct(-F.col("n"), F.col("first"))
    in_hinted = F.min_by("name", F.when(F.col("hinted"), rank))
    # Names outside hinted columns count only when no hinted column names a model.
    in_any = F.min_by("name", F.when(~F.col("hinted"), rank))
    return per_name.groupBy("workbook").agg(F.coalesce(in_hinted, in_any).alias("common_name"))


def dominant_model_name(
    rows: DataFrame, headers: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Top-row name, else the most common one, else unknown."""
    return (
        first_model_name(rows)
        .join(common_model_name(rows, headers, cfg), "workbook", "left")
        .select(
            "workbook",
            F.when(F.col("model_name") != UNKNOWN_MODEL, F.col("model_name"))
            .otherwise(F.coalesce("common_name", F.lit(UNKNOWN_MODEL)))
            .alias("model_name"),
        )
    )
