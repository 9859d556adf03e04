"""Finding model and field columns in document sheets (model row, field row, then cases)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from proofgrid.config import DEFAULT_DOCUMENT_MAPPING, ScoringConfig
from proofgrid.functions.textnorm import strip, text
from proofgrid.operators import grid
from proofgrid.operators.joins import with_facts
from proofgrid.plans.storage import stored

DEFAULT = ScoringConfig()

# Labels of the two header rows.
HUMAN_LABELS = ["人工", "human", "manual", "Human", "Manual"]
HUMAN_LABELS_STRICT = HUMAN_LABELS[:3]
SKIPPED_FIELDS = ["案件號", "債務人ID"]
MODEL_LABEL = "MODEL"
FIELD_ROW_MARKS = ["案件號", "案例編號", "ID"]
NOT_A_FIELD = ["案件號", "MODEL"]
CASE_NUMBER_START = "99099"
FIELD_SCAN_ROWS = 10
FIRST_CASE_ROW = 2
NO_ID = "nan"


def _header_cells(rows: DataFrame) -> DataFrame:
    """One row per column with the stripped texts of the model row and the field row."""
    top = rows.filter(F.col("row_idx") < FIRST_CASE_ROW)
    per_sheet = top.groupBy("workbook").agg(
        F.max(F.when(F.col("row_idx") == 0, F.col("values"))).alias("_models"),
        F.max(F.when(F.col("row_idx") == 1, F.col("values"))).alias("_fields"),
    )
    columns = F.sequence(F.lit(0), F.size("_fields") - 1)
    return (
        per_sheet.filter(F.size("_fields") > 0)
        .select("workbook", "_models", "_fields", F.explode(columns).alias("col_idx"))
        .select(
            "workbook", "col_idx",
            strip(text(grid.cell(F.col("col_idx"), "_models"))).alias("model_text"),
            strip(text(grid.cell(F.col("col_idx"), "_fields"))).alias("field_text"),
        )
    )


def document_pair_map(rows: DataFrame) -> DataFrame:
    """``(workbook, model, field, field_order, ai_col, human_col)``.

    Model and prediction column are carried from left to right over the header; a human column
    pairs with the carried prediction column. The windows see header cells only.
    """
    so_far = (
        Window.partitionBy("workbook")
        .orderBy("col_idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    names_model = (F.col("model_text") != "") & (F.col("model_text") != MODEL_LABEL)
    plain = (
        (F.col("field_text") != "")
        & ~F.col("field_text").isin(HUMAN_LABELS + SKIPPED_FIELDS)
    )
    carried = (
        _header_cells(rows)
        .withColumn("model", F.last(F.when(names_model, F.col("model_text")), True).over(so_far))
        .withColumn(
            "_ai",
            F.last(
                F.when(
                    names_model | (plain & F.col("model").isNotNull()),
                    F.struct(F.col("col_idx").alias("ai_col"), F.col("field_text").alias("field")),
                ),
                True,
            ).over(so_far),
        )
    )
    found = carried.filter(
        F.col("field_text").isin(HUMAN_LABELS) & F.col("model").isNotNull()
    ).select("workbook", "model", "_ai.*", F.col("col_idx").alias("human_col"))
    usable = found.filter(
        (F.col("field") != "") & ~F.col("field").isin(HUMAN_LABELS_STRICT + SKIPPED_FIELDS)
    )
    # One evaluation per text "field_model": the last human column wins, the first sets the order.
    return (
        usable.groupBy("workbook", F.concat_ws("_", "field", "model").alias("_key"))
        .agg(
            F.max_by(F.struct("model", "field", "ai_col", "human_col"), "human_col").alias("_p"),
            F.min("human_col").alias("field_order"),
        )
        .select("workbook", "_p.model", "_p.field", "field_order", "_p.ai_col", "_p.human_col")
    )


def document_pairs(
    rows: DataFrame, pair_map: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """One pair per case and mapped field. Cases where both sides are empty stay in.

    The map is one row per sheet; its size is read back and decides whether the cases stay in place.
    """
    per_sheet = stored(
        pair_map.groupBy("workbook").agg(
            F.collect_list(F.struct("model", "field", "field_order", "ai_col", "human_col"))
            .alias("_m")
        ),
        "sheet-maps",
    )
    cases = rows.filter(F.col("row_idx") >= FIRST_CASE_ROW)
    return (
        with_facts(cases, per_sheet, ["workbook"], "row_idx", cfg.hot_splits)
        .select("workbook", "row_idx", "values", F.inline("_m"))
        .select(
            "workbook", "model", "row_idx",
            F.coalesce(grid.cell(0), F.lit(NO_ID)).alias("case_id"),
            "field", "field_order", "ai_col", "human_col",
            grid.cell(F.col("human_col")).alias("correct"),
            grid.cell(F.col("ai_col")).alias("predicted"),
        )
    )


def count_cases(rows: DataFrame) -> DataFrame:
    """Case rows per workbook, blank ones included."""
    return rows.groupBy("workbook").agg(
        F.count_if(F.col("row_idx") >= FIRST_CASE_ROW).alias("total_cases")
    )


def adjacent_model_columns(rows: DataFrame) -> DataFrame:
    """Model name in the first row with its human column right after it.

    A column used as a human column names no model. Candidates that touch form a run in which
    every second one is used up by the one before.
    """
    top = rows.filter(F.col("row_idx") == 0)
    cells = top.select("workbook", F.posexplode("values").alias("col_idx", "value"))
    by_column = Window.partitionBy("workbook").orderBy("col_idx")
    label = strip(text("value"))
    following = F.lead(label).over(by_column)
    candidates = (
        cells.withColumn("model", label)
        .withColumn("_next", following)
        .filter(
            (F.col("col_idx") >= 1)
            & (F.col("model") != "")
            & F.col("_next").isin(["", *HUMAN_LABELS_STRICT])
        )
        .withColumn("_run", F.col("col_idx") - F.row_number().over(by_column))
        .withColumn(
            "_in_run",
            F.row_number().over(Window.partitionBy("workbook", "_run").orderBy("col_idx")),
        )
        .filter(F.col("_in_run") % 2 == 1)
    )
    return candidates.groupBy("workbook", "model").agg(
        F.max("col_idx").alias("ai_col"), (F.max("col_idx") + 1).alias("human_col")
    )


def field_rows(rows: DataFrame) -> DataFrame:
    """``(workbook, field, position)``: from the field row, else from the first column.

    ``position`` is a column number in the first case and a row number in the second; a field that
    occurs twice keeps its last position.
    """
    top = rows.filter(F.col("row_idx").between(1, FIELD_SCAN_ROWS - 1))
    marked = (
        rows.filter(F.col("row_idx") == 1)
        .filter(strip(grid.cell(0)).isin(FIELD_ROW_MARKS))
    )
    across = (
        marked.select("workbook", F.posexplode("values").alias("position", "value"))
        .select("workbook", strip(text("value")).alias("field"), "position")
        .filter((F.col("field") != "") & ~F.col("field").isin(HUMAN_LABELS))
    )
    down = (
        top.join(marked.select("workbook"), "workbook", "left_anti")
        .select(
            "workbook", strip(text(grid.cell(0))).alias("field"),
            F.col("row_idx").cast("int").alias("position"),
        )
        .filter(
            (F.col("field") != "")
            & ~F.startswith("field", F.lit(CASE_NUMBER_START))
            & ~F.col("field").isin(NOT_A_FIELD)
        )
    )
    return across.unionByName(down).groupBy("workbook", "field").agg(
        F.max("position").alias("position")
    )


def model_field_values(
    rows: DataFrame, models: DataFrame, fields: DataFrame
) -> DataFrame:
    """Per model and field the two cells in the field's row; a position is used as a row number."""
    wanted = stored(models.join(fields, "workbook"), "wanted-rows")
    return wanted.join(
        rows.withColumnRenamed("row_idx", "position"), ["workbook", "position"], "left"
    ).select(
        "workbook", "model", "field", F.col("position").alias("row_idx"),
        grid.cell(F.col("human_col")).alias("correct"),
        grid.cell(F.col("ai_col")).alias("predicted"),
    )


def fixed_document_pairs(
    df: DataFrame, row_idx: str, mapping: dict[str, tuple[str, str]] = DEFAULT_DOCUMENT_MAPPING,
    workbook: str | None = None, model: str = "",
) -> DataFrame:
    """Pairs of a headed document table by column name; its first data row is skipped."""
    case = F.coalesce(
        F.col(f"`{df.columns[0]}`").cast("string"),
        F.concat(F.lit("記錄"), F.col(row_idx).cast("string")),
    )
    present = [
        (i, field, ai, human)
        for i, (field, (ai, human)) in enumerate(mapping.items())
        if ai in df.columns and human in df.columns
    ]
    if not present:
        raise ValueError("none of the mapped document columns exists")
    entries = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"), F.lit(i).alias("field_order"),
                F.col(f"`{human}`").cast("string").alias("correct"),
                F.col(f"`{ai}`").cast("string").alias("predicted"),
            )
            for i, field, ai, human in present
        ]
    )
    return (
        df.filter(F.col(row_idx) > 0)
        .select(
            (F.col(workbook) if workbook else F.lit("")).alias("workbook"),
            F.lit(model).alias("model"), F.col(row_idx).cast("bigint").alias("row_idx"),
            case.alias("case_id"), F.inline(entries),
        )
        .filter(F.col("correct").isNotNull() | F.col("predicted").isNotNull())
    )
