"""Problems as rows instead of exceptions, so good workbooks go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proofgrid.operators.layout import missing_columns

COLUMNS = ["workbook", "model", "stage", "error_type", "message", "missing_columns"]

# Messages.
NO_HEADER = "無法讀取Excel檔案"
MISSING = "缺少必要欄位"
TOO_SHORT = "資料不足，至少需要3行（模型名稱、欄位名稱、資料）"
NO_FIELDS = "未找到有效的欄位評估資料"


def _rows(df: DataFrame, stage: str, error_type: str, message, missing=None) -> DataFrame:
    model = F.col("model") if "model" in df.columns else F.lit(None).cast("string")
    missing = F.array().cast("array<string>") if missing is None else missing
    return df.select(
        "workbook", model.alias("model"), F.lit(stage).alias("stage"),
        F.lit(error_type).alias("error_type"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        missing.alias("missing_columns"),
    )


def without_header(layouts: DataFrame, headers: DataFrame) -> DataFrame:
    """Single sheets in which no header row was found."""
    lost = layouts.filter(F.col("layout") == "single").join(headers, "workbook", "left_anti")
    return _rows(lost, "read", "FileProcessingError", NO_HEADER)


def without_mapping(pair_map: DataFrame) -> DataFrame:
    """Blocks in which no truth/prediction columns were found, with the default columns they lack."""
    lost = pair_map.filter(F.size("mapping") == 0)
    missing = missing_columns(F.col("header"))
    message = F.concat(F.lit(MISSING + ": "), F.array_join(missing, ", "))
    return _rows(lost, "columns", "DataValidationError", message, missing)


def short_documents(rows: DataFrame) -> DataFrame:
    """Document sheets with fewer than three rows."""
    sizes = rows.groupBy("workbook").agg(F.max("row_idx").alias("_last"))
    return _rows(sizes.filter(F.col("_last") < 2), "read", "DataValidationError", TOO_SHORT)


def documents_without_fields(rows: DataFrame, pair_map: DataFrame) -> DataFrame:
    sheets = rows.filter(F.col("row_idx") == 0).select("workbook")
    lost = sheets.join(pair_map.select("workbook").distinct(), "workbook", "left_anti")
    return _rows(lost, "columns", "DataValidationError", NO_FIELDS)


def unreadable_files(failed: DataFrame) -> DataFrame:
    return _rows(failed, "read", "FileProcessingError", F.col("error"))


def rejected_files(admission: DataFrame) -> DataFrame:
    return _rows(
        admission.filter(~F.col("accepted")), "admit", "FileValidationError", F.col("reason")
    )


def raise_if_nothing(df: DataFrame, message: str) -> None:
    """Hard stop of a job whose every block failed."""
    if df.isEmpty():
        raise ValueError(message)
