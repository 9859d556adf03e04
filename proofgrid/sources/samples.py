"""The built-in sample tables, for tests and first steps. All values are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLE_SCHEMA = (
    "row_idx bigint, `編號` bigint, `受編` string, `正面_障礙等級` string, `正面_障礙類別` string, "
    "`正面_ICD診斷` string, `正面_備註` string, `反面_障礙等級` string, `反面_證明手冊` string, "
    "`反面_障礙類別` string, `反面_ICD診斷` string"
)
CARD = "身心障礙證明"
TWO_ROWS = [
    (0, 1, "ZA24761194", "輕度", "其他類", "【換16.1】", "", "輕度", CARD, "障礙類別：其他類",
     "【換16.1】"),
    (1, 2, "MT00953431", "中度", "第1類【12.2】", "【換12.2】", "", "中度", CARD, "第1類【12.2】",
     "【第12.2】"),
]
FIVE_ROWS = TWO_ROWS + [
    (2, 3, "AA12345678", "重度", "第2類【11.1】", "【換11.1】", "需定期複檢", "重度", "身心障礙手冊",
     "第2類【11.1】", "【換11.1】"),
    (3, 4, "BB87654321", "輕度", "其他類", "【換16.2】", "", "輕度", CARD, "障礙類別：其他類",
     "【換16.2】"),
    (4, 5, "CC11223344", "中度", "第1類【13.1】", "【換13.1】", "", "中度", CARD, "第1類【13.1】",
     "【換13.1】"),
]
GRID_HEADER = [
    "編號", "受編", "障礙等級", "障礙類別", "ICD診斷", "備註", "障礙等級", "證明/手冊", "障礙類別",
    "ICD診斷",
]
GRID_ROWS = [
    ["1", "ZA24761194", "輕度", "其他類", "【換16.1】", None, "輕度", CARD, "障礙類別：其他類",
     "【換16.1】"],
    ["2", "MT00953431", "中度", "第1類【12.2】", "【換12.2】", None, "中度", CARD, "第1類【12.2】",
     "【第12.2】"],
    ["3", "AB12345678", "重度", "第2類【13.1】", "【換13.1】", None, "重度", CARD, "第2類【13.1】",
     "【換13.1】"],
    ["4", "CD98765432", "輕度", "其他類", "【換16.2】", None, "輕度", CARD, "其他類", "【換16.2】"],
    ["5", "EF11223344", "中度", "第1類【12.3】", "【換12.3】", None, "中度", CARD, "第1類【12.3】",
     "【換12.3】"],
]


def two_row_sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TWO_ROWS, SAMPLE_SCHEMA)


def five_row_sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIVE_ROWS, SAMPLE_SCHEMA)


def rows_from(spark: SparkSession, sheets: dict[str, list[list]]) -> DataFrame:
    """Sheet rows from literal lists."""
    data = [(name, i, values) for name, rows in sheets.items() for i, values in enumerate(rows)]
    return spark.createDataFrame(data, "workbook string, row_idx bigint, values array<string>")


def duplicate_header_sample(spark: SparkSession) -> DataFrame:
    return rows_from(spark, {"sample": [GRID_HEADER, *GRID_ROWS]})
