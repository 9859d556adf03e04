"""Report tables as projections over scores and aggregates, with numbers kept as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofgrid.functions import labels
from proofgrid.functions.hygiene import clean_frame, clean_value
from proofgrid.functions.metrics import accuracy
from proofgrid.functions.typed import accuracy_band
from proofgrid.operators import aggregate
from proofgrid.operators.aggregate import BLOCK

# Texts in report rows.
OVERALL = "整體準確度"
CORRECT_NOTE = "正確"
SUMMARY_ITEMS = {
    "total_records": ("總記錄數", "處理的總記錄數量"),
    "overall_accuracy": ("整體準確度", "加權平均準確度"),
    "perfect_records": ("完全正確記錄", "所有欄位都完全匹配的記錄數"),
}
DEFAULT_VALUE_SET = ""
DEFAULT_DOCUMENT_VALUE_SET = "string"

KIND_RECORD, KIND_FIELD, KIND_OVERALL = "record", "field", "overall"


def _with_value_set(df: DataFrame, value_set_id: str | None, default: str) -> DataFrame:
    return df.withColumn("value_set_id", F.lit(value_set_id or default))


def _record_lines(scores: DataFrame, field_line: list[Column], head_kind: str) -> DataFrame:
    """Field lines of every record plus one line for the record itself.

    One grouping by record makes both, so no pair is scored twice. A record has few fields.
    """
    line = F.struct(*field_line)
    grouped = (
        scores.filter(F.col("correct").isNotNull())
        .groupBy(*BLOCK, "row_idx", "record_id", "subject_id")
        .agg(
            F.array_sort(F.collect_list(line)).alias("_lines"),
            F.avg("similarity").alias("_mean"),
            F.count_if("is_exact_match").alias("_matched"),
            F.count(F.lit(1)).alias("_total"),
        )
    )
    fields = F.transform(
        "_lines",
        lambda s: F.struct(
            F.lit(KIND_FIELD).alias("kind"), s["field_order"].alias("field_order"),
            s["field"].alias("field"), s["correct"].alias("correct"),
            s["predicted"].alias("predicted"), s["similarity"].alias("accuracy"),
            s["cer"].alias("cer"), s["wer"].alias("wer"),
            s["is_exact_match"].alias("is_exact_match"),
            F.lit(None).cast("bigint").alias("matched_fields"),
            F.lit(None).cast("bigint").alias("total_fields"),
        ),
    )
    whole = F.struct(
        F.lit(head_kind).alias("kind"),
        F.lit(-1 if head_kind == KIND_RECORD else 1_000_000).alias("field_order"),
        F.lit(OVERALL).alias("field"), F.lit(None).cast("string").alias("correct"),
        F.lit(None).cast("string").alias("predicted"), F.col("_mean").alias("accuracy"),
        F.lit(None).cast("double").alias("cer"), F.lit(None).cast("double").alias("wer"),
        F.lit(None).cast("boolean").alias("is_exact_match"),
        F.col("_matched").alias("matched_fields"), F.col("_total").alias("total_fields"),
    )
    return grouped.select(
        *BLOCK, "row_idx", "record_id", "subject_id", F.inline(F.concat(fields, F.array(whole)))
    )


def _score_columns() -> list[Column]:
    return [
        F.col(c)
        for c in (
            "field_order", "field", "correct", "predicted", "similarity", "cer", "wer",
            "is_exact_match",
        )
    ]


def individual_lines(scores: DataFrame, value_set_id: str | None = None) -> DataFrame:
    """Per record its field lines with three accuracies, then its overall line."""
    lines = _record_lines(scores, _score_columns(), KIND_OVERALL)
    out = lines.select(
        *BLOCK, "row_idx", "subject_id", "kind", "field_order", "field", "accuracy",
        accuracy(F.col("cer")).alias("cer_accuracy"),
        accuracy(F.col("wer")).alias("wer_accuracy"),
    ).withColumns(
        {
            name: F.when(F.col("kind") == KIND_FIELD, F.col(name))
            for name in ("cer_accuracy", "wer_accuracy")
        }
    )
    return _with_value_set(out, value_set_id, DEFAULT_VALUE_SET)


def document_lines(cases: DataFrame, value_set_id: str | None = None) -> DataFrame:
    """Per case its field lines in percent, then the mean line, each with its colour class."""
    line = F.struct("field_order", "field", "accuracy", "cer_accuracy", "wer_accuracy")
    grouped = cases.groupBy("workbook", "model", "case_id").agg(
        F.min("first_row").alias("first_row"),
        F.array_sort(F.collect_list(line)).alias("_lines"),
        F.avg("accuracy").alias("_mean"),
    )
    null = F.lit(None).cast("double")
    fields = F.transform(
        "_lines",
        lambda s: F.struct(
            F.lit(KIND_FIELD).alias("kind"), s["field_order"].cast("int").alias("field_order"),
            s["field"].alias("field"), s["accuracy"].alias("accuracy"),
            s["cer_accuracy"].alias("cer_accuracy"), s["wer_accuracy"].alias("wer_accuracy"),
        ),
    )
    whole = F.struct(
        F.lit(KIND_OVERALL).alias("kind"), F.lit(1_000_000).alias("field_order"),
        F.lit(OVERALL).alias("field"), F.col("_mean").alias("accuracy"),
        null.alias("cer_accuracy"), null.alias("wer_accuracy"),
    )
    out = grouped.select(
        "workbook", "model", "case_id", "first_row", F.inline(F.concat(fields, F.array(whole)))
    ).withColumn("band", accuracy_band(F.col("accuracy")))
    return _with_value_set(out, value_set_id, DEFAULT_DOCUMENT_VALUE_SET)


def detailed_lines(scores: DataFrame, sheet_limits: bool = False) -> DataFrame:
    """Per record a head line, then field lines with cleaned values (whole ones by default), status and note."""
    lines = _record_lines(scores, _score_columns(), KIND_RECORD)
    is_field = F.col("kind") == KIND_FIELD
    return lines.select(
        *BLOCK, "row_idx", "subject_id", "kind", "field_order", "field",
        F.when(is_field, clean_value("correct", sheet_limits)).alias("correct"),
        F.when(is_field, clean_value("predicted", sheet_limits)).alias("predicted"),
        "accuracy",
        F.when(is_field, labels.status_text("is_exact_match", "accuracy")).alias("status"),
        F.when(
            is_field,
            F.when(F.col("is_exact_match"), CORRECT_NOTE).otherwise(labels.cer_suggestion("cer")),
        ).alias("note"),
        "matched_fields", "total_fields",
    )


def record_detail_lines(scores: DataFrame) -> DataFrame:
    """Older per-record form: head line, then field lines with icon and remark."""
    lines = _record_lines(scores, _score_columns(), KIND_RECORD)
    is_field = F.col("kind") == KIND_FIELD
    return lines.select(
        *BLOCK, "row_idx", "record_id", "subject_id", "kind", "field_order", "field",
        "correct", "predicted", "accuracy",
        F.when(is_field, labels.status_icon("is_exact_match", "accuracy")).alias("status_icon"),
        F.when(is_field, labels.remark_text("is_exact_match", "accuracy")).alias("remark"),
        "matched_fields", "total_fields",
    )


def field_summary_table(scores: DataFrame) -> DataFrame:
    return aggregate.field_summary(aggregate.field_statistics(scores))


def summary_items(summary: DataFrame) -> DataFrame:
    """Evaluation summary as item, value and description."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("item_order"), F.lit(name).alias("item"),
                F.col(column).cast("double").alias("value"), F.lit(note).alias("description"),
            )
            for i, (column, (name, note)) in enumerate(SUMMARY_ITEMS.items())
        ]
    )
    return summary.select(*BLOCK, F.inline(entries))


def summary_table(scores: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary sheet: its items, then a line per field with accuracy and exact-match rate.

    Lines are numbered in sheet order; ``section`` tells the two parts apart.
    """
    fields = (
        scores.groupBy(*BLOCK, "field").agg(
            F.min("field_order").alias("_order"), F.avg("similarity").alias("value"),
            (F.count_if("is_exact_match") / F.count(F.lit(1))).alias("match_rate"),
            F.count("correct").alias("_truths"), F.count("predicted").alias("_predictions"),
        )
        .filter((F.col("_truths") > 0) & (F.col("_predictions") > 0))
    )
    lines = fields.select(
        *BLOCK, F.lit("field").alias("section"),
        (F.col("_order") + len(SUMMARY_ITEMS)).alias("item_order"), F.col("field").alias("item"),
        "value", "match_rate",
    )
    items = summary_items(summary).withColumn("section", F.lit("item"))
    return items.unionByName(lines, allowMissingColumns=True)


def record_summary(records: DataFrame) -> DataFrame:
    return records.select(
        *BLOCK, "row_idx", "record_id", "subject_id", "overall_accuracy", "matched_fields",
        "total_fields",
        (F.col("matched_fields") / F.col("total_fields")).alias("match_rate"),
        labels.match_text("matched_fields", "total_fields").alias("match_text"),
        labels.performance_level("overall_accuracy").alias("level"),
    )


def detailed_comparison(scores: DataFrame) -> DataFrame:
    """One line per scored pair, straight from the scores."""
    return scores.filter(F.col("correct").isNotNull()).select(
        *BLOCK, "row_idx", "record_id", "subject_id", "field", "field_order",
        labels.status_icon("is_exact_match", "similarity").alias("status_icon"),
        labels.status_text("is_exact_match", "similarity").alias("status"),
        "similarity",
        "correct", F.coalesce("predicted", F.lit("")).alias("predicted"),
        labels.yes_no("is_exact_match").alias("exact"),
        labels.difference_text("is_exact_match", "similarity").alias("difference"),
        labels.cer_suggestion("cer").alias("suggestion"),
    )


def field_statistics_table(statistics: DataFrame) -> DataFrame:
    return statistics.withColumns(
        {
            "to_improve": F.col("total_records") - F.col("exact_matches"),
            "level": labels.performance_level("average_accuracy"),
        }
    )


def error_analysis(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("correct").isNotNull() & ~F.col("is_exact_match")).select(
        *BLOCK, "row_idx", "record_id", "subject_id", "field",
        labels.error_type("similarity").alias("error_type"),
        "similarity", "correct", F.coalesce("predicted", F.lit("")).alias("predicted"),
        labels.cer_suggestion("cer").alias("suggestion"),
        labels.error_priority("similarity").alias("priority"),
    )


def original_data(df: DataFrame, sheet_limits: bool = False) -> DataFrame:
    return clean_frame(df, sheet_limits)


def distribution_table(distribution: DataFrame) -> DataFrame:
    return distribution.withColumns(
        {
            "band_name": labels.band_name("band"),
            "description": labels.band_description("band"),
        }
    )


def mismatch_table(scores: DataFrame) -> DataFrame:
    """All mismatches, to be written per field."""
    return scores.filter("is_mismatch").select(
        *BLOCK, "field", "row_idx", "correct", "predicted", "similarity"
    )


def overall_report(scores: DataFrame, overall: DataFrame, n: int = 3) -> DataFrame:
    """Text report as rows: overall, one row per field, and its first mismatches."""
    fields = aggregate.field_evaluation(scores).join(overall, BLOCK)
    head = fields.select(
        *BLOCK, "field", F.lit(0).cast("bigint").alias("rank"), "accuracy", "exact_matches", "total_records",
        "mismatched", F.greatest(F.col("mismatched") - n, F.lit(0)).alias("more"),
        "overall_accuracy",
    )
    items = aggregate.first_mismatches(scores, n).select(
        *BLOCK, "field", F.col("rank").cast("bigint").alias("rank"), "correct", "predicted"
    )
    return head.unionByName(items, allowMissingColumns=True)


def record_report(scores: DataFrame) -> DataFrame:
    """Per-record text report as rows: overall, fields, records and their fields."""
    records = aggregate.record_evaluation(scores)
    overall = aggregate.perfect_records(records).select(
        *BLOCK, F.lit("1 overall").alias("section"), F.lit("").alias("item"),
        F.col("mean_accuracy").alias("accuracy"), F.col("perfect_records").alias("matched"),
        F.col("scored_records").alias("total"),
    )
    fields = aggregate.field_statistics(scores).select(
        *BLOCK, F.lit("2 field").alias("section"), F.col("field").alias("item"),
        F.col("average_accuracy").alias("accuracy"), F.col("exact_matches").alias("matched"),
        F.col("total_records").alias("total"),
    )
    lines = _record_lines(scores, _score_columns(), KIND_RECORD)
    is_field = F.col("kind") == KIND_FIELD
    details = lines.select(
        *BLOCK, F.lit("3 record").alias("section"),
        F.when(is_field, F.col("field")).otherwise(F.col("subject_id")).alias("item"),
        "accuracy", F.col("matched_fields").alias("matched"), F.col("total_fields").alias("total"),
        "row_idx", "field_order",
        F.when(is_field, labels.status_icon("is_exact_match", "accuracy")).alias("status_icon"),
    )
    return (
        details.unionByName(overall, allowMissingColumns=True)
        .unionByName(fields, allowMissingColumns=True)
    )


def failure_rows(diagnostics: DataFrame) -> DataFrame:
    """Rows that stand in for the report of a failed block."""
    return diagnostics.select(
        "workbook", F.coalesce("model", F.lit("")).alias("model"),
        F.lit("failed").alias("status"), F.col("message").alias("reason"),
    )
