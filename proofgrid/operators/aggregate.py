"""Aggregates over scores.

All of them are algebraic (sums, counts, extremes), so Spark combines on the map side and a field,
model or workbook with most of the rows costs no more than a small one. Lists of scores and of
mismatches stay rows of ``scores``; nothing is gathered into one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from proofgrid.config import ScoringConfig
from proofgrid.functions import labels
from proofgrid.functions.typed import percent_accuracy, percent_exact
from proofgrid.operators.scoring import weight_of

DEFAULT = ScoringConfig()
BLOCK = ["workbook", "model"]


def _count() -> Column:
    return F.count(F.lit(1))


def field_evaluation(scores: DataFrame, keys: list[str] = BLOCK) -> DataFrame:
    """Per field over all rows, empty pairs included; fields with an empty side are left out."""
    return (
        scores.groupBy(*keys, "field")
        .agg(
            F.avg("similarity").alias("accuracy"),
            F.count_if("is_exact_match").alias("exact_matches"),
            _count().alias("total_records"),
            F.count_if("is_mismatch").alias("mismatched"),
            F.count("correct").alias("_truths"),
            F.count("predicted").alias("_predictions"),
        )
        .filter((F.col("_truths") > 0) & (F.col("_predictions") > 0))
        .drop("_truths", "_predictions")
    )


def overall_accuracy(
    fields: DataFrame, keys: list[str] = BLOCK, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Weighted mean of field accuracies."""
    weight = weight_of("field", cfg)
    return fields.groupBy(*keys).agg(
        (F.sum(F.col("accuracy") * weight) / F.sum(weight)).alias("overall_accuracy")
    )


def record_evaluation(scores: DataFrame) -> DataFrame:
    """Per record the mean similarity and the matches over fields with a truth.

    The ids are grouping keys: they depend on the row, and text in an aggregation buffer would
    force a sort.
    """
    return (
        scores.filter(F.col("correct").isNotNull())
        .groupBy(*BLOCK, "row_idx", "record_id", "subject_id")
        .agg(
            F.avg("similarity").alias("overall_accuracy"),
            F.count_if("is_exact_match").alias("matched_fields"),
            _count().alias("total_fields"),
        )
    )


def legacy_record_evaluation(scores: DataFrame) -> DataFrame:
    """Older rule: fields without a truth count as well."""
    return scores.groupBy(*BLOCK, "row_idx", "record_id", "subject_id").agg(
        F.avg("similarity").alias("overall_accuracy"),
        F.count_if("is_exact_match").alias("matched_fields"),
        _count().alias("total_fields"),
    )


def record_details(scores: DataFrame) -> DataFrame:
    """Record evaluation with a map from field to its result; a record has few fields."""
    result = F.struct(
        "correct", "predicted", "cer", "wer", "similarity", "is_exact_match"
    )
    return (
        scores.filter(F.col("correct").isNotNull())
        .groupBy(*BLOCK, "row_idx", "record_id", "subject_id")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("field", result))).alias("field_results"),
            F.avg("similarity").alias("overall_accuracy"),
            F.count_if("is_exact_match").alias("matched_fields"),
            _count().alias("total_fields"),
        )
    )


def is_perfect() -> Column:
    return F.col("matched_fields") == F.col("total_fields")


def perfect_records(records: DataFrame, keys: list[str] = BLOCK) -> DataFrame:
    perfect = F.count_if(is_perfect())
    return records.groupBy(*keys).agg(
        _count().alias("scored_records"),
        perfect.alias("perfect_records"),
        (perfect / _count()).alias("perfect_rate"),
        F.avg("overall_accuracy").alias("mean_accuracy"),
    )


def field_statistics(
    scores: DataFrame, keys: list[str] = BLOCK, first_record_fields_only: bool = False
) -> DataFrame:
    """Per field over rows with a truth: mean, matches, extremes and population deviation."""
    kept = scores.filter(F.col("correct").isNotNull())
    stats = kept.groupBy(*keys, "field").agg(
        F.avg("similarity").alias("average_accuracy"),
        F.count_if("is_exact_match").alias("exact_matches"),
        _count().alias("total_records"),
        (F.count_if("is_exact_match") / _count()).alias("match_rate"),
        F.min("similarity").alias("min_accuracy"),
        F.max("similarity").alias("max_accuracy"),
        F.stddev_pop("similarity").alias("std_accuracy"),
        F.min("row_idx").alias("_first_row"),
    )
    if first_record_fields_only:
        first = stats.groupBy(*keys).agg(F.min("_first_row").alias("_start"))
        stats = stats.join(first, keys).filter(F.col("_first_row") == F.col("_start"))
        stats = stats.drop("_start")
    return stats.drop("_first_row")


def accuracy_distribution(records: DataFrame, keys: list[str] = BLOCK) -> DataFrame:
    """Records per accuracy band and their share; every band has a row."""
    band = labels.accuracy_band("overall_accuracy")
    counted = records.groupBy(*keys).agg(
        _count().alias("_n"),
        *[F.count_if(band == name).alias(f"_{name}") for name in labels.BANDS],
    )
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("band"), F.col(f"_{name}").alias("count"))
            for name in labels.BANDS
        ]
    )
    return counted.select(*keys, "_n", F.inline(entries)).select(
        *keys, "band", "count", (F.col("count") / F.col("_n")).alias("percentage")
    )


def field_summary(statistics: DataFrame) -> DataFrame:
    """Field statistics with level, number to improve and suggestion."""
    return statistics.withColumns(
        {
            "level": labels.performance_level("average_accuracy"),
            "to_improve": F.col("total_records") - F.col("exact_matches"),
            "suggestion": labels.field_suggestion("average_accuracy", "match_rate"),
        }
    )


def evaluation_summary(
    scores: DataFrame, records: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """One row per block: all rows, weighted accuracy, perfect records."""
    per_field = scores.groupBy(*BLOCK, "field").agg(
        F.avg("similarity").alias("accuracy"),
        _count().alias("total_records"),
        F.count("correct").alias("_truths"),
        F.count("predicted").alias("_predictions"),
    )
    counted = (F.col("_truths") > 0) & (F.col("_predictions") > 0)
    weight = F.when(counted, weight_of("field", cfg))
    overall = per_field.groupBy(*BLOCK).agg(
        # Every row has one pair per mapped field.
        F.max("total_records").alias("total_records"),
        F.coalesce(F.sum(F.col("accuracy") * weight) / F.sum(weight), F.lit(0.0)).alias(
            "overall_accuracy"
        ),
        F.map_from_entries(
            F.collect_list(F.when(counted, F.struct("field", "accuracy")))
        ).alias("field_accuracies"),
    )
    return overall.join(
        perfect_records(records).select(*BLOCK, "perfect_records"), BLOCK, "left"
    ).withColumn("perfect_records", F.coalesce("perfect_records", F.lit(0)))


def model_comparison(
    scores: DataFrame, keys: list[str] = BLOCK, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Models side by side with their fields and, where ``is_total``, the model over all its fields.

    The total is the weighted mean of the field accuracies. Both levels are grouping sets over one
    relation of a row per field, so the scores are read once; a null model is a model like others.
    """
    fields = field_evaluation(scores, keys).withColumn("_weight", weight_of("field", cfg))
    levels = fields.groupingSets([[*keys, "field"], keys], *keys, "field").agg(
        F.max("accuracy").alias("_own"),
        (F.sum(F.col("accuracy") * F.col("_weight")) / F.sum("_weight")).alias("_weighted"),
        F.sum("exact_matches").alias("exact_matches"),
        F.sum("total_records").alias("total_records"),
        (F.grouping("field") == 1).alias("is_total"),
    )
    return levels.select(
        *keys, "field", "is_total",
        F.when(F.col("is_total"), F.col("_weighted")).otherwise(F.col("_own")).alias("accuracy"),
        "exact_matches", "total_records",
    )


# --- documents -----------------------------------------------------------------------------------


def either_side() -> Column:
    return F.col("correct").isNotNull() | F.col("predicted").isNotNull()


def document_field_evaluation(scores: DataFrame) -> DataFrame:
    """Per model and field: cases with a value, exact ones and their rate."""
    kept = scores.filter(F.col("correct").isNotNull() | F.col("predicted").isNotNull())
    return kept.groupBy("workbook", "model", "field").agg(
        _count().alias("total_cases"),
        F.count_if("is_exact_match").alias("correct_cases"),
        (F.count_if("is_exact_match") / _count()).alias("accuracy_rate"),
    )


def document_summary(
    pair_map: DataFrame, fields: DataFrame, cases: DataFrame
) -> DataFrame:
    """Per workbook: mapped fields, case rows and the mean of the field rates.

    A mapped field without any value has rate 0 and counts.
    """
    rates = pair_map.join(
        fields.select("workbook", "model", "field", "accuracy_rate"),
        ["workbook", "model", "field"], "left",
    )
    summed = rates.groupBy("workbook").agg(
        _count().alias("total_fields"),
        F.avg(F.coalesce("accuracy_rate", F.lit(0.0))).alias("overall_accuracy"),
    )
    return cases.join(summed, "workbook", "left").select(
        "workbook",
        F.coalesce("total_fields", F.lit(0)).cast("bigint").alias("total_fields"),
        "total_cases",
        F.coalesce("overall_accuracy", F.lit(0.0)).alias("overall_accuracy"),
    )


def document_model_accuracy(scores: DataFrame) -> DataFrame:
    """Per model over all its pairs: exact over total."""
    kept = scores.filter(F.col("correct").isNotNull() | F.col("predicted").isNotNull())
    return kept.groupBy("workbook", "model").agg(
        _count().alias("total_fields"),
        F.count_if("is_exact_match").alias("correct_fields"),
        (F.count_if("is_exact_match") / _count()).alias("accuracy_rate"),
    )


def document_record_evaluation(scores: DataFrame) -> DataFrame:
    """Per record the share of exact fields, in all and per field type.

    The first step counts per record and type, the second sums these few rows per record.
    """
    kept = scores.filter(F.col("correct").isNotNull() | F.col("predicted").isNotNull())
    per_type = kept.groupBy("workbook", "model", "row_idx", "case_id", "field_type").agg(
        F.count_if("is_exact_match").alias("_exact"), _count().alias("_n")
    )
    return per_type.groupBy("workbook", "model", "row_idx", "case_id").agg(
        (F.sum("_exact") / F.sum("_n")).alias("overall_accuracy"),
        F.sum("_n").alias("total_fields"),
        F.sum("_exact").alias("matched_fields"),
        F.map_from_entries(
            F.collect_list(F.struct("field_type", F.col("_exact") / F.col("_n")))
        ).alias("field_type_accuracy"),
    )


CASE_KEYS = ["workbook", "model", "case_id", "field"]


def document_cases(scores: DataFrame) -> DataFrame:
    """One row per model, case and field: of rows with the same case the last one counts.

    ``row_idx`` tells the rows of a sheet apart; ``last_row`` is the one that counts. Only numbers are
    aggregated, texts come from ``document_cases_with_texts``.
    """
    last = [
        F.max_by(name, "row_idx").alias(f"_{name}")
        for name in ("is_exact_match", "cer", "wer", "field_order")
    ]
    return (
        scores.filter(either_side()).groupBy(*CASE_KEYS)
        .agg(*last, F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))
        .select(
            *CASE_KEYS, "first_row", "last_row", F.col("_field_order").alias("field_order"),
            percent_exact(F.col("_is_exact_match")).alias("accuracy"),
            percent_accuracy(F.col("_cer")).alias("cer_accuracy"),
            percent_accuracy(F.col("_wer")).alias("wer_accuracy"),
        )
    )


def document_cases_with_texts(scores: DataFrame) -> DataFrame:
    """``document_cases`` with ``ai_value`` and ``human_value``; ``scores`` should be a stored table.

    Texts are read for the rows that count only.
    """
    texts = scores.filter(either_side()).select(
        *CASE_KEYS, F.col("row_idx").alias("last_row"),
        F.coalesce("predicted", F.lit("")).alias("ai_value"),
        F.coalesce("correct", F.lit("")).alias("human_value"),
    )
    cases = document_cases(scores)
    return texts.join(cases, [*CASE_KEYS, "last_row"]).select(
        *[c for c in cases.columns], "ai_value", "human_value"
    )


def document_case_accuracy(cases: DataFrame) -> DataFrame:
    return cases.groupBy("workbook", "model", "case_id").agg(
        F.avg("accuracy").alias("case_accuracy"), _count().alias("fields"),
        F.min("first_row").alias("first_row"),
    )


def document_cases_nested(cases: DataFrame) -> DataFrame:
    """Per model and case a map from field to its values; a case has few fields."""
    values = F.struct("accuracy", "cer_accuracy", "wer_accuracy", "ai_value", "human_value")
    return cases.groupBy("workbook", "model", "case_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", values))).alias("fields")
    )


# --- first rows and last wins --------------------------------------------------------------------


def first_mismatches(scores: DataFrame, n: int = 3, keys: list[str] = BLOCK) -> DataFrame:
    """The first ``n`` mismatches per field in row order.

    Spark keeps the first ``n`` of a field in each task before the shuffle, so a hot field is small after it.
    """
    in_order = Window.partitionBy(*keys, "field").orderBy("row_idx")
    ranked = scores.filter("is_mismatch").withColumn("rank", F.row_number().over(in_order))
    return ranked.filter(F.col("rank") <= n)


def last_wins(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Of the rows with the same key the last one in ``order``; null keys are equal to each other.

    ``df`` should be a stored table in which a key has each ``order`` once. The last places are found
    from numbers alone, then the values are read for these rows only.
    """
    last = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(order).alias("_last"))
    same = F.col(order) == F.col("_last")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return df.join(last, same, "left_semi").select(*keys, *values)


def ordered_fields(scores: DataFrame, keys: list[str] = BLOCK) -> DataFrame:
    """Distinct fields with the place where each was first seen."""
    return scores.groupBy(*keys, "field").agg(F.min("field_order").alias("position"))
