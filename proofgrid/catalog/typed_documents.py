"""Catalogue: typed document scoring, its aggregates and its report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from proofgrid.catalog import inputs
from proofgrid.catalog.certificates import ROW, ROW_SQL, rounded
from proofgrid.catalog.inputs import document_sql
from proofgrid.catalog.registry import register
from proofgrid.functions import typed
from proofgrid.operators import aggregate, reports, scoring
from proofgrid.plans.storage import stored

L, R = "correct", "predicted"
LEN_SQL = "levenshtein(norm_correct, norm_predicted)"


def _pairs(name: str, columns: Callable[[], dict], select: str) -> None:
    """A projection of the document pairs, row by row."""
    register(
        name,
        lambda spark, folder: inputs.document_pairs(spark, folder).select(
            *ROW, *[c.alias(n) for n, c in columns().items()]
        ),
        document_sql(f"select {ROW_SQL}, {select} from pairs", scored=False),
    )


def _scores(name: str, columns: Callable[[], dict], select: str) -> None:
    register(
        name,
        lambda spark, folder: inputs.document_scores(spark, folder).select(
            *ROW, *[c.alias(n) for n, c in columns().items()]
        ),
        document_sql(f"select {ROW_SQL}, {select} from scores"),
    )


def _text(value: str) -> str:
    return f"trim(coalesce({value}, ''))"


def _date(value: str) -> str:
    return inputs.date_sql(_text(value))


_pairs("fn30_normalize_date", lambda: {"value": typed.normalize_date(R)}, _date(R) + " as value")
_pairs(
    "fn31_normalize_amount", lambda: {"value": typed.normalize_amount(R)},
    inputs.amount_sql(f"coalesce({R}, '')") + " as value",
)
_pairs(
    "fn32_normalize_boolean", lambda: {"value": typed.normalize_boolean(R)},
    inputs.boolean_sql(_text(R)) + " as value",
)
_scores("fn33_document_cer", lambda: {"cer": F.round("cer", 6)}, "round(cer, 6) as cer")
_scores("fn34_document_wer", lambda: {"wer": F.round("wer", 6)}, "round(wer, 6) as wer")
_scores(
    "fn35_document_distance",
    lambda: {"distance": F.levenshtein("norm_correct", "norm_predicted").cast("bigint")},
    f"{LEN_SQL} as distance",
)
_pairs(
    "fn36_date_similarity", lambda: {"similarity": F.round(typed.date_similarity(L, R), 6)},
    f"round(case when {_date(L)} = {_date(R)} then 1.0::double"
    f" when len(string_split({_date(L)}, '/')) = 3 and len(string_split({_date(R)}, '/')) = 3"
    f" then {inputs._parts_sql(_date(L), _date(R))} else 0.0::double end, 6) as similarity",
)
_pairs(
    "fn37_amount_similarity", lambda: {"similarity": typed.amount_similarity(L, R)},
    "case when " + inputs.amount_sql(f"coalesce({L}, '')") + " = "
    + inputs.amount_sql(f"coalesce({R}, '')") + " then 1.0::double else 0.0::double end as similarity",
)
_pairs(
    "fn38_boolean_similarity", lambda: {"similarity": typed.boolean_similarity(L, R)},
    f"case when {inputs.boolean_sql(_text(L))} = {inputs.boolean_sql(_text(R))}"
    " then 1.0::double else 0.0::double end as similarity",
)
_pairs(
    "fn39_text_similarity", lambda: {"similarity": F.round(typed.text_similarity(L, R), 6)},
    "round(case when coalesce(correct, '') = coalesce(predicted, '') then 1.0::double"
    " when coalesce(correct, '') = '' or coalesce(predicted, '') = '' then 0.0::double"
    " else greatest(0.0::double, 1 - levenshtein(correct, predicted) / length(correct)) end, 6)"
    " as similarity",
)
_pairs(
    "fn40_field_type", lambda: {"field_type": typed.field_type("field", L, R)},
    inputs.type_sql("field", L, R) + " as field_type",
)
_scores(
    "fn41_normalize_value",
    lambda: {"norm_correct": F.col("norm_correct"), "norm_predicted": F.col("norm_predicted")},
    "norm_correct, norm_predicted",
)
register(
    "fn41_normalize_value_expression",
    lambda spark, folder: inputs.document_pairs(spark, folder)
    .withColumn("field_type", typed.field_type("field", L, R))
    .select(*ROW, typed.normalize_value(R, "field_type").alias("value")),
    document_sql(f"select {ROW_SQL}, norm_predicted as value from scores"),
)
_scores(
    "fn42_field_similarity", lambda: {"similarity": F.round("similarity", 6)},
    "round(similarity, 6) as similarity",
)
register(
    "fn43_single_field",
    lambda spark, folder: rounded(
        inputs.document_scores(spark, folder).drop("case_id", "field_order", L, R),
        "cer", "wer", "similarity",
    ),
    document_sql(
        f"select {ROW_SQL}, field_type, norm_correct, norm_predicted, round(cer, 6) as cer,"
        " round(wer, 6) as wer, round(similarity, 6) as similarity, is_exact_match,"
        " error_description from scores"
    ),
)
_scores(
    "fn44_error_description", lambda: {"error_description": F.col("error_description")},
    "error_description",
)
BAND_SQL = (
    "case when {0} >= 90 then 'green' when {0} >= 70 then 'amber' when {0} < 50 then 'red' end"
)
_scores(
    "fn45_accuracy_band",
    lambda: {"band": typed.accuracy_band(typed.percent_accuracy(F.col("cer")))},
    BAND_SQL.format("greatest(0.0::double, 100 - cer * 100)") + " as band",
)
_scores(
    "fn46_percent_accuracy",
    lambda: {
        "accuracy": typed.percent_exact(F.col("is_exact_match")),
        "cer_accuracy": F.round(typed.percent_accuracy(F.col("cer")), 6),
        "wer_accuracy": F.round(typed.percent_accuracy(F.col("wer")), 6),
    },
    "case when is_exact_match then 100.0::double else 0.0::double end as accuracy,"
    " round(greatest(0.0::double, 100 - cer * 100), 6) as cer_accuracy,"
    " round(greatest(0.0::double, 100 - wer * 100), 6) as wer_accuracy",
)
register(
    "flt02_either_side",
    lambda spark, folder: scoring.either_side(inputs.document_pairs(spark, folder)).select(
        *ROW, L, R
    ),
    document_sql(
        f"select {ROW_SQL}, correct, predicted from pairs"
        " where correct is not null or predicted is not null",
        scored=False,
    ),
)

# --- aggregates ----------------------------------------------------------------------------------

KEPT = "where correct is not null or predicted is not null"
RATE_SQL = "count(*) filter (where is_exact_match)"
register(
    "agg12_record_evaluation",
    lambda spark, folder: rounded(
        aggregate.document_record_evaluation(inputs.document_scores(spark, folder)).drop(
            "field_type_accuracy"
        ),
        "overall_accuracy",
    ),
    document_sql(
        "select workbook, model, row_idx, case_id,"
        f" round({RATE_SQL} / count(*), 6) as overall_accuracy, count(*) as total_fields,"
        f" {RATE_SQL} as matched_fields from scores {KEPT} group by all"
    ),
)
register(
    "agg12_field_type_accuracy",
    lambda spark, folder: aggregate.document_record_evaluation(
        inputs.document_scores(spark, folder)
    ).select(
        "workbook", "model", "row_idx",
        F.explode("field_type_accuracy").alias("field_type", "accuracy"),
    ).withColumn("accuracy", F.round("accuracy", 6)),
    document_sql(
        "select workbook, model, row_idx, field_type,"
        f" round({RATE_SQL} / count(*), 6) as accuracy from scores {KEPT}"
        " group by workbook, model, row_idx, field_type"
    ),
)
DOC_FIELDS_SQL = f"""doc_fields as materialized (
  select workbook, model, field, count(*) as total_cases, {RATE_SQL} as correct_cases,
    {RATE_SQL} / count(*) as accuracy_rate from scores {KEPT} group by all)"""
register(
    "agg13_field_evaluation",
    lambda spark, folder: rounded(
        aggregate.document_field_evaluation(inputs.document_scores(spark, folder)),
        "accuracy_rate",
    ),
    document_sql(
        "select workbook, model, field, total_cases, correct_cases,"
        " round(accuracy_rate, 6) as accuracy_rate from doc_fields",
        DOC_FIELDS_SQL,
    ),
)
register(
    "agg15_model_accuracy",
    lambda spark, folder: rounded(
        aggregate.document_model_accuracy(inputs.document_scores(spark, folder)), "accuracy_rate"
    ),
    document_sql(
        f"select workbook, model, count(*) as total_fields, {RATE_SQL} as correct_fields,"
        f" round({RATE_SQL} / count(*), 6) as accuracy_rate from scores {KEPT} group by all"
    ),
)
CASES_SQL = f"""cases as materialized (
  select * from (
    select workbook, model, case_id, field, field_order,
      min(row_idx) over (partition by workbook, model, case_id, field) as first_row,
      case when is_exact_match then 100.0::double else 0.0::double end as accuracy,
      greatest(0.0::double, 100 - cer * 100) as cer_accuracy,
      greatest(0.0::double, 100 - wer * 100) as wer_accuracy,
      coalesce(predicted, '') as ai_value, coalesce(correct, '') as human_value,
      row_number() over (partition by workbook, model, case_id, field order by row_idx desc) as rn
    from scores {KEPT}) where rn = 1)"""


def _cases(spark, folder):
    return aggregate.document_cases(inputs.document_scores(spark, folder))


def _whole_cases(spark, folder):
    needed = ["row_idx", "field_order", L, R, "is_exact_match", "cer", "wer"]
    scores = inputs.document_scores(spark, folder).select(*aggregate.CASE_KEYS, *needed)
    scores = stored(scores, "document-scores")
    return aggregate.document_cases_with_texts(scores)


register(
    "set02_last_case_wins",
    lambda spark, folder: rounded(
        _whole_cases(spark, folder).drop("last_row"), "cer_accuracy", "wer_accuracy"
    ),
    document_sql(
        "select workbook, model, case_id, field, first_row, field_order, accuracy,"
        " round(cer_accuracy, 6) as cer_accuracy, round(wer_accuracy, 6) as wer_accuracy, ai_value,"
        " human_value from cases",
        CASES_SQL,
    ),
)
register(
    "agg16_case_accuracy",
    lambda spark, folder: rounded(
        aggregate.document_case_accuracy(_cases(spark, folder)).drop("first_row"), "case_accuracy"
    ),
    document_sql(
        "select workbook, model, case_id, round(avg(accuracy), 6) as case_accuracy,"
        " count(*) as fields from cases group by all",
        CASES_SQL,
    ),
)
register(
    "rsh17_nested_cases",
    lambda spark, folder: aggregate.document_cases_nested(_whole_cases(spark, folder)).select(
        "workbook", "model", "case_id", F.explode("fields").alias("field", "v")
    ).select("workbook", "model", "case_id", "field", "v.accuracy", "v.ai_value", "v.human_value"),
    document_sql(
        "select workbook, model, case_id, field, accuracy, ai_value, human_value from cases",
        CASES_SQL,
    ),
)
register(
    "rpt02_document_lines",
    lambda spark, folder: rounded(
        reports.document_lines(_cases(spark, folder)).drop("first_row"),
        "accuracy", "cer_accuracy", "wer_accuracy",
    ),
    document_sql(
        "select *, " + BAND_SQL.format("accuracy") + " as band, 'string' as value_set_id from ("
        "select workbook, model, case_id, 'field' as kind, field_order, field, accuracy,"
        " round(cer_accuracy, 6) as cer_accuracy, round(wer_accuracy, 6) as wer_accuracy from cases"
        " union all select workbook, model, case_id, 'overall', 1000000, '整體準確度',"
        " round(avg(accuracy), 6), null, null from cases group by workbook, model, case_id)",
        CASES_SQL,
    ),
)
