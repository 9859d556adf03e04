"""Catalogue: certificate scoring, labels, aggregates and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from proofgrid.catalog import inputs
from proofgrid.catalog.inputs import (
    FIELDS_SQL,
    OVERALL_SQL,
    RECORDS_SQL,
    WEIGHT_SQL,
    cert_sql,
    part_sql,
)
from proofgrid.catalog.registry import register, table
from proofgrid.config import ScoringConfig
from proofgrid.functions import labels, metrics, textnorm
from proofgrid.operators import aggregate, joins, reports, scoring, wide
from proofgrid.plans.storage import stored
from proofgrid.sources.tables import spread

ROW = ["workbook", "model", "row_idx", "field"]
ROW_SQL = "workbook, model, row_idx, field"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _cert(name: str, columns: Callable[[], dict], select: str) -> None:
    """A projection of the certificate scores, row by row."""
    register(
        name,
        lambda spark, folder: inputs.certificate_scores(spark, folder).select(
            *ROW, *[c.alias(n) for n, c in columns().items()]
        ),
        cert_sql(f"select {ROW_SQL}, {select} from scores"),
    )


def _part(name: str, columns: Callable[[], dict], select: str) -> None:
    register(
        name,
        lambda spark, folder: inputs.part_pairs(spark, folder).select(
            *ROW, *[c.alias(n) for n, c in columns().items()]
        ),
        part_sql(f"select {ROW_SQL}, {select} from scores join clean using ({ROW_SQL})"),
    )


# --- text functions and rates --------------------------------------------------------------------

L, R = "correct", "predicted"
_part("fn01_normalize_text", lambda: {"cleaned": textnorm.normalize_text(R)}, "nr as cleaned")
_part("fn02_normalize_words", lambda: {"cleaned": textnorm.normalize_words(R)}, "wr as cleaned")
_part(
    "fn03_edit_distance",
    lambda: {"distance": metrics.char_distance(textnorm.normalize_text(L), textnorm.normalize_text(R))
     .cast("bigint")},
    "levenshtein(nl, nr) as distance",
)
_part(
    "fn04_error_rate",
    lambda: {"rate": F.round(metrics.cer_clean(textnorm.normalize_text(L), textnorm.normalize_text(R)), 6)},
    "round(cer, 6) as rate",
)
_part("fn05_cer", lambda: {"cer": F.round(metrics.cer(L, R), 6)}, "round(cer, 6) as cer")
_part("fn06_wer", lambda: {"wer": F.round(metrics.wer(L, R), 6)}, "round(wer, 6) as wer")
_part(
    "fn07_cer_accuracy", lambda: {"accuracy": F.round(metrics.cer_accuracy(L, R), 6)},
    "round(1 - cer, 6) as accuracy",
)
_part(
    "fn08_wer_accuracy", lambda: {"accuracy": F.round(metrics.wer_accuracy(L, R), 6)},
    "round(greatest(0.0, 1 - wer), 6) as accuracy",
)
_part(
    "fn09_similarity", lambda: {"similarity": F.round(metrics.similarity(L, R), 6)},
    "round(similarity, 6) as similarity",
)
register(
    "fn10_ocr_metrics",
    lambda spark, folder: rounded(
        inputs.part_pairs(spark, folder).select(*ROW, metrics.ocr_metrics(L, R).alias("m"))
        .select(*ROW, "m.*"),
        "cer", "wer", "accuracy", "similarity",
    ),
    part_sql(
        f"select {ROW_SQL}, round(cer, 6) as cer, round(wer, 6) as wer,"
        " round(similarity, 6) as accuracy, round(similarity, 6) as similarity from scores"
    ),
)
_part(
    "fn11_normalize_folded",
    lambda: {"cleaned": textnorm.normalize_folded(F.concat(F.lit("【A】（"), R, F.lit("）")))},
    "case when scores.predicted is null then '' else concat('[a](', lower(nr), ')') end as cleaned",
)
_part(
    "fn04_reference_denominator",
    lambda: {"rate": F.round(metrics.cer(L, R, ScoringConfig(denominator="reference")), 6)},
    "round(case when nl = nr then 0.0::double when nl = '' or nr = '' then 1.0::double"
    " else levenshtein(nl, nr) / length(nl) end, 6) as rate",
)
for _name, _cfg in {
    "fn12_gestalt": ScoringConfig(method="gestalt"),
    "fn13_gestalt_trim": ScoringConfig(method="gestalt_trim"),
}.items():
    register(
        _name,
        lambda spark, folder, cfg=_cfg: inputs.part_pairs(spark, folder).select(
            *ROW, F.round(metrics.similarity(L, R, cfg), 6).alias("similarity")
        ),
    )
register(
    "fn14_opcode_rates",
    lambda spark, folder: inputs.part_pairs(spark, folder).select(
        *ROW, F.round(metrics.opcode_cer(L, R), 6).alias("cer"),
        F.round(metrics.opcode_wer(L, R), 6).alias("wer"),
    ),
)


def _document_text_pairs(spark, folder):
    """Whole texts against a copy with changed letters."""
    return spread(table(spark, folder, "documents"), rows=1_000).select(
        F.lit("documents").alias("workbook"), F.col("source").alias("model"),
        F.col("doc_id").alias("row_idx"), F.lit("text").alias("field"),
        F.lit(0).alias("field_order"), F.col("text").alias("correct"),
        F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeu", "eao"))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.col("text"), F.lit(" end of page")))
        .otherwise(F.col("text")).alias("predicted"),
    )


register(
    "fn06_whole_documents",
    lambda spark, folder: rounded(
        scoring.score_pairs(
            _document_text_pairs(spark, folder), ScoringConfig(edit_engine="auto")
        ).select(*ROW, "cer", "wer", "similarity", "is_exact_match"),
        "cer", "wer", "similarity",
    ),
)

# --- predicates ----------------------------------------------------------------------------------

_cert("flt04_exact_match", lambda: {"is_exact_match": F.col("is_exact_match")}, "is_exact_match")
_cert("flt05_mismatch", lambda: {"is_mismatch": F.col("is_mismatch")}, "is_mismatch")
register(
    "flt01_record_pairs",
    lambda spark, folder: scoring.record_pairs(inputs.certificate_pairs(spark, folder)).select(
        *ROW, "correct", "predicted"
    ),
    cert_sql(
        f"select {ROW_SQL}, correct, coalesce(predicted, '') as predicted from pairs"
        " where correct is not null",
        scored=False,
    ),
)
register(
    "flt06_fields_with_data",
    lambda spark, folder: aggregate.field_evaluation(
        inputs.certificate_scores(spark, folder).withColumn(
            "predicted", F.when(F.col("workbook") != "wb_3", F.col("predicted"))
        )
    ).select("workbook", "model", "field", "total_records"),
    cert_sql(
        "select workbook, model, field, count(*) as total_records from"
        " (select *, case when workbook <> 'wb_3' then predicted end as p2 from pairs)"
        " group by all having count(correct) > 0 and count(p2) > 0",
        scored=False,
    ),
)
register(
    "flt07_errors_only",
    lambda spark, folder: rounded(
        scoring.errors_only(inputs.certificate_scores(spark, folder)).select(*ROW, "similarity"),
        "similarity",
    ),
    cert_sql(
        f"select {ROW_SQL}, round(similarity, 6) as similarity from scores where not is_exact_match"
    ),
)
register(
    "flt09_scorable_records",
    lambda spark, folder: aggregate.record_evaluation(inputs.certificate_scores(spark, folder))
    .select("workbook", "model", "row_idx", "total_fields"),
    cert_sql(
        "select workbook, model, row_idx, count(*) as total_fields from pairs"
        " where correct is not null group by all",
        scored=False,
    ),
)
register(
    "flt11_out_of_bounds",
    lambda spark, folder: scoring.out_of_bounds(inputs.document_scores(spark, folder), ("cer",))
    .select(*ROW, "out_of_bounds"),
    inputs.document_sql(
        f"select {ROW_SQL}, 'cer' as out_of_bounds from scores where not cer between 0 and 1"
    ),
)

# --- labels --------------------------------------------------------------------------------------

SIM, CER, EXACT = "similarity", "cer", "is_exact_match"


def _case(value: str, operator: str, steps, otherwise: str) -> str:
    rules = " ".join(f"when {value} {operator} {limit} then '{label}'" for limit, label in steps)
    return f"case {rules} else '{otherwise}' end"


_cert(
    "fn15_ocr_level", lambda: {"level": labels.ocr_level(CER)},
    _case("cer", "<=", [(0.05, "優秀"), (0.1, "良好"), (0.2, "可接受"), (0.4, "需改進")], "不合格")
    + " as level",
)
CER_SUGGESTION_SQL = _case(
    "cer", "<=",
    [
        (0, "完美識別 - 無需改進"), (0.1, "優秀識別 - 僅有微小錯誤，可能是格式問題"),
        (0.2, "良好識別 - 少量字元錯誤，建議檢查OCR預處理"),
        (0.4, "普通識別 - 中等程度錯誤，需要改進訓練資料品質"),
        (0.6, "較差識別 - 較多字元錯誤，建議增加相似樣本訓練"),
    ],
    "差劣識別 - 嚴重錯誤，需要重新檢查輸入資料或模型",
)
_cert("fn16_cer_suggestion", lambda: {"suggestion": labels.cer_suggestion(CER)},
      CER_SUGGESTION_SQL + " as suggestion")
_cert(
    "fn17_similarity_suggestion", lambda: {"suggestion": labels.similarity_suggestion(SIM)},
    _case(
        "similarity", ">",
        [
            (0.8, "格式標準化 - 相似度高，主要是格式問題"),
            (0.5, "內容檢查 - 部分正確，需要細節調整"),
            (0.2, "重新訓練 - 識別錯誤，需要加強相關資料訓練"),
        ],
        "完全重做 - 識別失敗，需要重新處理或手動檢查",
    )
    + " as suggestion",
)


def level_sql(value: str) -> str:
    return _case(value, ">=", [(0.9, "優秀"), (0.7, "良好"), (0.5, "普通")], "需改進")


_cert(
    "fn18_performance_level",
    lambda: {"level": labels.performance_level(SIM), "short": labels.performance_level_short(SIM)},
    level_sql("similarity") + " as level, "
    + _case("similarity", ">=", [(0.9, "優秀"), (0.7, "良好")], "需改進") + " as short",
)
ERROR_TYPE_SQL = _case("similarity", ">", [(0.7, "格式差異"), (0.3, "內容錯誤")], "完全不符")
PRIORITY_SQL = _case("similarity", "<", [(0.3, "高"), (0.7, "中")], "低")
_cert("fn19_error_type", lambda: {"error_type": labels.error_type(SIM)}, ERROR_TYPE_SQL + " as error_type")
_cert("fn20_priority", lambda: {"priority": labels.error_priority(SIM)}, PRIORITY_SQL + " as priority")


def status_sql(done: str, bad: str, partly: str, exact="is_exact_match", sim="similarity") -> str:
    return (
        f"case when {exact} then '{done}' when {sim} < 0.5 then '{bad}' else '{partly}' end"
    )


_cert(
    "fn21_status",
    lambda: {
        "status": labels.status_text(EXACT, SIM), "icon": labels.status_icon(EXACT, SIM),
        "remark": labels.remark_text(EXACT, SIM), "cer_icon": labels.cer_status_icon(CER),
    },
    status_sql("完全匹配", "不匹配", "部分匹配") + " as status, "
    + status_sql("✅", "❌", "⚠️") + " as icon, "
    + status_sql("完全匹配", "需要改進", "部分匹配") + " as remark, "
    + "case when cer = 0 then '✅' when cer <= 0.2 then '⚠️' else '❌' end as cer_icon",
)
STATISTICS_SQL = """statistics as materialized (
  select workbook, model, field, avg(similarity) as average_accuracy,
    count(*) filter (where is_exact_match) as exact_matches, count(*) as total_records,
    count(*) filter (where is_exact_match) / count(*) as match_rate,
    min(similarity) as min_accuracy, max(similarity) as max_accuracy,
    stddev_pop(similarity) as std_accuracy
  from scores where correct is not null group by all)"""
FIELD_SUGGESTION_SQL = """case
  when round(average_accuracy, 9) >= 0.9 and match_rate >= 0.8 then '表現優異，維持現有訓練方式'
  when round(average_accuracy, 9) >= 0.7 then '表現良好，可針對錯誤案例加強訓練'
  when round(average_accuracy, 9) >= 0.5 then '需要改進，建議增加訓練資料並調整模型參數'
  else '表現不佳，需要重新檢視訓練資料和模型架構' end"""
register(
    "fn22_field_suggestion",
    lambda spark, folder: aggregate.field_statistics(inputs.certificate_scores(spark, folder))
    .select("workbook", "model", "field",
            labels.field_suggestion("average_accuracy", "match_rate").alias("suggestion")),
    cert_sql(
        f"select workbook, model, field, {FIELD_SUGGESTION_SQL} as suggestion from statistics",
        STATISTICS_SQL,
    ),
)
BAND_SQL = """case when round(overall_accuracy, 12) >= 0.9 then 'excellent'
  when round(overall_accuracy, 12) >= 0.7 then 'good' when round(overall_accuracy, 12) >= 0.5 then 'fair'
  else 'poor' end"""
BAND_NAMES_SQL = """(values
  ('excellent', '優秀 (90-100%)', 'AI識別表現優異，準確度很高'),
  ('good', '良好 (70-90%)', 'AI識別表現良好，有少量錯誤'),
  ('fair', '普通 (50-70%)', 'AI識別表現普通，需要改進'),
  ('poor', '需改進 (0-50%)', 'AI識別表現不佳，需要重新訓練')) b(band, band_name, description)"""
register(
    "fn23_band_description",
    lambda spark, folder: aggregate.record_evaluation(inputs.certificate_scores(spark, folder))
    .withColumn("band", labels.accuracy_band("overall_accuracy"))
    .select("workbook", "model", "row_idx", "band", labels.band_name("band").alias("band_name"),
            labels.band_description("band").alias("description")),
    cert_sql(
        "select workbook, model, row_idx, r.band, band_name, description from"
        f" (select *, {BAND_SQL} as band from records) r join {BAND_NAMES_SQL} on r.band = b.band",
        RECORDS_SQL,
    ),
)
_cert(
    "fn24_percent_text",
    lambda: {"one": labels.percent_text(SIM, 1), "two": labels.percent_text(SIM, 2),
     "three": labels.fixed_text(SIM, 3)},
    "printf('%.1f%%', similarity * 100) as one, printf('%.2f%%', similarity * 100) as two,"
    " printf('%.3f', similarity) as three",
)
_cert(
    "fn25_match_text",
    lambda: {"exact": labels.yes_no(EXACT), "difference": labels.difference_text(EXACT, SIM)},
    "case when is_exact_match then '是' else '否' end as exact,"
    " case when is_exact_match then '完全相同'"
    " else concat('相似度: ', printf('%.1f%%', similarity * 100)) end as difference",
)

# --- aggregates ----------------------------------------------------------------------------------


def _fields(spark, folder):
    return aggregate.field_evaluation(inputs.certificate_scores(spark, folder))


register(
    "agg01_field_evaluation",
    lambda spark, folder: rounded(
        aggregate.field_evaluation(inputs.part_scores(spark, folder)), "accuracy"
    ),
    part_sql(
        "select workbook, model, field, round(accuracy, 6) as accuracy, exact_matches,"
        " total_records, mismatched from fields",
        FIELDS_SQL,
    ),
)
register(
    "agg01_mismatched_pairs",
    lambda spark, folder: scoring.mismatches(inputs.certificate_scores(spark, folder)).select(
        *ROW, "correct", "predicted"
    ),
    cert_sql(f"select {ROW_SQL}, correct, predicted from scores where is_mismatch"),
)
register(
    "agg02_all_fields",
    lambda spark, folder: rounded(_fields(spark, folder), "accuracy"),
    cert_sql(
        "select workbook, model, field, round(accuracy, 6) as accuracy, exact_matches,"
        " total_records, mismatched from fields",
        FIELDS_SQL,
    ),
)


def overall_by_model(spark, folder):
    """Flagship: weighted accuracy per model over all workbooks."""
    fields = aggregate.field_evaluation(inputs.certificate_scores(spark, folder), ["model"])
    return rounded(aggregate.overall_accuracy(fields, ["model"]), "overall_accuracy")


FIELDS_BY_MODEL_SQL = FIELDS_SQL.replace("select workbook, model, field", "select model, field")
register(
    "agg03_overall",
    overall_by_model,
    cert_sql(
        "select model, round(overall_accuracy, 6) as overall_accuracy from overall",
        FIELDS_BY_MODEL_SQL,
        OVERALL_SQL.replace("select workbook, model,", "select model,"),
    ),
)
register(
    "jn02_weights",
    lambda spark, folder: _fields(spark, folder).select(
        "workbook", "model", "field", scoring.weight_of("field").alias("weight")
    ),
    cert_sql(
        f"select workbook, model, field, ({WEIGHT_SQL})::double as weight from fields", FIELDS_SQL
    ),
)
_RECORD_SELECT = (
    "select workbook, model, row_idx, record_id, subject_id,"
    " round(overall_accuracy, 6) as overall_accuracy, matched_fields, total_fields from records"
)
register(
    "agg04_record_evaluation",
    lambda spark, folder: rounded(
        aggregate.record_evaluation(inputs.part_scores(spark, folder)), "overall_accuracy"
    ),
    part_sql(_RECORD_SELECT, RECORDS_SQL),
)
register(
    "agg04_record_details",
    lambda spark, folder: aggregate.record_details(inputs.certificate_scores(spark, folder)).select(
        "workbook", "model", "row_idx", F.explode("field_results").alias("field", "result")
    ).select("workbook", "model", "row_idx", "field", F.round("result.cer", 6).alias("cer")),
    cert_sql(f"select {ROW_SQL}, round(cer, 6) as cer from scores where correct is not null"),
)
register(
    "agg04_legacy_records",
    lambda spark, folder: rounded(
        aggregate.legacy_record_evaluation(inputs.certificate_scores(spark, folder)),
        "overall_accuracy",
    ),
    cert_sql(_RECORD_SELECT, RECORDS_SQL.replace("where correct is not null ", "")),
)
register(
    "agg05_all_records",
    lambda spark, folder: rounded(
        wide.score_records(inputs.certificates(spark, folder)).select(
            "workbook", "model", "row_idx", F.col("編號").cast("string").alias("record_id"),
            F.col("受編").alias("subject_id"), "overall_accuracy", "matched_fields", "total_fields",
        ),
        "overall_accuracy",
    ),
    cert_sql(_RECORD_SELECT, RECORDS_SQL),
)


def _records(spark, folder):
    return aggregate.record_evaluation(inputs.certificate_scores(spark, folder))


register(
    "agg06_perfect_records",
    lambda spark, folder: rounded(
        aggregate.perfect_records(_records(spark, folder)).drop("mean_accuracy"), "perfect_rate"
    ),
    cert_sql(
        "select workbook, model, count(*) as scored_records,"
        " count(*) filter (where matched_fields = total_fields) as perfect_records,"
        " round(count(*) filter (where matched_fields = total_fields) / count(*), 6) as perfect_rate"
        " from records group by all",
        RECORDS_SQL,
    ),
)
STAT_NUMBERS = ("average_accuracy", "match_rate", "min_accuracy", "max_accuracy", "std_accuracy")
STAT_SELECT = (
    "workbook, model, field, round(average_accuracy, 6) as average_accuracy, exact_matches,"
    " total_records, round(match_rate, 6) as match_rate, round(min_accuracy, 6) as min_accuracy,"
    " round(max_accuracy, 6) as max_accuracy, round(std_accuracy, 6) as std_accuracy"
)
register(
    "agg07_field_statistics",
    lambda spark, folder: rounded(
        aggregate.field_statistics(inputs.certificate_scores(spark, folder)), *STAT_NUMBERS
    ),
    cert_sql(f"select {STAT_SELECT} from statistics", STATISTICS_SQL),
)
register(
    "agg07_first_record_fields",
    lambda spark, folder: rounded(
        aggregate.field_statistics(
            inputs.certificate_scores(spark, folder), first_record_fields_only=True
        ),
        *STAT_NUMBERS,
    ),
    cert_sql(
        f"select {STAT_SELECT} from statistics where (workbook, model, field) in"
        " (select (workbook, model, field) from scores where correct is not null"
        " and (workbook, model, row_idx) in (select (workbook, model, min(row_idx)) from scores"
        " where correct is not null group by workbook, model))",
        STATISTICS_SQL,
    ),
)
DISTRIBUTION_SQL = f"""distribution as materialized (
  select k.workbook, k.model, b.band, b.band_name, b.description,
    count(r.band) as count, count(r.band) / any_value(k.n) as percentage
  from (select workbook, model, count(*) as n from records group by all) k
  cross join {BAND_NAMES_SQL}
  left join (select *, {BAND_SQL} as band from records) r
    on r.workbook = k.workbook and r.model = k.model and r.band = b.band
  group by k.workbook, k.model, b.band, b.band_name, b.description)"""
register(
    "agg08_distribution",
    lambda spark, folder: rounded(
        aggregate.accuracy_distribution(_records(spark, folder)), "percentage"
    ),
    cert_sql(
        'select workbook, model, band, "count", round(percentage, 6) as percentage from distribution',
        RECORDS_SQL, DISTRIBUTION_SQL,
    ),
)
SUMMARY_SQL = """summary as materialized (
  select o.workbook, o.model, n.total_records, o.overall_accuracy, p.perfect_records
  from overall o
  join (select workbook, model, count(distinct row_idx) as total_records from pairs group by all) n
    using (workbook, model)
  join (select workbook, model, count(*) filter (where matched_fields = total_fields)
    as perfect_records from records group by all) p using (workbook, model))"""


def _summary(spark, folder):
    scores = inputs.certificate_scores(spark, folder)
    return aggregate.evaluation_summary(scores, aggregate.record_evaluation(scores))


register(
    "agg09_summary",
    lambda spark, folder: rounded(
        _summary(spark, folder).select(
            "workbook", "model", "total_records", "overall_accuracy", "perfect_records",
            F.explode_outer("field_accuracies").alias("field", "accuracy"),
        ),
        "overall_accuracy", "accuracy",
    ),
    cert_sql(
        "select s.workbook, s.model, s.total_records, round(s.overall_accuracy, 6) as overall_accuracy,"
        " perfect_records, f.field, round(f.accuracy, 6) as accuracy from summary s"
        " left join fields f on f.workbook = s.workbook and f.model = s.model",
        FIELDS_SQL, OVERALL_SQL, RECORDS_SQL, SUMMARY_SQL,
    ),
)
FIELD_SUMMARY_SELECT = (
    f"select {STAT_SELECT}, {level_sql('round(average_accuracy, 9)')} as level,"
    f" total_records - exact_matches as to_improve, {FIELD_SUGGESTION_SQL} as suggestion"
    " from statistics"
)
register(
    "agg10_field_summary",
    lambda spark, folder: rounded(
        aggregate.field_summary(
            aggregate.field_statistics(inputs.certificate_scores(spark, folder))
        ),
        *STAT_NUMBERS,
    ),
    cert_sql(FIELD_SUMMARY_SELECT, STATISTICS_SQL),
)
register(
    "agg11_mean_record_accuracy",
    lambda spark, folder: rounded(
        aggregate.perfect_records(_records(spark, folder), ["model"]).select(
            "model", "mean_accuracy"
        ),
        "mean_accuracy",
    ),
    cert_sql(
        "select model, round(avg(overall_accuracy), 6) as mean_accuracy from records group by all",
        RECORDS_SQL,
    ),
)
register(
    "agg17_batch_summary",
    lambda spark, folder: rounded(
        _fields(spark, folder)
        .join(aggregate.overall_accuracy(_fields(spark, folder)), ["workbook", "model"])
        .select("workbook", "model", "field", "accuracy", "overall_accuracy"),
        "accuracy", "overall_accuracy",
    ),
    cert_sql(
        "select workbook, model, field, round(accuracy, 6) as accuracy,"
        " round(overall_accuracy, 6) as overall_accuracy"
        " from fields join overall using (workbook, model)",
        FIELDS_SQL, OVERALL_SQL,
    ),
)
register(
    "agg19_match_rate",
    lambda spark, folder: _fields(spark, folder).select(
        "workbook", "model", "field",
        F.round(F.col("exact_matches") / F.col("total_records"), 6).alias("match_rate"),
        (F.col("total_records") - F.col("exact_matches")).alias("to_improve"),
    ),
    cert_sql(
        "select workbook, model, field, round(exact_matches / total_records, 6) as match_rate,"
        " total_records - exact_matches as to_improve from fields",
        FIELDS_SQL,
    ),
)
register(
    "agg20_model_comparison",
    lambda spark, folder: rounded(
        aggregate.model_comparison(inputs.certificate_scores(spark, folder)), "accuracy"
    ),
    cert_sql(
        "select workbook, model, field, false as is_total, round(accuracy, 6) as accuracy,"
        " exact_matches, total_records from fields union all"
        " select workbook, model, null, true, round(overall_accuracy, 6), n_exact, n from overall join"
        " (select workbook, model, sum(exact_matches)::bigint as n_exact,"
        " sum(total_records)::bigint as n from fields group by all) using (workbook, model)",
        FIELDS_SQL, OVERALL_SQL,
    ),
)

# --- limits, order, sets -------------------------------------------------------------------------

register(
    "lim01_first_mismatches",
    lambda spark, folder: aggregate.first_mismatches(
        inputs.certificate_scores(spark, folder), 3, ["model"]
    ).select("model", "field", F.col("rank").cast("bigint").alias("rank"), "row_idx", "correct",
             "predicted"),
    cert_sql(
        "select model, field, rank, row_idx, correct, predicted from (select *,"
        " row_number() over (partition by model, field order by row_idx) as rank"
        " from scores where is_mismatch) where rank <= 3"
    ),
)
register(
    "lim02_record_preview",
    lambda spark, folder: _records(spark, folder).orderBy("row_idx", "model").limit(2).select(
        "model", "row_idx", "matched_fields", "total_fields"
    ),
    cert_sql(
        "select model, row_idx, matched_fields, total_fields from records"
        " order by row_idx, model limit 2",
        RECORDS_SQL,
    ),
)
register(
    "srt01_input_order",
    lambda spark, folder: inputs.certificate_pairs(spark, folder)
    .select("model", "row_idx", "field_order", "field").orderBy("model", "row_idx", "field_order"),
    cert_sql(
        "select model, row_idx, field_order, field from pairs order by model, row_idx, field_order",
        scored=False,
    ),
)
register(
    "set01_concatenate",
    lambda spark, folder: scoring.errors_only(inputs.certificate_scores(spark, folder))
    .select(*ROW).unionByName(
        scoring.errors_only(inputs.part_scores(spark, folder)).select(*ROW)
    ),
    "select * from (" + cert_sql(f"select {ROW_SQL} from scores where not is_exact_match")
    + ") union all select * from ("
    + part_sql(f"select {ROW_SQL} from scores where not is_exact_match") + ")",
)
register(
    "set03_ordered_fields",
    lambda spark, folder: aggregate.ordered_fields(inputs.certificate_pairs(spark, folder)),
    cert_sql(
        "select workbook, model, field, min(field_order) as position from pairs group by all",
        scored=False,
    ),
)

# --- two tables ----------------------------------------------------------------------------------


def _sides(spark, folder):
    """Truth and predictions as separate tables; each leaves out the rows it has no value for."""
    pairs = inputs.certificate_pairs(spark, folder)
    keys = ["workbook", "model", "row_idx", "field"]
    left = pairs.filter("correct is not null").select(*keys, F.col("correct").alias("value"))
    right = pairs.filter("predicted is not null").select(*keys, F.col("predicted").alias("value"))
    return left, right, keys


register(
    "jn01_aligned_tables",
    lambda spark, folder: joins.align_tables(*_sides(spark, folder))[0],
    cert_sql(
        f"select {ROW_SQL}, correct, predicted from pairs where correct is not null",
        scored=False,
    ),
)
register(
    "jn01_unmatched_keys",
    lambda spark, folder: joins.align_tables(*_sides(spark, folder))[1],
    cert_sql(
        f"select {ROW_SQL}, case when predicted is null then 'prediction' else 'truth' end"
        " as missing_in from pairs where (correct is null) <> (predicted is null)",
        scored=False,
    ),
)



def _lists(spark, folder):
    """Two lists per field of unequal length: each side leaves out what it has no value for."""
    pairs = inputs.certificate_pairs(spark, folder)
    keys = ["workbook", "model", "field"]
    left = pairs.filter("correct is not null").select(*keys, "row_idx", F.col("correct").alias("value"))
    right = pairs.filter("predicted is not null").select(
        *keys, "row_idx", F.col("predicted").alias("value")
    )
    return joins.zip_tables(left, right, keys, "row_idx")


ZIP_CTE = """truths as materialized (
  select workbook, model, field, correct, row_number()
    over (partition by workbook, model, field order by row_idx) - 1 as position
  from pairs where correct is not null),
predictions as materialized (
  select workbook, model, field, predicted, row_number()
    over (partition by workbook, model, field order by row_idx) - 1 as position
  from pairs where predicted is not null)"""
register(
    "jn01_positional_zip",
    lambda spark, folder: _lists(spark, folder)[0],
    cert_sql(
        "select workbook, model, field, position, correct, predicted from truths join predictions"
        " using (workbook, model, field, position)",
        ZIP_CTE, scored=False,
    ),
)
register(
    "jn01_length_differences",
    lambda spark, folder: _lists(spark, folder)[1],
    cert_sql(
        "select *, concat('正確值和預測值的數量不一致: ', n_truths, ' vs ', n_predictions) as message"
        " from (select workbook, model, field, count(correct) as n_truths,"
        " count(predicted) as n_predictions from pairs group by all)"
        " where n_truths <> n_predictions",
        scored=False,
    ),
)

# --- report tables -------------------------------------------------------------------------------

LINES_SQL = """lines as materialized (
  select workbook, model, row_idx, record_id, subject_id, 'field' as kind, field_order, field,
    correct, predicted, similarity as accuracy, cer, wer, is_exact_match,
    null::bigint as matched_fields, null::bigint as total_fields
  from scores where correct is not null
  union all
  select workbook, model, row_idx, record_id, subject_id, 'KIND', ORDER, '整體準確度', null, null,
    overall_accuracy, null, null, null, matched_fields, total_fields from records)"""


def lines_sql(kind: str) -> str:
    return LINES_SQL.replace("KIND", kind).replace(
        "ORDER", "-1" if kind == "record" else "1000000"
    )


register(
    "rpt01_individual_lines",
    lambda spark, folder: rounded(
        reports.individual_lines(inputs.certificate_scores(spark, folder), "vs-1"),
        "accuracy", "cer_accuracy", "wer_accuracy",
    ),
    cert_sql(
        "select workbook, model, row_idx, subject_id, kind, field_order, field,"
        " round(accuracy, 6) as accuracy,"
        " case when kind = 'field' then round(greatest(0.0, 1 - cer), 6) end as cer_accuracy,"
        " case when kind = 'field' then round(greatest(0.0, 1 - wer), 6) end as wer_accuracy,"
        " 'vs-1' as value_set_id from lines",
        RECORDS_SQL, lines_sql("overall"),
    ),
)
register(
    "rpt03_detailed_lines",
    lambda spark, folder: rounded(
        reports.detailed_lines(inputs.certificate_scores(spark, folder)), "accuracy"
    ),
    cert_sql(
        "select workbook, model, row_idx, subject_id, kind, field_order, field, correct,"
        " case when kind = 'field' then coalesce(predicted, '') end as predicted,"
        " round(accuracy, 6) as accuracy, case when kind = 'field' then "
        + status_sql("完全匹配", "不匹配", "部分匹配", sim="accuracy")
        + " end as status, case when kind = 'field' then case when is_exact_match then '正確' else "
        + CER_SUGGESTION_SQL
        + " end end as note, matched_fields, total_fields from lines",
        RECORDS_SQL, lines_sql("record"),
    ),
)
register(
    "rpt04_field_summary",
    lambda spark, folder: rounded(
        reports.field_summary_table(inputs.certificate_scores(spark, folder)), *STAT_NUMBERS
    ),
    cert_sql(FIELD_SUMMARY_SELECT, STATISTICS_SQL),
)
def _summary_table(spark, folder):
    scores = stored(inputs.certificate_scores(spark, folder), "scores")
    summary = aggregate.evaluation_summary(scores, aggregate.record_evaluation(scores))
    return reports.summary_table(scores, summary)


register(
    "rpt05_summary_items",
    lambda spark, folder: rounded(_summary_table(spark, folder), "value", "match_rate"),
    cert_sql(
        "select workbook, model, 'field' as section, min(field_order) + 3 as item_order,"
        " field as item, round(avg(similarity), 6) as value, null as description,"
        " round(count(*) filter (where is_exact_match) / count(*), 6) as match_rate from scores"
        " group by workbook, model, field having count(correct) > 0 and count(predicted) > 0"
        " union all select workbook, model, 'item', item_order, item, round(value, 6), description,"
        " null from ("
        "select workbook, model, 0 as item_order, '總記錄數' as item, total_records::double as value,"
        " '處理的總記錄數量' as description from summary union all"
        " select workbook, model, 1, '整體準確度', overall_accuracy, '加權平均準確度' from summary"
        " union all select workbook, model, 2, '完全正確記錄', perfect_records::double,"
        " '所有欄位都完全匹配的記錄數' from summary)",
        FIELDS_SQL, OVERALL_SQL, RECORDS_SQL, SUMMARY_SQL,
    ),
)
register(
    "rpt06_record_summary",
    lambda spark, folder: rounded(
        reports.record_summary(_records(spark, folder)), "overall_accuracy", "match_rate"
    ),
    cert_sql(
        "select workbook, model, row_idx, record_id, subject_id,"
        " round(overall_accuracy, 6) as overall_accuracy, matched_fields, total_fields,"
        " round(matched_fields / total_fields, 6) as match_rate,"
        " concat('(', matched_fields, '/', total_fields, ' 完全匹配)') as match_text, "
        + level_sql("round(overall_accuracy, 12)") + " as level from records",
        RECORDS_SQL,
    ),
)
register(
    "rpt07_detailed_comparison",
    lambda spark, folder: rounded(
        reports.detailed_comparison(inputs.certificate_scores(spark, folder)), "similarity"
    ),
    cert_sql(
        "select workbook, model, row_idx, record_id, subject_id, field, field_order, "
        + status_sql("✅", "❌", "⚠️") + " as status_icon, "
        + status_sql("完全匹配", "不匹配", "部分匹配") + " as status,"
        " round(similarity, 6) as similarity, correct, coalesce(predicted, '') as predicted,"
        " case when is_exact_match then '是' else '否' end as exact,"
        " case when is_exact_match then '完全相同'"
        " else concat('相似度: ', printf('%.1f%%', similarity * 100)) end as difference, "
        + CER_SUGGESTION_SQL + " as suggestion from scores where correct is not null"
    ),
)
register(
    "rpt08_field_statistics",
    lambda spark, folder: rounded(
        reports.field_statistics_table(
            aggregate.field_statistics(inputs.certificate_scores(spark, folder))
        ),
        *STAT_NUMBERS,
    ),
    cert_sql(
        f"select {STAT_SELECT}, total_records - exact_matches as to_improve,"
        f" {level_sql('round(average_accuracy, 9)')} as level from statistics",
        STATISTICS_SQL,
    ),
)
register(
    "rpt09_error_analysis",
    lambda spark, folder: rounded(
        reports.error_analysis(inputs.certificate_scores(spark, folder)), "similarity"
    ),
    cert_sql(
        f"select workbook, model, row_idx, record_id, subject_id, field, {ERROR_TYPE_SQL}"
        " as error_type, round(similarity, 6) as similarity, correct,"
        f" coalesce(predicted, '') as predicted, {CER_SUGGESTION_SQL} as suggestion,"
        f" {PRIORITY_SQL} as priority from scores where correct is not null and not is_exact_match"
    ),
)
register(
    "rpt10_original_data",
    lambda spark, folder: reports.original_data(
        table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    ),
    "select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment from customer",
)
register(
    "rpt11_distribution",
    lambda spark, folder: rounded(
        reports.distribution_table(aggregate.accuracy_distribution(_records(spark, folder))),
        "percentage",
    ),
    cert_sql(
        'select workbook, model, band, "count", round(percentage, 6) as percentage, band_name,'
        " description from distribution",
        RECORDS_SQL, DISTRIBUTION_SQL,
    ),
)
register(
    "rpt12_record_details",
    lambda spark, folder: rounded(
        reports.record_detail_lines(inputs.certificate_scores(spark, folder)), "accuracy"
    ),
    cert_sql(
        "select workbook, model, row_idx, record_id, subject_id, kind, field_order, field, correct,"
        " predicted, round(accuracy, 6) as accuracy, case when kind = 'field' then "
        + status_sql("✅", "❌", "⚠️", sim="accuracy")
        + " end as status_icon, case when kind = 'field' then "
        + status_sql("完全匹配", "需要改進", "部分匹配", sim="accuracy")
        + " end as remark, matched_fields, total_fields from lines",
        RECORDS_SQL, lines_sql("record"),
    ),
)
register(
    "rpt13_mismatch_tables",
    lambda spark, folder: rounded(
        reports.mismatch_table(inputs.certificate_scores(spark, folder)), "similarity"
    ),
    cert_sql(
        "select workbook, model, field, row_idx, correct, predicted,"
        " round(similarity, 6) as similarity from scores where is_mismatch"
    ),
)


def _overall_report(spark, folder):
    scores = stored(inputs.certificate_scores(spark, folder), "scores")
    overall = aggregate.overall_accuracy(aggregate.field_evaluation(scores))
    return reports.overall_report(scores, overall)


register(
    "rpt14_overall_report",
    lambda spark, folder: rounded(_overall_report(spark, folder), "accuracy", "overall_accuracy"),
    cert_sql(
        "select workbook, model, field, 0 as rank, round(accuracy, 6) as accuracy, exact_matches,"
        " total_records, mismatched, greatest(mismatched - 3, 0) as more,"
        " round(overall_accuracy, 6) as overall_accuracy, null as correct, null as predicted"
        " from fields join overall using (workbook, model) union all"
        " select workbook, model, field, rank, null, null, null, null, null, null, correct, predicted"
        " from (select *, row_number() over (partition by workbook, model, field order by row_idx)"
        " as rank from scores where is_mismatch) where rank <= 3",
        FIELDS_SQL, OVERALL_SQL,
    ),
)
register(
    "rpt15_record_report",
    lambda spark, folder: rounded(
        reports.record_report(stored(inputs.certificate_scores(spark, folder), "scores")), "accuracy"
    ),
    cert_sql(
        "select workbook, model, '3 record' as section,"
        " case when kind = 'field' then field else subject_id end as item,"
        " round(accuracy, 6) as accuracy, matched_fields as matched, total_fields as total,"
        " row_idx, field_order, case when kind = 'field' then "
        + status_sql("✅", "❌", "⚠️", sim="accuracy")
        + " end as status_icon from lines union all"
        " select workbook, model, '1 overall', '', round(avg(overall_accuracy), 6),"
        " count(*) filter (where matched_fields = total_fields), count(*), null, null, null"
        " from records group by workbook, model union all"
        " select workbook, model, '2 field', field, round(average_accuracy, 6), exact_matches,"
        " total_records, null, null, null from statistics",
        RECORDS_SQL, STATISTICS_SQL, lines_sql("record"),
    ),
)
