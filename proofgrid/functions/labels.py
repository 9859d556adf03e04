"""Levels, suggestions and status texts as CASE expressions.

The texts and limits below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from proofgrid.functions.textnorm import column

OCR_LEVELS = [(0.05, "優秀"), (0.1, "良好"), (0.2, "可接受"), (0.4, "需改進")]
OCR_LEVEL_ELSE = "不合格"

CER_SUGGESTIONS = [
    (0.0, "完美識別 - 無需改進"),
    (0.1, "優秀識別 - 僅有微小錯誤，可能是格式問題"),
    (0.2, "良好識別 - 少量字元錯誤，建議檢查OCR預處理"),
    (0.4, "普通識別 - 中等程度錯誤，需要改進訓練資料品質"),
    (0.6, "較差識別 - 較多字元錯誤，建議增加相似樣本訓練"),
]
CER_SUGGESTION_ELSE = "差劣識別 - 嚴重錯誤，需要重新檢查輸入資料或模型"

SIMILARITY_SUGGESTIONS = [
    (0.8, "格式標準化 - 相似度高，主要是格式問題"),
    (0.5, "內容檢查 - 部分正確，需要細節調整"),
    (0.2, "重新訓練 - 識別錯誤，需要加強相關資料訓練"),
]
SIMILARITY_SUGGESTION_ELSE = "完全重做 - 識別失敗，需要重新處理或手動檢查"

PERFORMANCE_LEVELS = [(0.9, "優秀"), (0.7, "良好"), (0.5, "普通")]
PERFORMANCE_LEVEL_ELSE = "需改進"

ERROR_TYPES = [(0.7, "格式差異"), (0.3, "內容錯誤")]
ERROR_TYPE_ELSE = "完全不符"

PRIORITIES = [(0.3, "高"), (0.7, "中")]
PRIORITY_ELSE = "低"

STATUS_TEXT = ("完全匹配", "不匹配", "部分匹配")
STATUS_ICON = ("✅", "❌", "⚠️")
REMARK_TEXT = ("完全匹配", "需要改進", "部分匹配")

FIELD_SUGGESTIONS = (
    "表現優異，維持現有訓練方式",
    "表現良好，可針對錯誤案例加強訓練",
    "需要改進，建議增加訓練資料並調整模型參數",
    "表現不佳，需要重新檢視訓練資料和模型架構",
)

BANDS = ("excellent", "good", "fair", "poor")
BAND_NAMES = {
    "excellent": "優秀 (90-100%)",
    "good": "良好 (70-90%)",
    "fair": "普通 (50-70%)",
    "poor": "需改進 (0-50%)",
}
BAND_DESCRIPTIONS = {
    "excellent": "AI識別表現優異，準確度很高",
    "good": "AI識別表現良好，有少量錯誤",
    "fair": "AI識別表現普通，需要改進",
    "poor": "AI識別表現不佳，需要重新訓練",
}


def _steps(value, steps, default: str, holds) -> Column:
    value = column(value)
    (limit, label), *rest = steps
    chain = F.when(holds(value, limit), label)
    for limit, label in rest:
        chain = chain.when(holds(value, limit), label)
    return chain.otherwise(default)


def _at_most(value, limit):
    return value <= limit


def _at_least(value, limit):
    return value >= limit


def _above(value, limit):
    return value > limit


def _below(value, limit):
    return value < limit


def ocr_level(cer) -> Column:
    return _steps(cer, OCR_LEVELS, OCR_LEVEL_ELSE, _at_most)


def cer_suggestion(cer) -> Column:
    return _steps(cer, CER_SUGGESTIONS, CER_SUGGESTION_ELSE, _at_most)


def similarity_suggestion(similarity) -> Column:
    return _steps(similarity, SIMILARITY_SUGGESTIONS, SIMILARITY_SUGGESTION_ELSE, _above)


def performance_level(accuracy) -> Column:
    return _steps(accuracy, PERFORMANCE_LEVELS, PERFORMANCE_LEVEL_ELSE, _at_least)


def performance_level_short(accuracy) -> Column:
    """Older three-level form."""
    return _steps(accuracy, PERFORMANCE_LEVELS[:2], PERFORMANCE_LEVEL_ELSE, _at_least)


def error_type(similarity) -> Column:
    return _steps(similarity, ERROR_TYPES, ERROR_TYPE_ELSE, _above)


def error_priority(similarity) -> Column:
    return _steps(similarity, PRIORITIES, PRIORITY_ELSE, _below)


def _status(exact, similarity, words) -> Column:
    done, bad, partly = words
    return F.when(column(exact), done).when(column(similarity) < 0.5, bad).otherwise(partly)


def status_text(exact, similarity) -> Column:
    return _status(exact, similarity, STATUS_TEXT)


def status_icon(exact, similarity) -> Column:
    return _status(exact, similarity, STATUS_ICON)


def remark_text(exact, similarity) -> Column:
    return _status(exact, similarity, REMARK_TEXT)


def cer_status_icon(cer) -> Column:
    """Documented variant on the error rate: none, up to a fifth, more."""
    done, bad, partly = STATUS_ICON
    return F.when(column(cer) == 0, done).when(column(cer) <= 0.2, partly).otherwise(bad)


def field_suggestion(average, match_rate) -> Column:
    average, match_rate = column(average), column(match_rate)
    keep, good, fair, poor = FIELD_SUGGESTIONS
    return (
        F.when((average >= 0.9) & (match_rate >= 0.8), keep)
        .when(average >= 0.7, good)
        .when(average >= 0.5, fair)
        .otherwise(poor)
    )


def _lookup(value, table: dict[str, str], default: Column) -> Column:
    value = column(value)
    result = default
    for key, label in table.items():
        result = F.when(value == key, label).otherwise(result)
    return result


def band_name(band) -> Column:
    return _lookup(band, BAND_NAMES, column(band))


def band_description(band) -> Column:
    return _lookup(band, BAND_DESCRIPTIONS, F.lit(""))


def accuracy_band(accuracy) -> Column:
    accuracy = column(accuracy)
    return (
        F.when(accuracy.between(0.9, 1.0), "excellent")
        .when((accuracy >= 0.7) & (accuracy < 0.9), "good")
        .when((accuracy >= 0.5) & (accuracy < 0.7), "fair")
        .when((accuracy >= 0.0) & (accuracy < 0.5), "poor")
    )


def fixed_text(value, places: int) -> Column:
    """A non-negative number with ``places`` (1 to 6) decimals.

    The exact binary value is rounded, half to even. The fraction is taken as a whole number of
    2**-62 parts so that no step rounds before the last one.
    """
    value = column(value)
    scale = 10**places
    parts = F.lit(2**62).cast("decimal(20,0)")
    whole = F.floor(value)
    fraction = ((value - whole) * float(2**62)).cast("bigint").cast("decimal(20,0)")
    scaled = fraction * F.lit(scale).cast("decimal(8,0)")
    rest = scaled % parts
    below = ((scaled - rest) / parts).cast("bigint")
    up = (rest * 2 > parts) | ((rest * 2 == parts) & (below % 2 == 1))
    total = whole * scale + below + F.when(up, 1).otherwise(0)
    decimals = F.lpad((total % scale).cast("string"), places, "0")
    return F.concat(F.floor(total / scale).cast("string"), F.lit("."), decimals)


def percent_text(value, places: int = 1) -> Column:
    return F.concat(fixed_text(column(value) * 100, places), F.lit("%"))


def yes_no(flag) -> Column:
    return F.when(column(flag), "是").otherwise("否")


def difference_text(exact, similarity) -> Column:
    return F.when(column(exact), "完全相同").otherwise(
        F.concat(F.lit("相似度: "), percent_text(similarity, 1))
    )


def match_text(matched, total) -> Column:
    return F.concat(
        F.lit("("), column(matched).cast("string"), F.lit("/"), column(total).cast("string"),
        F.lit(" 完全匹配)"),
    )
