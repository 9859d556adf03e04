"""Comparison of dates, amounts, yes/no values and texts in documents."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from proofgrid.functions.textnorm import WHITESPACE, column, strip, text

# Names of the field types.
DATE = "日期"
AMOUNT = "金額"
BOOLEAN = "布林值"
TEXT = "文字"
JUDGMENT = "判斷"

# Accepted spellings of yes and no, and literals that mark a yes/no field.
YES_WORDS = ["Y", "YES", "TRUE", "1", "是"]
NO_WORDS = ["N", "NO", "FALSE", "0", "否"]
BOOLEAN_LITERALS = ["Y", "N", "y", "n", "Yes", "No", "True", "False"]

# Field names that decide the type.
SCOPE_WORD = "範圍"
SCOPE_VALUES = ("單筆", "全部")
BOOLEAN_FIELD = "小額終老非扣押範圍"

# Error texts by type.
ERROR_TEXT = {
    DATE: "日期格式或內容不符",
    AMOUNT: "金額數值錯誤",
    BOOLEAN: "Y/N判斷錯誤",
    TEXT: "文字內容不符",
}

# Every decimal digit Unicode knows and the ASCII digit it stands for.
_DIGITS = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
UNICODE_DIGITS = "".join(c for c in _DIGITS if not c.isascii())
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in _DIGITS if not c.isascii())

_DIGIT_GROUP = r"[0-9](?:_?[0-9])*"
# One readable number: sign, digits with single underscores, fraction, exponent; or a word for
# infinity; or the not-a-number word, whose sign is dropped.
_NUMBER = (
    rf"(?i)^(?:[+-](?=nan))?([+-]?(?:{_DIGIT_GROUP}(?:\.(?:{_DIGIT_GROUP})?)?|\.{_DIGIT_GROUP})"
    rf"(?:e[+-]?{_DIGIT_GROUP})?|[+-]?inf(?:inity)?|nan)\z"
)
_PLAIN_NUMBER = r"^[0-9.,]+\z"
_DATE_DIGITS = r"(?U)^\d{7,8}\n?\z"


def date_of(trimmed: Column) -> Column:
    """Date form of a stripped text."""
    digits = F.replace(F.replace(trimmed, F.lit("/")), F.lit("-"))
    seven = F.concat_ws(
        "/",
        F.concat(F.lit("0"), F.substring(digits, 1, 2)),
        F.substring(digits, 3, 2), F.substring(digits, 5, 2),
    )
    eight = F.concat_ws(
        "/", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 2)
    )
    return (
        F.when(~F.rlike(digits, F.lit(_DATE_DIGITS)), trimmed)
        .when(F.char_length(digits) == 7, seven)
        .otherwise(eight)
    )


def amount_of(value: Column) -> Column:
    """Number in a text; white space, commas and digits of other scripts are understood.

    Texts of digits, points and commas only are cast right away; all others take the long way.
    """
    ascii_text = F.translate(value, UNICODE_DIGITS + "," + WHITESPACE, ASCII_DIGITS)
    number = F.translate(F.regexp_extract(ascii_text, _NUMBER, 1), "_", "")
    return F.coalesce(
        F.when(
            F.rlike(value, F.lit(_PLAIN_NUMBER)),
            F.replace(value, F.lit(",")).try_cast("double"),
        ).otherwise(number.try_cast("double")),
        F.lit(0.0),
    )


def boolean_of(trimmed: Column) -> Column:
    upper = F.upper(trimmed)
    return F.when(upper.isin(YES_WORDS), "Y").when(upper.isin(NO_WORDS), "N").otherwise(upper)


def normalize_date(value) -> Column:
    """Seven or eight digits become ``yyy/mm/dd`` of their first seven places, else unchanged."""
    return date_of(strip(text(value)))


def normalize_amount(value) -> Column:
    """Number without thousands commas; blank or unreadable text is 0."""
    return amount_of(text(value))


def normalize_boolean(value) -> Column:
    return boolean_of(strip(text(value)))


def float_text(number: Column) -> Column:
    """A double written the way the scored text needs it: ``1200.0``, ``1e+16``, ``1.5e-05``."""
    plain = number.cast("string")
    size = F.abs(number)
    places = F.rtrim(number.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    positional = F.when(F.endswith(places, F.lit(".")), F.concat(places, F.lit("0"))).otherwise(
        places
    )
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    exponent = F.substring_index(plain, "E", -1)
    digits = F.translate(exponent, "-", "")
    scientific = F.concat(
        mantissa,
        F.when(F.startswith(exponent, F.lit("-")), "e-").otherwise("e+"),
        F.when(F.char_length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )
    # Between a thousandth and ten million the plain cast already has the right form.
    return (
        F.when((number == 0) | ((size >= 1e-3) & (size < 1e7)), plain)
        .when(F.isnan(number), "nan")
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )


def field_type(name, correct, predicted) -> Column:
    """Type of one pair: by field name first, then by the truth, then by the prediction."""
    correct, predicted = column(correct), column(predicted)
    return type_of(column(name), correct, strip(correct), strip(predicted))


def type_of(name: Column, correct: Column, left: Column, right: Column) -> Column:
    """As ``field_type``, with both values already stripped in ``left`` and ``right``."""
    scope = F.lit(False)
    for word in SCOPE_VALUES:
        scope = scope | F.contains(text(correct), F.lit(word))
    result = (
        F.when(F.contains(name, F.lit(DATE)) | F.rlike(name, F.lit("(?i)date")), DATE)
        .when(
            F.contains(name, F.lit(AMOUNT))
            | F.rlike(name, F.lit("(?i)amount"))
            | F.contains(name, F.lit("元")),
            AMOUNT,
        )
        .when(F.contains(name, F.lit(SCOPE_WORD)) & scope, TEXT)
        .when(name == BOOLEAN_FIELD, BOOLEAN)
    )
    for trimmed in (left, right):
        result = (
            result.when(trimmed.isin(BOOLEAN_LITERALS), BOOLEAN)
            .when(F.rlike(trimmed, F.lit(r"(?U)^\d{2,3}[/-]\d{1,2}[/-]\d{1,2}")), DATE)
            .when(
                F.rlike(
                    F.replace(trimmed, F.lit(",")), F.lit(r"(?U)^\d+(\.\d+)?\n?\z")
                ),
                AMOUNT,
            )
        )
    return result.otherwise(TEXT)


def value_text(trimmed: Column, kind: Column, amount: Column) -> Column:
    """Text form of a stripped value by type; ``amount`` is its number where the type asks for it."""
    return (
        F.when(trimmed.isNull(), "")
        .when(kind == DATE, date_of(trimmed))
        .when(kind == AMOUNT, float_text(amount))
        .when(kind == BOOLEAN, boolean_of(trimmed))
        .otherwise(trimmed)
    )


def normalize_value(value, kind) -> Column:
    """Text form of a value after clean-up by type; null is the empty string for every type."""
    trimmed = strip(column(value))
    return value_text(trimmed, column(kind), amount_of(trimmed))


def error_rate(correct, predicted) -> Column:
    """Edit distance over the length of the truth; may exceed 1. No white space is removed."""
    correct, predicted = column(correct), column(predicted)
    return (
        F.when(correct == predicted, 0.0)
        .when((correct == "") | (predicted == ""), 1.0)
        .otherwise(F.levenshtein(correct, predicted) / F.char_length(correct))
    )


def date_parts(value) -> Column:
    return F.split(normalize_date(value), "/")


def parts_similarity(left: Column, right: Column) -> Column:
    """1 when equal, else the share of equal parts when both have three parts, else 0."""
    equal_parts = sum(
        F.when(F.get(left, F.lit(i)) == F.get(right, F.lit(i)), 1.0).otherwise(0.0)
        for i in range(3)
    )
    return (
        F.when(left == right, 1.0)
        .when((F.size(left) == 3) & (F.size(right) == 3), equal_parts / 3.0)
        .otherwise(0.0)
    )


def date_similarity(correct, predicted) -> Column:
    return parts_similarity(date_parts(correct), date_parts(predicted))


def numbers_similarity(left: Column, right: Column) -> Column:
    """1 when the numbers are equal; a not-a-number value equals nothing."""
    return F.when((left == right) & ~F.isnan(left), 1.0).otherwise(0.0)


def amount_similarity(correct, predicted) -> Column:
    return numbers_similarity(normalize_amount(correct), normalize_amount(predicted))


def boolean_similarity(correct, predicted) -> Column:
    return F.when(normalize_boolean(correct) == normalize_boolean(predicted), 1.0).otherwise(0.0)


def text_similarity(correct, predicted, rate: Column | None = None) -> Column:
    correct, predicted = text(correct), text(predicted)
    rate = error_rate(correct, predicted) if rate is None else rate
    return F.when(strip(correct) == strip(predicted), 1.0).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - rate)
    )


def field_similarity(correct, predicted, kind) -> Column:
    """Similarity of two cleaned values by type. Dates are cleaned again here, as they must be."""
    kind = column(kind)
    return (
        F.when(kind == DATE, date_similarity(correct, predicted))
        .when(kind == AMOUNT, amount_similarity(correct, predicted))
        .when(kind == BOOLEAN, boolean_similarity(correct, predicted))
        .otherwise(text_similarity(correct, predicted))
    )


def error_description(kind, similarity, exact_threshold: float = 0.99) -> Column:
    kind = column(kind)
    return (
        F.when(column(similarity) >= exact_threshold, "")
        .when(kind == DATE, ERROR_TEXT[DATE])
        .when(kind == AMOUNT, ERROR_TEXT[AMOUNT])
        .when(kind == BOOLEAN, ERROR_TEXT[BOOLEAN])
        .otherwise(ERROR_TEXT[TEXT])
    )


def percent_accuracy(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - rate * 100)


def percent_exact(is_exact: Column) -> Column:
    return F.when(is_exact, 100.0).otherwise(0.0)


def accuracy_band(percent: Column) -> Column:
    """Colour class of a percentage; 50 up to 70 has none."""
    return F.when(percent >= 90, "green").when(percent >= 70, "amber").when(percent < 50, "red")
