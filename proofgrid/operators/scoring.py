"""From pairs to scores: one narrow projection per family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofgrid.config import ScoringConfig
from proofgrid.functions import metrics, typed
from proofgrid.functions.textnorm import normalize_text, normalize_words, strip

DEFAULT = ScoringConfig()


def _flags(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    exact = F.col("similarity") >= cfg.exact_threshold
    return df.withColumns(
        {
            "is_exact_match": exact,
            "is_mismatch": ~exact & (F.col("similarity") < cfg.mismatch_threshold),
        }
    )


def score_pairs(pairs: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Add ``cer``, ``wer``, ``similarity``, ``is_exact_match`` and ``is_mismatch``.

    The cleaned texts are columns of an inner projection, so each is made once per pair, and the
    character distance is computed once and shared by all columns that need it.
    """
    if cfg.method in ("gestalt", "gestalt_trim"):
        null = F.lit(None).cast("double")
        return _flags(
            pairs.withColumns(
                {
                    "cer": null,
                    "wer": null,
                    "similarity": metrics.similarity("correct", "predicted", cfg),
                }
            ),
            cfg,
        )
    if cfg.method == "opcode":
        rated = pairs.withColumn("cer", metrics.opcode_cer("correct", "predicted"))
        return _flags(
            rated.withColumn("wer", F.col("cer")).withColumn(
                "similarity", metrics.accuracy(F.col("cer"))
            ),
            cfg,
        )
    left, right = F.col("_left"), F.col("_right")
    words_l, words_r = F.col("_words_l"), F.col("_words_r")
    rated = (
        pairs.withColumns(
            {
                "_left": normalize_text("correct"),
                "_right": normalize_text("predicted"),
                "_words_l": normalize_words("correct"),
                "_words_r": normalize_words("predicted"),
            }
        )
        .withColumns(
            {
                "_slow": metrics.long_pair(left, right, cfg),
                "_words": metrics.has_words(words_l, words_r),
            }
        )
        .withColumns(
            {
                "cer": metrics.cer_clean(left, right, cfg, F.col("_slow")),
                "_word_rate": F.when(
                    F.col("_words"),
                    metrics.word_rate_clean(
                        words_l, words_r, cfg, F.col("_slow") & F.col("_words")
                    ),
                ),
            }
        )
        # Without a space in either text, words are characters and both rates are the same.
        .withColumns(
            {
                "wer": F.when(F.col("_words"), F.col("_word_rate")).otherwise(F.col("cer")),
                "similarity": metrics.accuracy(F.col("cer")),
            }
        )
        .drop("_left", "_right", "_words_l", "_words_r", "_slow", "_words", "_word_rate")
    )
    return _flags(rated, cfg)


def score_document_pairs(pairs: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Typed comparison: adds type, cleaned values, similarity, rates, exactness and error text.

    Stripped texts, numbers and date parts are columns of inner projections, so generated code
    stays small and no value is parsed twice.
    """
    kind, left, right = F.col("field_type"), F.col("norm_correct"), F.col("norm_predicted")
    is_amount, is_date = kind == typed.AMOUNT, kind == typed.DATE
    no_amount = F.lit(0.0)
    typed_similarity = (
        F.when(is_date, typed.parts_similarity(F.col("_parts_l"), F.col("_parts_r")))
        .when(is_amount, typed.numbers_similarity(F.col("_amount_l"), F.col("_amount_r")))
        .when(left == right, 1.0)
        .when(kind == typed.BOOLEAN, 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("cer")))
    )
    return (
        pairs.withColumns({"_l": strip("correct"), "_r": strip("predicted")})
        .withColumn(
            "field_type",
            typed.type_of(F.col("field"), F.col("correct"), F.col("_l"), F.col("_r")),
        )
        .withColumns(
            {
                "_amount_l": F.when(
                    is_amount, F.coalesce(typed.amount_of(F.col("_l")), no_amount)
                ),
                "_amount_r": F.when(
                    is_amount, F.coalesce(typed.amount_of(F.col("_r")), no_amount)
                ),
            }
        )
        .withColumns(
            {
                "norm_correct": typed.value_text(F.col("_l"), kind, F.col("_amount_l")),
                "norm_predicted": typed.value_text(F.col("_r"), kind, F.col("_amount_r")),
            }
        )
        .withColumns(
            {
                "cer": typed.error_rate(left, right),
                "_parts_l": F.when(is_date, typed.date_parts(left)),
                "_parts_r": F.when(is_date, typed.date_parts(right)),
            }
        )
        .withColumns({"wer": F.col("cer"), "similarity": typed_similarity})
        .drop("_l", "_r", "_amount_l", "_amount_r", "_parts_l", "_parts_r")
        .withColumn("is_exact_match", F.col("similarity") >= cfg.exact_threshold)
        .withColumn(
            "error_description",
            typed.error_description("field_type", "similarity", cfg.exact_threshold),
        )
    )


# --- filters on pairs and scores -----------------------------------------------------------------


def record_pairs(pairs: DataFrame) -> DataFrame:
    """Record rule: no truth, no score; a missing prediction counts as empty text."""
    return pairs.filter(F.col("correct").isNotNull()).withColumn(
        "predicted", F.coalesce("predicted", F.lit(""))
    )


def either_side(pairs: DataFrame) -> DataFrame:
    """Document rule: keep a case when one of the two values is there."""
    return pairs.filter(F.col("correct").isNotNull() | F.col("predicted").isNotNull())


def errors_only(scores: DataFrame) -> DataFrame:
    return scores.filter(~F.col("is_exact_match"))


def mismatches(scores: DataFrame) -> DataFrame:
    return scores.filter("is_mismatch")


def out_of_bounds(scores: DataFrame, columns=("cer", "wer", "similarity")) -> DataFrame:
    """Scores outside [0, 1], one row per offending column."""
    checks = F.array_compact(
        F.array(*[F.when(~F.col(c).between(0.0, 1.0), F.lit(c)) for c in columns])
    )
    return scores.withColumn("out_of_bounds", F.explode(checks))


def weight_of(field: Column | str, cfg: ScoringConfig = DEFAULT) -> Column:
    """Weight of the first configured name that the field name contains."""
    field = F.col(field) if isinstance(field, str) else field
    result = F.lit(cfg.fallback_weight)
    for name, weight in reversed(cfg.weights.items()):
        result = F.when(F.contains(field, F.lit(name)), F.lit(weight)).otherwise(result)
    return result
