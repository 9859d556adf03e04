"""Record scores of headed tables without any shuffle.

All fields of a record stand in one row, so its mean and its matches are plain expressions over
that row. The long form is only needed where fields of different tables have to be lined up.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from proofgrid.config import DEFAULT_MAPPING, ScoringConfig
from proofgrid.functions import metrics

DEFAULT = ScoringConfig()


def score_records(
    df: DataFrame, mapping: dict[str, tuple[str, str]] = DEFAULT_MAPPING,
    cfg: ScoringConfig = DEFAULT,
) -> DataFrame:
    """Add ``overall_accuracy``, ``matched_fields`` and ``total_fields``; unscored rows drop out."""
    scores = {
        f"_s{i}": F.when(
            F.col(f"`{truth}`").isNotNull(),
            metrics.similarity(f"`{truth}`", f"`{predicted}`", cfg),
        )
        for i, (truth, predicted) in enumerate(mapping.values())
    }
    names = list(scores)
    total = reduce(add, [F.col(n).isNotNull().cast("bigint") for n in names])
    matched = reduce(
        add, [F.coalesce(F.col(n) >= cfg.exact_threshold, F.lit(False)).cast("bigint") for n in names]
    )
    summed = reduce(add, [F.coalesce(n, F.lit(0.0)) for n in names])
    return (
        df.withColumns(scores)
        .withColumns({"matched_fields": matched, "total_fields": total, "_sum": summed})
        .filter(F.col("total_fields") > 0)
        .withColumn("overall_accuracy", F.col("_sum") / F.col("total_fields"))
        .drop("_sum", *names)
    )
