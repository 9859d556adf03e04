"""Helpers that several operators of this package share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def number_within(
    df: DataFrame, group: str, order: list[str], name: str, n_rows: int, rows_per_slice: int = 50_000
) -> DataFrame:
    """Number the rows of each group from 0 without gaps; ``df`` should be a stored table.

    A group is cut into hash slices that are counted first, so no task sees more of a hot group than a slice.
    """
    slices = max(1, math.ceil(n_rows / rows_per_slice))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
        .select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rank", F.row_number().over(within))
        .join(starts, [group, "_slice"])
        .withColumn(name, F.col("_start") + F.col("_rank") - 1)
        .drop("_slice", "_start", "_rank")
    )
