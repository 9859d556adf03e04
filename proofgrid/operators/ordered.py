"""Running values over the rows of one sheet that hold at any sheet length.

A plain window over a sheet puts all its rows into one task. Here the rows are cut into chunks of
consecutive positions. Every chunk is summed up, the few summaries are scanned per sheet, and each
chunk then continues from what it inherits. One sheet thus spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _with_inherited(
    df: DataFrame, keys: list[str], order: str, chunk_rows: int, inherited: Column, summary: Column
) -> DataFrame:
    """Rows with ``_chunk`` plus one seed row per chunk that carries ``_seed`` and sorts first."""
    chunk = F.floor(F.col(order) / chunk_rows).alias("_chunk")
    rows = df.select("*", chunk)
    summaries = rows.groupBy(*keys, "_chunk").agg(summary.alias("_summary"))
    seeds = summaries.select(
        *keys, "_chunk", inherited.alias("_seed"), F.lit(True).alias("_is_seed")
    )
    return rows.withColumn("_is_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)


def _chunk_windows(keys: list[str], order: str) -> tuple:
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    within = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(F.col("_is_seed").desc(), F.col(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return before, within


def carry_forward(
    df: DataFrame, keys: list[str], order: str, marker: Column, name: str, chunk_rows: int
) -> DataFrame:
    """Add ``name``: the last non-null ``marker`` at or before each row."""
    before, within = _chunk_windows(keys, order)
    marked = df.withColumn(name, marker)
    seeded = _with_inherited(
        marked, keys, order, chunk_rows,
        inherited=F.last("_summary", ignorenulls=True).over(before),
        summary=F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))),
    )
    carried = F.last(F.coalesce(F.col(name), F.col("_seed")), ignorenulls=True).over(within)
    return (
        seeded.withColumn(name, carried)
        .filter(~F.col("_is_seed"))
        .drop("_seed", "_is_seed", "_chunk")
    )


def number_rows(
    df: DataFrame, keys: list[str], order: str, name: str, chunk_rows: int
) -> DataFrame:
    """Add ``name``: 0, 1, 2, … in ``order`` within ``keys``."""
    before, within = _chunk_windows(keys, order)
    seeded = _with_inherited(
        df, keys, order, chunk_rows,
        inherited=F.coalesce(F.sum("_summary").over(before), F.lit(0)),
        summary=F.count(F.lit(1)),
    )
    step = F.coalesce(F.col("_seed"), F.lit(1))
    return (
        seeded.withColumn(name, F.sum(step).over(within) - 1)
        .filter(~F.col("_is_seed"))
        .drop("_seed", "_is_seed", "_chunk")
    )
