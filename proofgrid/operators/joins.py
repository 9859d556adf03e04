"""Joins of sheet rows with what is known per workbook, and of tables by key or position.

Facts go to all tasks only when their bytes were counted and stay below a bound, or when Spark's own
threshold says so. Above it, the rows of one workbook are cut into slices and the small side is
repeated per slice, so a workbook with a third of all rows still spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from proofgrid.plans.storage import stored

BUILD_BYTES = 32 << 20  # of facts that may go to all tasks


def sliced_join(
    rows: DataFrame, small: DataFrame, keys: list[str], spread_by: str, slices: int,
    how: str = "inner",
) -> DataFrame:
    """Equi-join of many rows with few facts per key; ``spread_by`` picks a row's slice.

    With one slice this is a plain join, which Spark turns into a broadcast when the small side's
    files are below its threshold.
    """
    if slices == 1:
        return rows.join(small, keys, how)
    left = rows.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(slices)))
    right = small.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))
    )
    return left.join(right, [*keys, "_slice"], how).drop("_slice")


def measured_bytes(facts: DataFrame) -> int:
    """Size of a stored table as text, which is more than its rows take in memory."""
    row = F.to_json(F.struct(*facts.columns))
    return facts.agg(F.sum(F.octet_length(row))).first()[0] or 0


def with_facts(
    rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: str, slices: int,
    how: str = "inner", build_bytes: int = BUILD_BYTES,
) -> DataFrame:
    """``sliced_join`` with stored ``facts`` whose size is read back first.

    Up to ``build_bytes`` the facts are the build side in every task and the rows stay where they are.
    """
    if measured_bytes(facts) <= build_bytes:
        return rows.join(F.broadcast(facts), keys, how)
    return sliced_join(rows, facts, keys, spread_by, slices, how)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; ``align_tables`` needs each key once per table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def align_tables(
    truth: DataFrame, predictions: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Pairs of a truth table and a prediction table, and the keys that lack a partner.

    Truth rows without a prediction stay with a null prediction. Both tables hold ``keys`` and
    ``value``. The second result has ``keys`` and ``missing_in``: ``prediction`` or ``truth``. Rows
    with a null key have no partner; they go around the join, so many of them do no harm.
    """
    left = truth.select(*keys, F.col("value").alias("correct"))
    right = predictions.select(*keys, F.col("value").alias("predicted"))
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    both = stored(
        left.filter(complete).withColumn("_t", F.lit(True)).join(
            right.filter(complete).withColumn("_p", F.lit(True)), keys, "full_outer"
        ),
        "aligned",
    )
    lone_truths, lone_predictions = left.filter(~complete), right.filter(~complete)
    pairs = (
        both.filter(F.col("_t").isNotNull()).select(*keys, "correct", "predicted")
        .unionByName(lone_truths, allowMissingColumns=True)
    )
    side = F.when(F.col("_p").isNull(), "prediction").otherwise("truth")
    unmatched = (
        both.filter(F.col("_p").isNull() | F.col("_t").isNull())
        .select(*keys, side.alias("missing_in"))
        .unionByName(lone_truths.select(*keys, F.lit("prediction").alias("missing_in")))
        .unionByName(lone_predictions.select(*keys, F.lit("truth").alias("missing_in")))
    )
    return pairs, unmatched


# Fixed value: message of two lists of unequal length.
UNEQUAL = "正確值和預測值的數量不一致: "


def numbered(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, … in ``order`` within ``keys``, without gaps.

    Rows are sorted into ranges over all keys, so a key with most of the rows lies in many of them. Ranges
    are counted, and a row's number is its place in its range plus the rows of the key in earlier ranges.
    Rows with the same key and order are numbered in any order.
    """
    ranged = stored(
        df.repartitionByRange(*[F.col(k) for k in keys], F.col(order))
        .sortWithinPartitions(*keys, order)
        .select(
            "*", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_id"),
        ),
        "ranges",
    )
    counts = ranged.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        counts.select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_range"),
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        "range-starts",
    )
    same = F.col("_part") == F.col("_range")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return ranged.join(starts, same).select(
        *df.columns, (F.col("_id") + F.col("_shift")).alias(name)
    )


def zip_tables(
    truth: DataFrame, predictions: DataFrame, keys: list[str], order: str
) -> tuple[DataFrame, DataFrame]:
    """Two lists per key, zipped by position, and the keys whose lists differ in length.

    Both tables hold ``keys``, ``order`` and ``value``; the n-th truth of a key meets its n-th prediction,
    whatever their order values are. Null values and null keys count like others. What a longer list has
    beyond the shorter one is in no pair; the second result names both lengths.
    """
    left = stored(
        numbered(truth.select(*keys, order, F.col("value").alias("correct")), keys, order, "position")
        .drop(order), "truths",
    )
    right = stored(
        numbered(predictions.select(*keys, order, F.col("value").alias("predicted")), keys, order, "position")
        .drop(order), "predictions",
    )
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in [*keys, "position"]})
    same = F.col("position") == F.col("_position")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    pairs = left.join(renamed, same).select(*keys, "position", "correct", "predicted")
    one, none = F.lit(1), F.lit(0)
    lengths = (
        left.select(*keys, one.alias("_t"), none.alias("_p"))
        .unionByName(right.select(*keys, none.alias("_t"), one.alias("_p")))
        .groupBy(*keys).agg(F.sum("_t").alias("n_truths"), F.sum("_p").alias("n_predictions"))
    )
    differing = lengths.filter(F.col("n_truths") != F.col("n_predictions")).withColumn(
        "message",
        F.concat(
            F.lit(UNEQUAL), F.col("n_truths").cast("string"), F.lit(" vs "),
            F.col("n_predictions").cast("string"),
        ),
    )
    return pairs, differing
