"""Scoring of files that keep arriving.

Totals are kept by row: a row that arrives again (a replayed or corrected file) replaces what it counted
before, and a late row corrects the totals. The state store holds each row's last scores, packed per slice
of a field's rows; a changed slice sends its new sums, which replace the old ones in one current table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proofgrid.config import ScoringConfig
from proofgrid.operators.scoring import score_pairs
from proofgrid.plans.storage import delete, names_in

DEFAULT = ScoringConfig()
PAIRS_SCHEMA = (
    "workbook string, model string, row_idx bigint, record_id string, subject_id string, "
    "field string, field_order int, correct string, predicted string"
)
KEYS = ["workbook", "model", "field"]
SUMS = ["sum_similarity", "exact_matches", "total_records", "mismatched"]
SLICE_ROWS = 10_000  # rows of a field whose scores are one entry of the state store
SLICE_SCHEMA = (
    "workbook string, model string, field string, slice bigint, sum_similarity double, "
    "exact_matches bigint, total_records bigint, mismatched bigint"
)
_ROW = np.dtype([("row", "<i8"), ("version", "<i8"), ("similarity", "<f8"), ("exact", "?"), ("mismatch", "?")])


def pair_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Pairs of arriving files with ``version``, the time at which their file was written."""
    reader = spark.readStream.schema(PAIRS_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).select(
        "*", F.unix_micros("_metadata.file_modification_time").alias("version")
    )


def start_scoring(
    pairs: DataFrame, out: str, checkpoint: str, cfg: ScoringConfig = DEFAULT
) -> StreamingQuery:
    """Append the scores of new pairs; stops when all present files are done."""
    return (
        score_pairs(pairs, cfg).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def winning_rows(rows: np.ndarray) -> np.ndarray:
    """One entry per row: the newest version, of equal versions the last one."""
    rows = rows[np.lexsort((rows["version"], rows["row"]))]
    return rows[np.append(rows["row"][1:] != rows["row"][:-1], True)] if len(rows) else rows


def _update_slice(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Take in a slice's new rows, keep the winners, return the slice's sums."""
    parts = [np.frombuffer(state.get[0], _ROW)] if state.exists else []
    for batch in batches:
        part = np.empty(len(batch), _ROW)
        for name in _ROW.names:
            part[name] = batch[name].to_numpy()
        parts.append(part)
    rows = winning_rows(np.concatenate(parts))
    state.update((rows.tobytes(),))
    yield pd.DataFrame([(
        *key, float(rows["similarity"].sum()), int(rows["exact"].sum()), len(rows), int(rows["mismatch"].sum())
    )], columns=[*KEYS, "slice", *SUMS])


def slice_sums(pairs: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """The current sums of every slice that a batch changes."""
    rows = score_pairs(pairs, cfg).select(
        *KEYS, F.floor(F.col("row_idx") / SLICE_ROWS).alias("slice"), F.col("row_idx").alias("row"),
        "version", "similarity", F.col("is_exact_match").alias("exact"),
        F.col("is_mismatch").alias("mismatch"),
    )
    return rows.groupBy(*KEYS, "slice").applyInPandasWithState(
        _update_slice, SLICE_SCHEMA, "rows binary", "update", GroupStateTimeout.NoTimeout
    )


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Batches whose table is complete, ascending."""
    found = [n for n in names_in(spark, out) if n.startswith("version=")]
    return sorted(int(n.split("=")[1]) for n in found if "_SUCCESS" in names_in(spark, f"{out}/{n}"))


def _slices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SLICE_SCHEMA).parquet(path)


def start_field_totals(
    pairs: DataFrame, out: str, checkpoint: str, cfg: ScoringConfig = DEFAULT
) -> StreamingQuery:
    """Keep the current slice sums of all rows so far in ``out``.

    Each batch writes the table anew from its predecessor, which stays until the next batch is written.
    A repeated batch starts from that predecessor again and writes the same table.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, out)
        before = [v for v in versions if v < batch_id]
        current = _replaced(_slices(spark, f"{out}/version={before[-1]}"), batch) if before else batch
        current.write.mode("overwrite").parquet(f"{out}/version={batch_id}")
        for version in before[:-1]:
            delete(spark, f"{out}/version={version}")

    return (
        slice_sums(pairs, cfg).writeStream.foreachBatch(write_batch).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _replaced(kept: DataFrame, changed: DataFrame) -> DataFrame:
    """``kept`` with the slices of ``changed`` in place of their old sums."""
    both = kept.withColumn("_new", F.lit(False)).unionByName(changed.withColumn("_new", F.lit(True)))
    latest = both.groupBy(*KEYS, "slice").agg(*[F.max_by(name, "_new").alias(name) for name in SUMS])
    return latest.select(*KEYS, "slice", *SUMS)


def field_totals(spark: SparkSession, out: str) -> DataFrame:
    """Field accuracies over all rows so far, each counted once."""
    versions = _versions(spark, out)
    if not versions:
        raise ValueError(f"no totals in {out}")
    return (
        _slices(spark, f"{out}/version={versions[-1]}").groupBy(*KEYS)
        .agg(
            (F.sum("sum_similarity") / F.sum("total_records")).alias("accuracy"),
            F.sum("exact_matches").alias("exact_matches"),
            F.sum("total_records").alias("total_records"),
            F.sum("mismatched").alias("mismatched"),
        )
    )
