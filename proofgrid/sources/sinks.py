"""Writing reports, one partition per model.

With ``job`` a report goes to its own part of ``path`` (``job=...``). It is written next to it first and
then replaces the whole part, so a killed or repeated job leaves its rows there exactly once and other
jobs' parts as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from proofgrid.functions.hygiene import document_sheet_name, sheet_name
from proofgrid.operators.diagnostics import raise_if_nothing
from proofgrid.plans.storage import delete, names_in, put_in_place

# Fixed value: guard messages.
NO_RECORDS = "記錄評估結果為空"
NO_FIELDS = "欄位評估結果為空"


def _write(df: DataFrame, path: str, sheet, mode: str, job: str | None = None) -> None:
    # Rebalancing joins small pieces and splits the pieces of a model with most of the rows.
    named = df.withColumn("sheet", sheet).hint("rebalance", "sheet")
    if job is None:
        named.write.mode(mode).partitionBy("sheet").parquet(path)
        return
    if not job or any(c in job for c in "/=%"):
        raise ValueError(f"not a name for a job: {job!r}")
    # Readers of the folder pass over names that start with an underscore.
    prefix = f"_new-{job}-"
    for left in names_in(df.sparkSession, path):
        if left.startswith(prefix):
            delete(df.sparkSession, f"{path}/{left}")  # of a killed run
    staged = f"{path}/{prefix}{uuid.uuid4().hex}"
    named.write.partitionBy("sheet").parquet(staged)
    put_in_place(df.sparkSession, staged, f"{path}/job={job}")


def write_model_report(
    lines: DataFrame, path: str, mode: str = "overwrite", job: str | None = None
) -> None:
    """Report lines in one partition per model, under the model's sheet name."""
    _write(lines, path, sheet_name("model"), mode, job)


def write_single_report(
    lines: DataFrame, records: DataFrame, fields: DataFrame, path: str, mode: str = "overwrite",
    job: str | None = None,
) -> None:
    """As above; stops when there are no records or no fields."""
    raise_if_nothing(records, NO_RECORDS)
    raise_if_nothing(fields, NO_FIELDS)
    write_model_report(lines, path, mode, job)


def write_document_report(
    lines: DataFrame, path: str, mode: str = "overwrite", job: str | None = None
) -> None:
    _write(lines, path, document_sheet_name("model"), mode, job)


def write_mismatches(
    table: DataFrame, path: str, mode: str = "overwrite", job: str | None = None
) -> None:
    """Mismatches in one partition per field."""
    _write(table, path, sheet_name(F.concat("field", F.lit("_錯誤詳情"))), mode, job)
