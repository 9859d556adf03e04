"""One job from a folder of sheets to a written report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from proofgrid.config import ScoringConfig
from proofgrid.operators import diagnostics, reports
from proofgrid.plans.certificate import evaluate_workbooks
from proofgrid.plans.storage import stored, workspace
from proofgrid.sources import sinks, tables, workbooks

DEFAULT = ScoringConfig()

# Messages of a job that can give no report.
NO_FILES = "No file provided"
ALL_FAILED = "所有模型都處理失敗"


class Report(NamedTuple):
    """Where a job wrote its tables."""

    lines: str
    fields: str
    failures: str


def _admitted(spark: SparkSession, folder: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The admission of all files, and the accepted ones with their content."""
    listed = stored(tables.admit_files(tables.list_files(spark, folder), limit), "admission")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed, tables.admit_files(contents, limit).filter("accepted").select("path", "content")


def evaluate_folder(
    spark: SparkSession, folder: str, out: str, job: str, cfg: ScoringConfig = DEFAULT,
    value_set_id: str | None = None, limit: int = tables.CERTIFICATE_LIMIT,
) -> Report:
    """Admit the files of ``folder``, score their sheets, write report lines, fields and failures.

    A file that is not admitted or not readable, a sheet without a header and a block without columns
    become failure rows, and the others go on. The failures are written in any case; the job then stops
    if no file was admitted or no block gave a result. Its part of ``out`` is replaced as a whole, so the
    job can be repeated. Intermediate tables are gone when it ends.
    """
    report = Report(f"{out}/lines", f"{out}/fields", f"{out}/failures")
    with workspace(spark):
        listed, accepted = _admitted(spark, folder, limit)
        problems = diagnostics.rejected_files(listed.withColumnRenamed("path", "workbook"))
        if listed.filter("accepted").isEmpty():
            _write_failures(problems, report, job)
            raise ValueError(NO_FILES)
        parsed = stored(workbooks.parse_workbooks(accepted), "sheets")
        problems = problems.unionByName(diagnostics.unreadable_files(workbooks.failed_files(parsed)))
        result = evaluate_workbooks(stored(workbooks.good_rows(parsed), "rows"), cfg, value_set_id)
        _write_failures(problems.unionByName(result.diagnostics), report, job)
        diagnostics.raise_if_nothing(result.fields, ALL_FAILED)
        sinks.write_model_report(result.report, report.lines, job=job)
        sinks.write_model_report(result.fields, report.fields, job=job)
    return report


def _write_failures(problems: DataFrame, report: Report, job: str) -> None:
    sinks.write_model_report(reports.failure_rows(problems), report.failures, job=job)
