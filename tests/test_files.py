"""Files in, reports out, streams and two-table input."""

import io
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofgrid.catalog.texts import workbook_bytes
from proofgrid.operators import joins, reports
from proofgrid.operators.pairing import wide_to_pairs
from proofgrid.operators.scoring import score_pairs
from proofgrid.plans.certificate import evaluate_pairs, evaluate_workbooks
from proofgrid.plans import folder, storage
from proofgrid.plans.storage import stored
from proofgrid.sources import samples, sinks, tables, workbooks
from proofgrid.sources.samples import GRID_HEADER, GRID_ROWS
from proofgrid.streaming import incremental

ROOT = Path(__file__).resolve().parents[1]


def styled_workbook():
    """Shared texts with phonetic runs, a date style, a boolean and skipped cells."""
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(io.BytesIO(workbook_bytes([["x"]]))) as base, zipfile.ZipFile(
        out, "w"
    ) as archive:
        for name in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            archive.writestr(name, base.read(name))
        archive.writestr(
            "xl/sharedStrings.xml",
            f"<sst {ns}><si><t>plain</t></si><si><r><t>輕</t></r><r><t>度</t></r>"
            "<rPh><t>no</t></rPh></si><si><t>N/A</t></si></sst>",
        )
        archive.writestr(
            "xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
            "</cellXfs></styleSheet>",
        )
        archive.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c>'
            '<c r="C2" t="s"><v>1</v></c><c r="D2" t="s"><v>2</v></c></row>'
            '<row r="4"><c r="A4" s="1"><v>45406</v></c><c r="B4" t="b"><v>1</v></c>'
            '<c r="C4"><v>1.50</v></c><c r="AB4"><v>7</v></c></row></sheetData></worksheet>',
        )
    return out.getvalue()


def test_cell_kinds():
    rows = list(workbooks.sheet_rows(styled_workbook()))
    assert [(r[0], r[1]) for r in rows] == [("s1", 1), ("s1", 3)]
    assert rows[0][2] == ["plain", None, "輕度", None]
    last = rows[1][2]
    assert last[:3] == ["2024-04-24 00:00:00", "True", "1.5"] and last[27] == "7"


def test_folder_of_workbooks(spark, tmp_path):
    (tmp_path / "good.xlsx").write_bytes(workbook_bytes([GRID_HEADER, *GRID_ROWS]))
    (tmp_path / "broken.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "~lock.xlsx").write_bytes(b"x")
    parsed = stored(workbooks.read_workbooks(spark, str(tmp_path)), "sheets")
    failed = workbooks.failed_files(parsed).collect()
    assert len(failed) == 1 and failed[0].workbook.endswith("broken.xlsx")
    result = evaluate_workbooks(workbooks.good_rows(parsed))
    assert result.overall.first().overall_accuracy == pytest.approx(0.947478991596639)


def test_one_job_from_folder_to_report(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "good.xlsx").write_bytes(workbook_bytes([GRID_HEADER, *GRID_ROWS]))
    (source / "bare.xlsx").write_bytes(workbook_bytes([["a", "b"], ["c", "d"]]))
    (source / "broken.xlsx").write_bytes(b"not a workbook")
    (source / "notes.txt").write_bytes(b"text")
    (source / "big.xlsx").write_bytes(b"1" * 50_000)
    before = set(os.listdir(storage._own_folder(spark)))
    for _ in range(2):  # a repeated job replaces its part
        report = folder.evaluate_folder(spark, str(source), out, "night", limit=40_000)
    assert spark.read.parquet(report.lines).count() == 5 * 4
    assert spark.read.parquet(report.fields).count() == 3
    failed = {os.path.basename(r.workbook): r.reason for r in spark.read.parquet(report.failures).collect()}
    assert set(failed) == {"bare.xlsx", "broken.xlsx", "notes.txt", "big.xlsx"}
    assert failed["big.xlsx"] == "file too large" and failed["notes.txt"] == "invalid file format"
    assert set(os.listdir(storage._own_folder(spark))) == before
    for name in ("good.xlsx",):
        (source / name).unlink()
    with pytest.raises(ValueError, match=folder.ALL_FAILED):
        folder.evaluate_folder(spark, str(source), out, "next", limit=40_000)
    with pytest.raises(ValueError, match=folder.NO_FILES):
        folder.evaluate_folder(spark, str(source), out, "last", limit=1)
    jobs = {str(r.job): r.n for r in spark.read.parquet(report.failures).groupBy("job").agg(F.count("*").alias("n")).collect()}
    assert jobs == {"night": 4, "next": 4, "last": 4}
    assert {str(r.job) for r in spark.read.parquet(report.lines).select("job").distinct().collect()} == {"night"}


def test_admission(spark, tmp_path):
    (tmp_path / "a.XLSX").write_bytes(b"12345")
    (tmp_path / "c.csv").write_bytes(b"1")
    (tmp_path / "d.xlsx").write_bytes(b"1" * 20)
    # Spark's file sources leave empty files out; a listing from elsewhere may have them.
    empty = spark.createDataFrame([("/x/b.xls", 0)], "path string, length bigint")
    listed = tables.list_files(spark, str(tmp_path)).unionByName(empty)
    files = tables.admit_files(listed, limit=10)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in files.collect()}
    assert got == {"a.XLSX": None, "b.xls": "empty file", "c.csv": "invalid file format",
                   "d.xlsx": "file too large"}


def test_csv_rows_keep_their_place_over_splits(spark, tmp_path):
    lines = [f"{i},v{i}" for i in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.read_csv_grid(spark, str(tmp_path), 2)
        assert rows.filter("row_idx <> cast(values[0] as int)").count() == 0
        assert rows.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ragged_csv_loses_nothing(spark, tmp_path):
    """Rows of unequal width, quoted commas, doubled quotes and line breaks, also across the borders of splits."""
    import csv
    import random

    rng = random.Random(7)
    pool = ["", "a", "b c", 'q"q', "x,y", "one\ntwo", '"', "\n\n", ' "s" ', "é"]
    records = [[f"r{i}", *(rng.choice(pool) for _ in range(rng.randint(0, 6)))] for i in range(1500)]
    records[700].append("long\n" * 3000)  # longer than several splits
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator="\n").writerows(records)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = tables.read_csv_grid(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.row_idx: r["values"] for r in rows}
    assert got == {i: [v or None for v in record] for i, record in enumerate(records)}


def test_csv_corner_cases(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b',a,\r\n\r\n"x"\n"",""\n"never closed,1\nto the end')
    rows = tables.read_csv_grid(spark, str(tmp_path), 3).orderBy("row_idx").collect()
    assert [r["values"] for r in rows] == [
        [None, "a", None], ["x", None, None], [None, None, None], ['"never closed,1\nto the end', None, None]
    ]


def test_reports_are_partitioned_by_model(spark, tmp_path):
    pairs = wide_to_pairs(samples.five_row_sample(spark)).withColumn(
        "model", F.when(F.col("row_idx") < 2, "a/b").otherwise("c")
    )
    result = evaluate_pairs(pairs, value_set_id="v1")
    out = str(tmp_path / "report")
    sinks.write_single_report(result.report, result.records, result.fields, out)
    back = spark.read.parquet(out)
    assert {r.sheet for r in back.select("sheet").distinct().collect()} == {"a_b", "c"}
    assert back.count() == 5 * 4 and back.filter("value_set_id = 'v1'").count() == 20
    with pytest.raises(ValueError):
        sinks.write_single_report(
            result.report, result.records.filter("false"), result.fields, out
        )
    sinks.write_mismatches(reports.mismatch_table(result.scores), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first().sheet == "障礙類別_錯誤詳情"


def test_report_tables_keep_long_texts(spark):
    scores = evaluate_pairs(wide_to_pairs(samples.five_row_sample(spark))).scores
    long = scores.withColumns({"correct": F.repeat(F.lit("a"), 40000), "predicted": F.repeat(F.lit("b"), 50000)})
    sizes = {(len(r.correct), len(r.predicted)) for r in reports.detailed_lines(long).filter("kind = 'field'").collect()}
    assert sizes == {(40000, 50000)}
    df = spark.createDataFrame([("x\x00" * 40000,)], "t string")
    assert reports.original_data(df).first().t == "x" * 40000
    assert len(reports.original_data(df, sheet_limits=True).first().t) == 32763


def test_stream_equals_batch(spark, tmp_path):
    pairs = wide_to_pairs(samples.five_row_sample(spark))
    source, out, totals = (str(tmp_path / n) for n in ("in", "scores", "totals"))
    pairs.repartition(3).write.parquet(source)
    stream = incremental.pair_stream(spark, source, files_per_batch=1)
    incremental.start_scoring(stream, out, str(tmp_path / "c1")).awaitTermination()
    incremental.start_field_totals(stream, totals, str(tmp_path / "c2")).awaitTermination()
    batch = {(r.row_idx, r.field): r.similarity for r in score_pairs(pairs).collect()}
    got = {(r.row_idx, r.field): r.similarity for r in spark.read.parquet(out).collect()}
    assert got == batch
    # Rows that arrive again replace themselves; a restart without news changes nothing.
    pairs.write.mode("append").parquet(source)
    incremental.start_field_totals(stream, totals, str(tmp_path / "c2")).awaitTermination()
    incremental.start_field_totals(stream, totals, str(tmp_path / "c2")).awaitTermination()
    summed = {r.field: r for r in incremental.field_totals(spark, totals).collect()}
    assert summed["障礙類別"].total_records == 5
    assert summed["障礙類別"].accuracy == pytest.approx(0.75)


def test_late_and_corrected_rows_change_the_totals(spark, tmp_path):
    source, totals, state = (str(tmp_path / n) for n in ("in", "totals", "state"))

    def arrive(*rows):
        df = spark.createDataFrame(
            [("w", "m", i, str(i), "s", "f", 0, a, b) for i, a, b in rows], incremental.PAIRS_SCHEMA
        )
        df.coalesce(1).write.mode("append").parquet(source)
        stream = incremental.pair_stream(spark, source)
        incremental.start_field_totals(stream, totals, state).awaitTermination()
        r = incremental.field_totals(spark, totals).first()
        return r.accuracy, r.exact_matches, r.total_records, r.mismatched

    far = incremental.SLICE_ROWS + 1  # a row of another slice
    assert arrive((0, "ab", "ab"), (far, "ab", "xy")) == (0.5, 1, 2, 1)
    assert arrive((0, "ab", "xy"), (1, "ab", "ab")) == (pytest.approx(1 / 3), 1, 3, 2)  # corrected, late
    assert arrive((0, "ab", "ab"), (far, "ab", "ab")) == (1.0, 3, 3, 0)
    folders = [n for n in os.listdir(totals) if n.startswith("version=")]
    assert len(folders) <= 2  # one current table and its predecessor, however many batches


def test_a_killed_batch_is_written_again(spark, tmp_path, monkeypatch):
    source, totals, state = (str(tmp_path / n) for n in ("in", "totals", "state"))
    pairs = wide_to_pairs(samples.five_row_sample(spark))
    pairs.write.parquet(source)
    stream = incremental.pair_stream(spark, source)
    incremental.start_field_totals(stream, totals, state).awaitTermination()
    pairs.withColumn("row_idx", F.col("row_idx") + 100).write.mode("append").parquet(source)
    replaced = incremental._replaced

    def killed(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(incremental, "_replaced", killed)
    with pytest.raises(Exception, match="killed"):
        incremental.start_field_totals(stream, totals, state).awaitTermination()
    monkeypatch.setattr(incremental, "_replaced", replaced)
    incremental.start_field_totals(stream, totals, state).awaitTermination()
    assert {r.total_records for r in incremental.field_totals(spark, totals).collect()} == {10}


def test_a_repeated_job_replaces_its_part(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "report")
    lines = lambda *models: spark.createDataFrame([(m, m) for m in models], "model string, text string")
    sinks.write_model_report(lines("a", "b"), out, job="1")
    sinks.write_model_report(lines("a"), out, job="2")

    def killed(*args):
        raise RuntimeError("killed")

    moved = sinks.put_in_place
    monkeypatch.setattr(sinks, "put_in_place", killed)
    with pytest.raises(RuntimeError):
        sinks.write_model_report(lines("c"), out, job="1")
    read = lambda: sorted((str(r.job), r.model) for r in spark.read.parquet(out).collect())
    assert read() == [("1", "a"), ("1", "b"), ("2", "a")]  # a killed job leaves the old part
    monkeypatch.setattr(sinks, "put_in_place", moved)
    sinks.write_model_report(lines("c", "c"), out, job="1")
    assert read() == [("1", "c"), ("1", "c"), ("2", "a")]
    assert sorted(os.listdir(out)) == ["job=1", "job=2"]
    with pytest.raises(ValueError):
        sinks.write_model_report(lines("c"), out, job="a/b")


def test_a_workspace_leaves_nothing_behind(spark):
    with storage.workspace(spark):
        kept = storage.stored(spark.range(5), "numbers")
        path = kept.inputFiles()[0]
        with storage.workspace(spark):
            inner = storage.stored(kept, "inner").inputFiles()[0]
        assert kept.count() == 5
        assert not os.path.exists(inner.removeprefix("file://"))
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_stored_tables_go_with_their_application(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from proofgrid.plans.storage import stored
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
assert stored(spark.range(3), "t").count() == 3
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=120, cwd=tmp_path)
    # Spark itself leaves an empty folder there.
    assert not [n for n in os.listdir(tmp_path / "shared") if n.startswith("local-")]


def test_positional_zip(spark):
    schema = "k string, row_idx long, value string"
    truth = [("a", i, f"t{i}") for i in range(0, 2000, 2)] + [(None, 7, None), ("b", 1, "x")]
    predicted = [("a", i, f"p{i}") for i in range(1, 1800)] + [(None, 1, "n"), ("c", 4, "y"), ("c", 4, "y")]
    pairs, differing = joins.zip_tables(
        spark.createDataFrame(truth, schema).repartition(3), spark.createDataFrame(predicted, schema).repartition(5),
        ["k"], "row_idx",
    )
    got = {(r.k, r.position): (r.correct, r.predicted) for r in pairs.collect()}
    expected = {("a", i): (f"t{2 * i}", f"p{i + 1}") for i in range(1000)} | {(None, 0): (None, "n")}
    assert got == expected
    assert {(r.k, r.n_truths, r.n_predictions) for r in differing.collect()} == {("a", 1000, 1799), ("b", 1, 0), ("c", 0, 2)}
    assert "1000 vs 1799" in differing.filter("k = 'a'").first().message


def test_two_tables(spark):
    schema = "record_id string, field string, value string"
    truth = spark.createDataFrame([("1", "f", "a"), ("2", "f", "b"), ("3", "f", None)], schema)
    truth = truth.unionByName(spark.createDataFrame([(None, "f", "n")], schema))
    predicted = spark.createDataFrame([("1", "f", "a"), ("3", "f", "c"), ("4", "f", "d")], schema)
    pairs, lost = joins.align_tables(truth, predicted, ["record_id", "field"])
    assert {(r.record_id, r.correct, r.predicted) for r in pairs.collect()} == {
        ("1", "a", "a"), ("2", "b", None), ("3", None, "c"), (None, "n", None)
    }
    assert {(r.record_id, r.missing_in) for r in lost.collect()} == {
        ("2", "prediction"), ("4", "truth"), (None, "prediction")
    }
    assert joins.repeated_keys(truth, ["field"]).first().n == 4


def test_headed_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("編號,受編\n1,a\n", encoding="utf-8")
    df = tables.read_headed(spark, str(path))
    assert df.columns == ["編號", "受編"] and df.first()["受編"] == "a"
