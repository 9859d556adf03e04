"""The shape of the physical plans: what must and what must not be in them."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from proofgrid.catalog import inputs, sheets
from proofgrid.operators import aggregate, grid, layout, profile, wide
from proofgrid.operators.joins import sliced_join, with_facts
from proofgrid.plans.storage import stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module", autouse=True)
def plain_scan(spark):
    """Small scans are not spread over cores here, so that only the operators show."""
    keep = inputs.spread
    inputs.spread = lambda df: df
    yield
    inputs.spread = keep


def test_scoring_needs_no_shuffle(spark):
    for scores in (inputs.certificate_scores(spark, FOLDER), inputs.document_scores(spark, FOLDER)):
        text = plan(scores)
        assert "Exchange" not in text and "Python" not in text


def test_distance_is_in_the_plan_once(spark):
    scores = inputs.certificate_scores(spark, FOLDER)
    text = plan(scores.select("similarity", "cer", "is_exact_match", "is_mismatch"))
    assert text.count("levenshtein") == 1


def test_wide_records_need_no_shuffle(spark):
    assert "Exchange" not in plan(wide.score_records(inputs.certificates(spark, FOLDER)))


def test_field_evaluation_combines_before_its_one_shuffle(spark):
    text = plan(aggregate.field_evaluation(inputs.certificate_scores(spark, FOLDER)))
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2
    assert "partial_avg" in text and "SortAggregate" not in text


def test_unused_columns_are_not_read(spark):
    fields = aggregate.field_evaluation(inputs.certificate_scores(spark, FOLDER), ["model"])
    text = plan(fields)
    assert "ReadSchema" in text and "c_acctbal" not in text.split("ReadSchema")[1].split("\n")[0]


def test_head_scans_push_their_filter_down(spark, tmp_path):
    path = str(tmp_path / "rows")
    sheets.sheets(spark, FOLDER, "single").write.parquet(path)
    text = plan(grid.header_rows(spark.read.parquet(path)))
    assert "LessThan(row_idx" in text


def test_a_profile_is_one_scan_and_one_shuffle(spark):
    text = plan(profile.workbook_profile(sheets.kept_sheets(spark, FOLDER, "single")))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange") == 1
    assert "partial_collect_list" in text and "Window" not in text


def test_pairs_of_single_sheets_are_one_scan_next_to_their_map(spark):
    rows, pair_map = sheets._single_map(spark, FOLDER, "single")
    text = plan(layout.extract_single_pairs(rows, pair_map, sheets.CFG))
    assert text.count("FileScan parquet") == 2
    assert "hashpartitioning" not in text and "Aggregate" not in text and "Window" not in text


def test_blocks_need_no_window_and_no_shuffle_of_rows(spark):
    for blocks in (
        layout.split_vertically(sheets.kept_sheets(spark, FOLDER, "vertical"), sheets.CFG),
        layout.split_horizontally(sheets.kept_sheets(spark, FOLDER, "horizontal"), sheets.CFG),
    ):
        text = plan(blocks.data)
        assert "Window" not in text and "hashpartitioning" not in text and "SortAggregate" not in text


def test_large_facts_are_not_sent_to_all_tasks(spark):
    rows = spark.range(200).select(F.concat(F.lit("w"), F.col("id") % 3).alias("workbook"), F.col("id").alias("row_idx"))
    facts = spark.createDataFrame([("w0", 5), ("w1", 6)], "workbook string, v int")
    small = with_facts(rows, facts, ["workbook"], "row_idx", 4)
    large = with_facts(rows, facts, ["workbook"], "row_idx", 4, build_bytes=10)
    assert sorted(small.collect()) == sorted(large.select(*small.columns).collect())
    assert "_slice" not in plan(small) and "_slice" in plan(large)


def test_texts_stay_out_of_aggregates(spark):
    scores = stored(inputs.document_scores(spark, FOLDER), "scores")
    text = plan(aggregate.document_cases_nested(aggregate.document_cases_with_texts(scores)))
    assert "SortAggregate" not in text
    text = plan(aggregate.last_wins(scores, ["workbook", "case_id", "field"], "row_idx", ["correct"]))
    assert "SortAggregate" not in text and text.count("Exchange") <= 3


def test_no_cross_joins_and_no_forced_broadcasts(spark):
    rows = spark.range(10).select(F.lit("w").alias("workbook"), F.col("id").alias("row_idx"))
    small = spark.createDataFrame([("w", 1)], "workbook string, v int")
    joined = sliced_join(rows, small, ["workbook"], "row_idx", 4)
    assert joined.count() == 10
    assert sliced_join(rows, small, ["workbook"], "row_idx", 1).count() == 10
    for name in ("single", "vertical"):
        text = plan(grid.dominant_model_name(
            sheets.sheets(spark, FOLDER, name), grid.header_rows(sheets.sheets(spark, FOLDER, name))
        ))
        assert "CartesianProduct" not in text and "NestedLoop" not in text
