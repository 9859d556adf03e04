"""Sample tables with independently computed numbers."""

import pytest
from pyspark.sql import functions as F

from proofgrid.config import DEFAULT_MAPPING, ScoringConfig
from proofgrid.operators import aggregate, wide
from proofgrid.operators.pairing import wide_to_pairs
from proofgrid.operators.scoring import score_pairs
from proofgrid.plans.certificate import evaluate_pairs, evaluate_workbooks
from proofgrid.plans.document import evaluate_documents
from proofgrid.sources import samples

close = pytest.approx

FIELDS = {
    "F1": {"障礙等級": (1.0, 2, 2, 0, 0), "障礙類別": (0.6875, 1, 2, 1, 0.3125),
           "ICD診斷": (0.928571428571429, 1, 2, 0, 0.071428571428571)},
    "F2": {"障礙等級": (1.0, 5, 5, 0, 0), "障礙類別": (0.75, 3, 5, 2, 0.306186217847897),
           "ICD診斷": (0.971428571428571, 4, 5, 0, 0.057142857142857)},
    "F3": {"障礙等級": (1.0, 5, 5, 0, 0), "障礙類別": (0.875, 4, 5, 1, 0.25),
           "ICD診斷": (0.971428571428571, 4, 5, 0, 0.057142857142857)},
}
OVERALL = {"F1": 0.868697478991596, "F2": 0.903361344537815, "F3": 0.947478991596639}
RECORDS = {
    "F1": [0.791666666666667, 0.952380952380952],
    "F2": [0.791666666666667, 0.952380952380952, 1, 0.791666666666667, 1],
    "F3": [0.791666666666667, 0.952380952380952, 1, 1, 1],
}
PERFECT = {"F1": 0, "F2": 2, "F3": 3}
BANDS = {"F1": (1, 1, 0, 0), "F2": (3, 2, 0, 0), "F3": (4, 1, 0, 0)}


@pytest.fixture(scope="module")
def evaluations(spark):
    wide_form = {"F1": samples.two_row_sample(spark), "F2": samples.five_row_sample(spark)}
    out = {k: evaluate_pairs(wide_to_pairs(df)) for k, df in wide_form.items()}
    out["F3"] = evaluate_workbooks(samples.duplicate_header_sample(spark))
    return out


@pytest.mark.parametrize("name", ["F1", "F2", "F3"])
def test_field_numbers(evaluations, name):
    got = {r.field: r for r in evaluations[name].fields.collect()}
    stats = {r.field: r for r in evaluations[name].statistics.collect()}
    assert set(got) == set(FIELDS[name])
    for field, (mean, exact, n, mismatched, std) in FIELDS[name].items():
        row = got[field]
        assert row.accuracy == close(mean)
        assert (row.exact_matches, row.total_records, row.mismatched) == (exact, n, mismatched)
        assert stats[field].std_accuracy == close(std, abs=1e-12)


@pytest.mark.parametrize("name", ["F1", "F2", "F3"])
def test_overall_records_and_bands(evaluations, name):
    ev = evaluations[name]
    assert ev.overall.first().overall_accuracy == close(OVERALL[name])
    means = [r.overall_accuracy for r in ev.records.orderBy("row_idx").collect()]
    assert means == close(RECORDS[name])
    summary = ev.summary.first()
    assert summary.perfect_records == PERFECT[name]
    assert summary.total_records == len(RECORDS[name])
    bands = {r.band: r["count"] for r in ev.distribution.collect()}
    assert tuple(bands[b] for b in ("excellent", "good", "fair", "poor")) == BANDS[name]


def test_wide_record_scores_agree_with_long_form(spark, evaluations):
    got = wide.score_records(samples.five_row_sample(spark)).orderBy("row_idx").collect()
    assert [r.overall_accuracy for r in got] == close(RECORDS["F2"])
    assert sum(r.matched_fields == r.total_fields for r in got) == PERFECT["F2"]


def test_gestalt_method(spark):
    scores = score_pairs(
        wide_to_pairs(samples.two_row_sample(spark)), ScoringConfig(method="gestalt")
    )
    low = sorted(r.similarity for r in scores.filter("similarity < 1").collect())
    assert low == close([0.545454545454545, 0.857142857142857])


DOCUMENT_GRID = [
    ["MODEL", "modelA", None, "modelB", None, None, None],
    ["案件號", "發文日期", "人工", "得請領_金額", "人工", "發文字號", "人工"],
    ["C1", "1140424", "1140430", "1,200", "1200", "A113001", "A1130001"],
    ["C2", "1140524", "1140424", None, "0", "A1", "A1"],
    ["C3", None, None, "1250", "1200", None, "A2"],
]


def test_document_grid(spark):
    result = evaluate_documents(samples.rows_from(spark, {"doc": DOCUMENT_GRID}))
    got = {(r.model, r.field, r.case_id): r for r in result.scores.collect()}
    expected = {
        ("modelA", "發文日期", "C1"): ("日期", 1.0, 1 / 9, True),
        ("modelA", "發文日期", "C2"): ("日期", 2 / 3, 1 / 9, False),
        ("modelB", "得請領_金額", "C1"): ("金額", 1.0, 0.0, True),
        ("modelB", "得請領_金額", "C2"): ("金額", 1.0, 1.0, True),
        ("modelB", "得請領_金額", "C3"): ("金額", 0.0, 1 / 6, False),
        ("modelB", "發文字號", "C1"): ("文字", 1 - 1 / 8, 1 / 8, False),
        ("modelB", "發文字號", "C2"): ("文字", 1.0, 0.0, True),
        ("modelB", "發文字號", "C3"): ("文字", 0.0, 1.0, False),
    }
    assert set(got) == set(expected)
    for key, (kind, similarity, rate, exact) in expected.items():
        row = got[key]
        assert row.field_type == kind and row.is_exact_match == exact, key
        assert row.similarity == close(similarity) and row.cer == close(rate), key
        assert row.wer == row.cer
    rates = {r.field: r.accuracy_rate for r in result.fields.collect()}
    assert rates == {"發文日期": close(1 / 2), "得請領_金額": close(2 / 3), "發文字號": close(1 / 3)}
    summary = result.summary.first()
    assert summary.overall_accuracy == close(0.5)
    assert (summary.total_fields, summary.total_cases) == (3, 3)
    mean = {(r.model, r.case_id): r.accuracy
            for r in result.report.filter("kind = 'overall'").collect()}
    assert mean[("modelB", "C1")] == 50.0 and mean[("modelB", "C2")] == 100.0
    assert {r.value_set_id for r in result.report.collect()} == {"string"}
    assert result.diagnostics.isEmpty()


def test_mapping_default_names(spark):
    assert list(DEFAULT_MAPPING) == ["障礙等級", "障礙類別", "ICD診斷"]
    pairs = wide_to_pairs(samples.two_row_sample(spark))
    assert pairs.count() == 6
    assert aggregate.ordered_fields(pairs).orderBy("position").first().field == "障礙等級"
    assert pairs.filter(F.col("subject_id") == "ZA24761194").count() == 3
