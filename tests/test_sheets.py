"""Layout rules, header state and traps on small sheets."""

import pytest
from pyspark.sql import functions as F

from proofgrid.config import ScoringConfig
from proofgrid.operators import aggregate, documents, grid, layout
from proofgrid.operators.ordered import carry_forward, number_rows
from proofgrid.operators.scoring import score_document_pairs
from proofgrid.plans.certificate import evaluate_workbooks, find_blocks
from proofgrid.plans.document import evaluate_documents
from proofgrid.sources.samples import GRID_HEADER, GRID_ROWS, rows_from

CFG = ScoringConfig(chunk_rows=3, hot_splits=3)


def model_row(name, width=10):
    return [None, name, *[None] * (width - 2)]


def test_chunked_scans_on_one_hot_sheet(spark):
    data = [("hot", i * 2, i % 7 == 3) for i in range(100)] + [("cold", 5, False), ("cold", 9, True)]
    df = spark.createDataFrame(data, "workbook string, row_idx bigint, mark boolean")
    carried = carry_forward(df, ["workbook"], "row_idx", F.when(F.col("mark"), F.col("row_idx")),
                            "last", 10)
    numbered = number_rows(carried, ["workbook"], "row_idx", "n", 10).collect()
    last, n = {}, {}
    for r in sorted(numbered, key=lambda r: (r.workbook, r.row_idx)):
        if r.mark:
            last[r.workbook] = r.row_idx
        assert r.last == last.get(r.workbook)
        assert r.n == n.get(r.workbook, 0)
        n[r.workbook] = r.n + 1
    assert n == {"hot": 100, "cold": 2}


def vertical(spark, *sheet):
    return layout.split_vertically(rows_from(spark, {"v": list(sheet)}), CFG)


def test_vertical_blocks_with_note_and_repeat(spark):
    blocks = vertical(
        spark,
        ["before any model"],
        model_row("gemma 3"), ["note"], GRID_HEADER, GRID_ROWS[0],
        model_row("ChatGPT"), GRID_HEADER, GRID_ROWS[1], [" ", None],
        model_row("gemma 3"), GRID_HEADER, GRID_ROWS[2], GRID_ROWS[3],
    )
    rows = blocks.data.orderBy("row_idx").collect()
    assert [(r.model, r.row_idx) for r in rows] == [("ChatGPT", 7), ("gemma 3", 11), ("gemma 3", 12)]
    assert rows[0]["values"][5] == "" and len(rows[0]["values"]) == 10
    heads = {r.model: r.header for r in blocks.headers.collect()}
    assert heads["gemma 3"] == GRID_HEADER


def test_crowded_sheets_have_the_same_blocks(spark):
    """More naming rows than an array may hold: the block is carried from row to row."""
    sheet = [
        ["before"], model_row("gemma 3"), ["note"], GRID_HEADER, GRID_ROWS[0], model_row("ChatGPT"), GRID_HEADER,
        GRID_ROWS[1], [" ", None], model_row("gemma 3"), GRID_HEADER, GRID_ROWS[2], GRID_ROWS[3],
    ]
    rows = rows_from(spark, {"v": sheet, "w": sheet[:5], "x": [["no model"], GRID_HEADER]})

    def blocks(max_starts):
        cfg = ScoringConfig(chunk_rows=3, hot_splits=3, max_starts=max_starts)
        found = layout.split_vertically(rows, cfg)
        return sorted(map(str, found.data.collect())), sorted(map(str, found.headers.collect()))

    assert blocks(1) == blocks(256)


def test_first_row_of_a_block_becomes_the_header(spark):
    blocks = vertical(
        spark, model_row("gemma 3"), ["note"], GRID_HEADER, GRID_ROWS[0],
        model_row("ChatGPT"), GRID_HEADER,
    )
    heads = {r.model: r.header for r in blocks.headers.collect()}
    assert heads["gemma 3"] == ["note"] + [""] * 9
    data = {(r.model, r.row_idx) for r in blocks.data.collect()}
    # The keyword row is data below a note; a last block with a header only keeps it as data.
    assert data == {("gemma 3", 2), ("gemma 3", 3), ("ChatGPT", 5)}
    assert heads["ChatGPT"] == [str(i) for i in range(10)]


def test_header_only_block_before_another_is_dropped(spark):
    blocks = vertical(spark, model_row("gemma 3"), GRID_HEADER, model_row("ChatGPT"), GRID_HEADER,
                      GRID_ROWS[0])
    assert {r.model for r in blocks.data.collect()} == {"ChatGPT"}


def test_data_cell_that_names_a_model_starts_a_block(spark):
    odd = list(GRID_ROWS[1])
    odd[5] = "palm print"
    blocks = vertical(spark, model_row("gemma 3"), GRID_HEADER, GRID_ROWS[0], odd, GRID_ROWS[2])
    assert {r.model for r in blocks.headers.collect()} == {"gemma 3", "palm print"}


WIDE = GRID_HEADER[:6] + GRID_HEADER[6:] + GRID_HEADER[6:]
WIDE_ROWS = [r + ["輕度", "x", "其他類", "【換16.1】"] for r in GRID_ROWS]
TOP = [*[None] * 6, "claude-3", *[None] * 3, "gemini", *[None] * 3]


def test_horizontal_blocks(spark):
    rows = rows_from(spark, {"h": [TOP, [None], [None], WIDE, *WIDE_ROWS]})
    blocks = layout.split_horizontally(rows, CFG)
    data = {(r.model, r.row_idx): r["values"] for r in blocks.data.collect()}
    assert len(data) == 10
    assert data[("gemini", 4)] == [*WIDE_ROWS[0][:6], "輕度", "x", "其他類", "【換16.1】"]
    assert data[("claude-3", 4)][5] is None
    layouts, _ = find_blocks(rows, CFG)
    assert layouts.first().layout == "horizontal"


def test_whole_job_over_mixed_workbooks(spark):
    rows = rows_from(
        spark,
        {
            "v": [model_row("gemma 3"), GRID_HEADER, *GRID_ROWS,
                  model_row("ChatGPT"), GRID_HEADER, *GRID_ROWS[:2]],
            "h": [TOP, [None], [None], WIDE, *WIDE_ROWS],
            "s": [["結果"], GRID_HEADER, *GRID_ROWS],
            "bad": [["a", "b"], ["c", "d"]],
            "nomap": [["編號", "受編", "障礙一", "類別一", "備註", "手冊"], ["1", "x", "a", "b", "c", "d"]],
        },
    )
    result = evaluate_workbooks(rows, CFG)
    fields = {(r.workbook, r.model, r.field): r for r in result.fields.collect()}
    assert fields[("v", "gemma 3", "障礙類別")].accuracy == pytest.approx(0.875)
    assert fields[("s", "未知模型", "ICD診斷")].exact_matches == 4
    assert fields[("h", "claude-3", "障礙等級")].total_records == 5
    problems = {r.workbook: r for r in result.diagnostics.collect()}
    assert set(problems) == {"bad", "nomap"}
    assert problems["bad"].error_type == "FileProcessingError"
    assert "正面_障礙等級" in problems["nomap"].missing_columns
    records = result.records.filter("workbook = 's'").orderBy("row_idx").collect()
    assert [r.subject_id for r in records] == [r[1] for r in GRID_ROWS]


def test_null_rules_differ_by_layout(spark):
    """Stacked blocks turn blanks into text that is scored; single sheets skip missing truths."""
    gap = list(GRID_ROWS[0])
    gap[2] = gap[6] = None
    rows = rows_from(
        spark,
        {"v": [model_row("gemma 3"), GRID_HEADER, gap, model_row("bard"), GRID_HEADER, gap],
         "s": [GRID_HEADER, gap]},
    )
    result = evaluate_workbooks(rows, CFG)
    counted = {(r.workbook, r.model): r.total_fields for r in result.records.collect()}
    assert counted[("v", "gemma 3")] == 3 and counted[("s", "未知模型")] == 2


def test_header_mapping_rules(spark):
    headers = [
        (1, ["正面_障礙等級", "反面_障礙等級", "ICD", "診斷", "x"]),
        (2, ["障礙等級", "x", "障礙等級.1"]),
        (3, ["x", "y"]),
    ]
    df = spark.createDataFrame(headers, "i int, header array<string>")
    got = {r.i: [(e.field, e.truth_col, e.pred_col) for e in r.m]
           for r in df.select("i", layout.map_by_name(F.col("header")).alias("m")).collect()}
    assert got == {1: [("障礙等級", 0, 1), ("ICD診斷", 2, 3)], 2: [("障礙等級", 0, 2)], 3: []}
    labels = df.select(grid.distinct_headers(F.array(*map(F.lit, "abaca"))).alias("d")).first().d
    assert labels == ["a", "b", "a.1", "c", "a.2"]


def test_answer_sheet_needs_ids_first(spark):
    header = ["編號", "受編", "解答", "a", "b", "c", "LLM辨識", "d", "e", "f"]
    df = spark.createDataFrame([(header,), (header[::-1],)], "header array<string>")
    sizes = [r[0] for r in df.select(F.size(layout.map_answer_sheet(F.col("header")))).collect()]
    assert sizes == [3, 0]


def test_document_header_traps(spark):
    sheet = [
        ["MODEL", "m1", None, "m2", None, "m2", None],
        ["案件號", "Human", "債務人ID", "f1", "人工", "f1", "Manual"],
        ["C1", "1", "2", "3", "4", "5", "6"],
    ]
    found = documents.document_pair_map(rows_from(spark, {"d": sheet})).collect()
    got = {(r.model, r.field): (r.ai_col, r.human_col, r.field_order) for r in found}
    # "Human" marks a column yet passes as a field name; a repeated field keeps its last columns.
    assert got == {("m1", "Human"): (1, 1, 1), ("m2", "f1"): (5, 6, 4)}


def test_repeated_and_missing_case_ids(spark):
    sheet = [
        ["MODEL", "m1", None], ["案件號", "f1", "人工"],
        ["C1", "a", "a"], ["C1", "a", "b"], [None, "x", "x"],
    ]
    result = evaluate_documents(rows_from(spark, {"d": sheet, "short": sheet[:2]}))
    cases = {r.case_id: r.accuracy for r in result.cases.collect()}
    assert cases == {"C1": 0.0, "nan": 100.0}
    assert result.fields.first().total_cases == 3
    problems = {(r.workbook, r.stage) for r in result.diagnostics.collect()}
    assert problems == {("short", "read")}


def test_adjacent_columns_use_up_their_partner(spark):
    rows = rows_from(spark, {"d": [["x", "A", "人工", "人工", "B", None, "C", "D"]]})
    got = {r.model: (r.ai_col, r.human_col) for r in
           documents.adjacent_model_columns(rows).collect()}
    assert got == {"A": (1, 2), "B": (4, 5)}


def test_document_record_types(spark):
    pairs = spark.createDataFrame(
        [("w", "m", 1, "C", "發文日期", 0, "1140424", "1140430"), ("w", "m", 1, "C", "金額", 1, "1", "2"),
         ("w", "m", 1, "C", "金額2", 2, "3", "3")],
        "workbook string, model string, row_idx bigint, case_id string, field string,"
        " field_order int, correct string, predicted string",
    )
    row = aggregate.document_record_evaluation(score_document_pairs(pairs)).first()
    assert row.field_type_accuracy == {"日期": 1.0, "金額": 0.5}
    assert row.overall_accuracy == pytest.approx(2 / 3) and row.matched_fields == 2
