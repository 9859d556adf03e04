"""Work per task and per pair does not grow with the tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from proofgrid.catalog import typed_documents
from proofgrid.config import ScoringConfig
from proofgrid.functions import editing, metrics
from proofgrid.functions.modelnames import MODEL_WORDS, TEXT_RULES, UNKNOWN_MODEL
from proofgrid.functions.textnorm import WHITESPACE, contains_any, strip
from proofgrid.operators import grid, layout, profile
from proofgrid.plans import certificate
from proofgrid.plans.storage import stored
from proofgrid.session import tune
from proofgrid.sources.samples import GRID_HEADER, GRID_ROWS, rows_from
from proofgrid.sources.tables import spread


def _most(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_spread_bounds_the_rows_of_a_task(spark):
    lopsided = spark.range(0, 6_400, 1, 64).filter("id < 1000 or id = 6000")
    assert spread(lopsided).groupBy(F.spark_partition_id()).count().count() >= (
        spark.sparkContext.defaultParallelism
    )
    even = spread(lopsided, rows=50)
    assert _most(even) <= 100
    assert sorted(r.id for r in even.collect()) == [*range(1000), 6000]
    assert spread(spark.range(0)).count() == 0


def test_words_of_a_pair_are_numbered_once(spark):
    pair = spark.createDataFrame([("a b  c d e", "a x c d")], "correct string, predicted string")
    rated = pair.select(metrics.wer("correct", "predicted").alias("wer"))
    plan = rated._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1
    assert rated.first().wer == 2 / 5


def _plain(left, right) -> int:
    row = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        above, row[0] = row[0], i
        for j, b in enumerate(right, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (a != b))
    return row[-1]


def test_band_yields_the_distance(monkeypatch):
    dice = random.Random(7)
    monkeypatch.setattr(editing, "_NARROW", 2)
    monkeypatch.setattr(editing, "_STRIPE", 3)
    for _ in range(300):
        left = "".join(dice.choices("abc", k=dice.randint(0, 60)))
        right = "".join(c for c in left if dice.random() < 0.8) + "".join(dice.choices("abc", k=dice.randint(0, 9)))
        assert editing.edit_distance(left, right) == _plain(left, right)
        assert editing._cost_in_band(left, right, abs(len(left) - len(right)) + 1) >= _plain(left, right)


def test_stripping_is_the_same_for_all_ends(spark):
    texts = [f"{a}{t}{b}" for a in ["", *WHITESPACE] for b in ("", " ", "　") for t in ("", "x", "x y", "日 期", "é")]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    rows = df.select("t", strip("t").alias("s")).collect()
    assert all(r.s == (None if r.t is None else r.t.strip()) for r in rows)


def test_shuffles_are_cut_finely(spark):
    tune(spark)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 1024


def test_only_needed_columns_of_the_scores_are_stored(spark, monkeypatch, tmp_path):
    spark.sql(
        "select 7L as o_orderkey, 3L as o_custkey, 'F' as o_orderstatus, 12.5D as o_totalprice,"
        " timestamp_ntz'2020-01-02 00:00:00' as o_orderdate, '1-URGENT' as o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    seen = []

    def kept(df, name):
        seen.extend(df.columns)
        return df

    monkeypatch.setattr(typed_documents, "stored", kept)
    assert typed_documents._whole_cases(spark, str(tmp_path)).count() == 10
    assert not {"norm_correct", "similarity", "error_description"} & set(seen)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_found_without_cleaning_all_cells(spark, monkeypatch):
    """Cells are stripped where they are put out; the choice of blocks reads the multi-model rows alone."""
    seen = {}

    def kept(df, name, path=None):
        seen[name] = df
        return stored(df, name, path)

    monkeypatch.setattr(layout, "stored", kept)
    monkeypatch.setattr(certificate, "stored", kept)
    sheet = [[None, " gemma 3 "], GRID_HEADER, GRID_ROWS[0], [None, "ChatGPT\n"], GRID_HEADER, [" 2 ", *GRID_ROWS[1][1:]]]
    rows = rows_from(spark, {"v": sheet, "s": [GRID_HEADER, *GRID_ROWS]})
    layouts, blocks = certificate.find_blocks(rows, ScoringConfig())
    assert {tuple(r) for r in layouts.collect()} == {("v", "vertical"), ("s", "single")}
    data = {(r.workbook, r.model, r["values"][0]) for r in blocks.data.filter("workbook = 'v'").collect()}
    assert data == {("v", "gemma 3", "1"), ("v", "ChatGPT", "2")}
    assert {r.workbook for r in seen["several"].collect()} == {"v"}
    assert "trim(" not in _plan(seen["blocks"])


def test_model_names_are_sought_only_where_a_cell_names_one(spark, monkeypatch):
    asked = []

    def common(rows, headers, cfg, search=grid.common_model_name):
        asked.extend(r.workbook for r in headers.collect())
        return search(rows, headers, cfg)

    monkeypatch.setattr(grid, "common_model_name", common)
    plain = [[c.replace("手冊", "證") for c in GRID_HEADER], *GRID_ROWS, *GRID_ROWS]
    deep = [*plain, ["9", "x", None, None, None, "made by Claude 3"]]
    rows = rows_from(spark, {"plain": plain, "deep": deep, "top": [["Gemma3 結果"], *plain], "near": [*plain, ["gpt 5"]]})
    facts = stored(profile.workbook_profile(rows), "profile")
    found = profile.model_names(facts, rows, stored(profile.headers(facts), "heads"), ScoringConfig())
    assert dict(map(tuple, found.collect())) == {
        "plain": UNKNOWN_MODEL, "deep": "Claude", "top": "gemma3", "near": UNKNOWN_MODEL,
    }
    assert sorted(asked) == ["deep", "near"]


def test_text_rules_see_only_rows_with_a_model_word(spark):
    assert all(any(w in pattern for w in MODEL_WORDS) for pattern, _ in TEXT_RULES)
    rows = rows_from(spark, {"w": [["id", "model"], ["1", "GPT-4"], ["2", None], ["bard", "llama x"], ["gpt"]]})
    cells = grid.named_cells(rows, profile.headers(profile.workbook_profile(rows)), ScoringConfig())
    assert "palm|bard" in _plan(cells)
    heads = spark.createDataFrame([("w", 0, ["id", "model"])], "workbook string, header_row int, header array<string>")
    got = {(r.row_idx, r.col_idx, r.name, r.hinted) for r in grid.named_cells(rows, heads).collect()}
    assert got == {(1, 1, "GPT-4", True), (3, 0, "Bard", False), (3, 1, "LLaMA", True)}


def test_rows_with_few_words_are_no_headers(spark):
    dice = random.Random(5)
    parts = [*grid.HEADER_WORDS, "", " ", "x", "障", "\n", None]
    rows = [[dice.choice(parts) for _ in range(dice.randint(0, 6))] for _ in range(200)]
    rows += [["障礙證明類別"], ["障", "礙"], ["障礙證明", "證明類別", "x"], None]
    df = spark.createDataFrame([(r,) for r in rows], "v array<string>")
    least = [grid.holds_header_words(F.col("v"), n) for n in (1, 2, 3)]
    plain = [grid.header_words_in(F.col("v")) >= n for n in (1, 2, 3)]
    assert all(tuple(r.a) == tuple(r.b) for r in df.select(F.array(*least).alias("a"), F.array(*plain).alias("b")).collect())
    assert "regexp_count" in str(least[0]) or "regexp_extract_all" in _plan(df.select(least[0]))


def test_keywords_are_taken_literally(spark):
    words = ["^a", "-b", "]c", "[d", "\\e", "f.g", "第1類"]
    texts = [*words, "a", "b", "xf.g", "fxg", "x\n^a", "第2類", "e", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", contains_any("t", words).alias("has"), contains_any("t", [""]).alias("any")).collect():
        assert r.has == any(w in (r.t or "") for w in words) and r.any
