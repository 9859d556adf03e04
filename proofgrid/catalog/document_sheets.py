"""Catalogue: document sheets derived from orders, and their header rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofgrid.catalog import inputs
from proofgrid.catalog.certificates import rounded
from proofgrid.catalog.registry import register, table
from proofgrid.config import DEFAULT_DOCUMENT_MAPPING, ScoringConfig
from proofgrid.operators import aggregate, documents
from proofgrid.plans import document
from proofgrid.plans.storage import stored

CFG = ScoringConfig(chunk_rows=100, hot_splits=4)

# Field names and header labels.
FIELDS = ["發文日期", "得請領_金額", "發文字號"]
# Header rows of even and of odd books. Odd books have a debtor column, a field that is mapped twice
# and a human column without a field of its own.
MODEL_ROW = {
    0: ["MODEL", "gemma 3 27b qat", None, "chatgpt 4.1", None, None, None],
    1: ["MODEL", None, "gemma 3 27b qat", "human", "chatgpt 4.1", None, None, "人工", "人工"],
}
FIELD_ROW = {
    0: ["案件號", "發文日期", "人工", "得請領_金額", "人工", "發文字號", "human"],
    1: ["案件號", "債務人ID", "發文日期", "Manual", "得請領_金額", "人工", "發文字號", "人工", "人工"],
}


def _list(values: list, spark: bool) -> str:
    items = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"cast(array({items}) as array<string>)" if spark else f"cast([{items}] as varchar[])"


def _case_cells(book: int, spark: bool) -> str:
    values = inputs.document_values("spark" if spark else "duckdb")
    sides = [side for f in FIELDS for side in (values[f][1], values[f][0])]
    first = "case when o_orderkey % 29 <> 0 then concat('C', o_custkey) end"
    if book:
        # The last human column repeats the truth of the first field.
        cells = [first, "'D1'", *sides, sides[1]]
    else:
        cells = [first, *sides]
    opening, closing = ("array(", ")") if spark else ("[", "]")
    return opening + ", ".join(cells) + closing


def _statement(spark: bool) -> str:
    text = "string" if spark else "varchar"
    kind = f"array<{text}>" if spark else f"{text}[]"
    name = "values" if spark else "vals"
    head = "(select distinct o_custkey % 10 as book from orders)"
    parts = []
    for odd in (0, 1):
        for number, row in ((0, MODEL_ROW), (1, FIELD_ROW)):
            parts.append(
                f"select concat('book_', book) as workbook, cast({number} as bigint) as row_idx,"
                f" {_list(row[odd], spark)} as {name} from {head} where book % 2 = {odd}"
            )
        parts.append(
            f"select concat('book_', o_custkey % 10) as workbook, o_orderkey + 2 as row_idx,"
            f" cast({_case_cells(odd, spark)} as {kind}) as {name}"
            f" from (select *, 0 as m from orders) where o_custkey % 10 % 2 = {odd}"
        )
    return " union all ".join(parts)


def document_sheets(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return spark.sql(_statement(True).replace("from orders", "from {orders}"), orders=orders)


GRID = f"grid as materialized ({_statement(False)})"
HEADER_CTE = """columns_ as materialized (
  select m.workbook, i - 1 as col_idx, trim(coalesce(m.vals[i], '')) as m,
    trim(coalesce(f.vals[i], '')) as f
  from (select *, unnest(range(1, 10)) as i from grid where row_idx = 0) m
  join grid f on f.workbook = m.workbook and f.row_idx = 1),
models as materialized (
  select *, last_value(case when m not in ('', 'MODEL') then m end ignore nulls)
    over (partition by workbook order by col_idx) as model from columns_),
carried as materialized (
  select *, max(case when m not in ('', 'MODEL') or (model is not null and f not in
    ('', '人工', 'human', 'manual', 'Human', 'Manual', '案件號', '債務人ID')) then col_idx end)
    over (partition by workbook order by col_idx) as ai_col from models),
found as materialized (
  select c.workbook, c.model, a.f as field, c.ai_col, c.col_idx as human_col
  from carried c join columns_ a on a.workbook = c.workbook and a.col_idx = c.ai_col
  where c.f in ('人工', 'human', 'manual', 'Human', 'Manual') and c.model is not null
    and a.f not in ('', '人工', 'human', 'manual', '案件號', '債務人ID')),
pair_map as materialized (
  select * from (select *, row_number() over
      (partition by workbook, concat(field, '_', model) order by human_col desc) as rn,
    min(human_col) over (partition by workbook, concat(field, '_', model)) as field_order
  from found) where rn = 1),
pairs as materialized (
  select g.workbook, p.model, g.row_idx, coalesce(g.vals[1], 'nan') as case_id, p.field,
    p.field_order, g.vals[human_col + 1] as correct, g.vals[ai_col + 1] as predicted
  from grid g join pair_map p on p.workbook = g.workbook where g.row_idx >= 2)"""


def sheet_sql(select: str, *extra: str) -> str:
    return "with " + ", ".join([GRID, HEADER_CTE, *extra]) + " " + select


register(
    "win02_carried_columns",
    lambda spark, folder: documents.document_pair_map(document_sheets(spark, folder)).select(
        "workbook", "model", "field", F.col("ai_col").cast("bigint").alias("ai_col"),
        F.col("human_col").cast("bigint").alias("human_col"),
    ),
    sheet_sql("select workbook, model, field, ai_col, human_col from pair_map"),
)
def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(document_sheets(spark, folder), "document-sheets")
    return documents.document_pairs(rows, documents.document_pair_map(rows), CFG)


register(
    "rsh10_document_pairs",
    lambda spark, folder: _pairs(spark, folder).select(
        "workbook", "model", "row_idx", "case_id", "field", "correct", "predicted"
    ),
    sheet_sql("select workbook, model, row_idx, case_id, field, correct, predicted from pairs"),
)
register(
    "jn03_header_lookup",
    lambda spark, folder: _pairs(spark, folder).groupBy("workbook", "model", "field").agg(
        F.count("correct").alias("truths"), F.count("predicted").alias("predictions")
    ),
    sheet_sql(
        "select workbook, model, field, count(correct) as truths, count(predicted) as predictions"
        " from pairs group by all"
    ),
)
ADJACENT_CTE = """nexts as materialized (
  select workbook, i - 1 as col_idx, trim(coalesce(vals[i], '')) as name,
    case when i < len(vals) then trim(coalesce(vals[i + 1], '')) end as following
  from (select *, unnest(range(1, len(vals) + 1)) as i from grid where row_idx = 0)),
candidates as materialized (
  select * from nexts where col_idx >= 1 and name <> ''
    and following in ('', '人工', 'human', 'manual')),
adjacent as materialized (
  select workbook, name as model, max(col_idx) as ai_col, max(col_idx) + 1 as human_col from (
    select *, row_number() over (partition by workbook, run order by col_idx) as pos from (
      select *, col_idx - row_number() over (partition by workbook order by col_idx) as run
      from candidates)) where pos % 2 = 1 group by all)"""


def _adjacent(spark, folder):
    return documents.adjacent_model_columns(document_sheets(spark, folder))


for _name in ("rsh11_adjacent_columns", "win04_next_cell"):
    register(
        _name,
        lambda spark, folder: _adjacent(spark, folder).select(
            "workbook", "model", F.col("ai_col").cast("bigint").alias("ai_col"),
            F.col("human_col").cast("bigint").alias("human_col"),
        ),
        f"with {GRID}, {ADJACENT_CTE} select * from adjacent",
    )
FIELD_ROWS_CTE = """field_rows as materialized (
  select workbook, trim(vals[i]) as field, max(i) - 1 as position
  from (select *, unnest(range(1, len(vals) + 1)) as i from grid where row_idx = 1 and vals[1] = '案件號')
  where trim(coalesce(vals[i], '')) not in ('', '人工', 'human', 'manual', 'Human', 'Manual')
  group by all)"""
DOWN_CTE = """down_rows as materialized (
  select workbook, trim(vals[1]) as field, max(row_idx) as position from grid
  where row_idx between 1 and 9 and trim(coalesce(vals[1], '')) not in ('', '案件號', 'MODEL')
    and vals[1] not like '99099%' group by all)"""
register(
    "rsh12_field_positions",
    lambda spark, folder: documents.field_rows(document_sheets(spark, folder)).select(
        "workbook", "field", F.col("position").cast("bigint").alias("position")
    ),
    f"with {GRID}, {FIELD_ROWS_CTE} select * from field_rows",
)


def _without_field_row(spark, folder):
    """The same sheets where the field row is missing, so fields stand in the first column."""
    return document_sheets(spark, folder).filter("row_idx <> 1")


register(
    "rsh12_fields_down",
    lambda spark, folder: documents.field_rows(_without_field_row(spark, folder)).select(
        "workbook", "field", F.col("position").cast("bigint").alias("position")
    ),
    f"with {GRID.replace('grid as', 'all_rows as', 1)},"
    f" grid as materialized (select * from all_rows where row_idx <> 1), {DOWN_CTE} select * from down_rows",
)


def _model_values(spark, folder):
    rows = stored(document_sheets(spark, folder), "document-sheets")
    return documents.model_field_values(
        rows, documents.adjacent_model_columns(rows), documents.field_rows(rows)
    )


register(
    "rsh13_model_field_values",
    lambda spark, folder: _model_values(spark, folder).select(
        "workbook", "model", "field", F.col("row_idx").cast("bigint").alias("row_idx"), "correct",
        "predicted",
    ),
    f"with {GRID}, {ADJACENT_CTE}, {FIELD_ROWS_CTE} select a.workbook, a.model, f.field,"
    " f.position as row_idx, g.vals[human_col + 1] as correct, g.vals[ai_col + 1] as predicted"
    " from adjacent a join field_rows f on f.workbook = a.workbook"
    " left join grid g on g.workbook = a.workbook and g.row_idx = f.position",
)
KEPT = "where correct is not null or predicted is not null"
register(
    "agg14_document_summary",
    lambda spark, folder: rounded(
        document.evaluate_documents(document_sheets(spark, folder), CFG).summary,
        "overall_accuracy",
    ),
    sheet_sql(
        "select workbook, count(*) as total_fields, any_value(cases) as total_cases,"
        " round(avg(rate), 6) as overall_accuracy from (select workbook, model, field,"
        f" count(*) filter (where is_exact_match) / count(*) as rate from scores {KEPT} group by all)"
        " join (select workbook, count(*) as cases from grid where row_idx >= 2 group by all)"
        " using (workbook) group by workbook",
        inputs.DOCUMENT_SCORE_SQL,
    ),
)
register(
    "plan_document_workbooks",
    lambda spark, folder: rounded(
        document.evaluate_documents(document_sheets(spark, folder), CFG).fields, "accuracy_rate"
    ),
    sheet_sql(
        "select workbook, model, field, count(*) as total_cases,"
        " count(*) filter (where is_exact_match) as correct_cases,"
        " round(count(*) filter (where is_exact_match) / count(*), 6) as accuracy_rate"
        f" from scores {KEPT} group by all",
        inputs.DOCUMENT_SCORE_SQL,
    ),
)


def _fixed_values(dialect: str) -> dict[str, tuple[str, str]]:
    """Truth and prediction of all six mapped fields; the last two amounts and the ranges have plain values."""
    values = inputs.document_values(dialect)
    text = "string" if dialect == "spark" else "varchar"
    price = "cast(floor(o_totalprice) as bigint)"
    whole = "case when o_orderkey % 3 = 0 then '全部' when o_orderkey % 3 = 1 then '單筆' end"
    return {
        "發文日期": values["發文日期"],
        "得請領_金額": values["得請領_金額"],
        "繼續性_金額": (
            f"case when o_orderkey % 4 = 0 then null else cast({price} % 1000 as {text}) end",
            f"case when o_orderkey % 6 = 0 then null else cast({price} % 1000 + o_orderkey % 2 as {text}) end",
        ),
        "解約金_金額": (
            f"cast({price} % 77 as {text})", f"case when o_orderkey % 2 = 0 then cast({price} % 77 as {text}) end",
        ),
        "解約金_範圍": (whole, "case when o_orderkey % 5 = 0 then '全部' else '單筆' end"),
        "小額終老非扣押範圍": (
            "case when o_orderkey % 2 = 0 then 'Y' else 'N' end",
            "case when o_orderkey % 7 = 0 then null when o_orderkey % 2 = 0 then 'yes' else '0' end",
        ),
    }


def _fixed_pairs(spark, folder):
    """A headed table with the default prediction and truth columns of all mapped fields."""
    columns = [
        f"{value} as `{name}`"
        for field, sides in _fixed_values("spark").items()
        for value, name in zip(sides[::-1], DEFAULT_DOCUMENT_MAPPING[field], strict=True)
    ]
    df = table(spark, folder, "orders").withColumn("m", F.lit(0)).selectExpr(
        "case when o_orderkey % 29 <> 0 then concat('C', o_custkey) end as `case`",
        "o_orderkey as row_idx", *columns,
    )
    return documents.fixed_document_pairs(df, "row_idx")


def _fixed_sql() -> str:
    parts = [
        "select o_orderkey as row_idx, coalesce(case when o_orderkey % 29 <> 0"
        " then concat('C', o_custkey) end, concat('記錄', o_orderkey)) as case_id,"
        f" '{field}' as field, {truth} as correct, {predicted} as predicted"
        " from (select *, 0 as m from orders) where o_orderkey > 0"
        for field, (truth, predicted) in _fixed_values("duckdb").items()
    ]
    return f"select * from ({' union all '.join(parts)}) {KEPT}"


register(
    "rsh14_fixed_mapping",
    lambda spark, folder: _fixed_pairs(spark, folder).select(
        "row_idx", "case_id", "field", "correct", "predicted"
    ),
    _fixed_sql(),
)
register(
    "flt10_columns_by_name",
    lambda spark, folder: _fixed_pairs(spark, folder).groupBy("field").agg(
        F.count("correct").alias("truths"), F.count("predicted").alias("predictions")
    ),
    "select field, count(correct) as truths, count(predicted) as predictions from ("
    + _fixed_sql() + ") group by all",
)
register(
    "set02_document_last_column",
    lambda spark, folder: aggregate.last_wins(
        stored(_pairs(spark, folder), "document-pairs"),
        ["workbook", "model", "case_id", "field"], "row_idx", ["correct", "predicted"],
    ),
    sheet_sql(
        "select workbook, model, case_id, field, correct, predicted from (select *, row_number()"
        " over (partition by workbook, model, case_id, field order by row_idx desc) as rn from pairs)"
        " where rn = 1"
    ),
)
