"""Catalogue: sheets derived from the tables, and everything that finds its way through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofgrid.catalog.registry import register, table
from proofgrid.config import ScoringConfig
from proofgrid.operators import diagnostics, grid, layout, pairing, profile, reports
from proofgrid.operators.ordered import carry_forward, number_rows
from proofgrid.plans import certificate
from proofgrid.plans.storage import stored
from proofgrid.sources.tables import spread

# Small chunks, so that the chunked scans really work in several chunks on the test tables.
CFG = ScoringConfig(chunk_rows=100, hot_splits=4)

GRID_HEADER = [
    "編號", "受編", "障礙等級", "障礙類別", "ICD診斷", "備註", "障礙等級", "證明/手冊", "障礙類別",
    "ICD診斷",
]
PLAIN_HEADER = [
    "編號", "受編", "障礙一", "類別一", "證明一", "備註", "障礙二", "手冊", "類別二", "證明二",
]
ANSWER_HEADER = [
    "編號", "受編", "解答", "障礙", "類別", "備註", "LLM辨識", "手冊", "證明", "辨識",
]
WIDE_HEADER = [
    *GRID_HEADER[:6], "障礙等級", "證明/手冊", "障礙類別", "ICD診斷", "障礙等級", "證明/手冊",
    "障礙類別", "ICD診斷",
]

# Ten cells of a customer row as SQL; blank cells are null.
CELLS = [
    "cast(c_custkey as {text})",
    "c_name",
    "case when c_custkey % 3 = 0 then '輕度' when c_custkey % 3 = 1 then '中度' end",
    "concat('第', c_custkey % 7, '類')",
    "case when c_custkey % 17 <> 0 then concat('【換', c_nationkey, '】') end",
    "case when c_custkey % 4 = 0 then '' when c_custkey % 4 = 1 then '需定期複檢' end",
    "case when c_custkey % 5 <> 0 then '輕度' else '重度' end",
    "'身心障礙證明'",
    "case when c_custkey % 13 <> 0 then concat('第', c_custkey % 9, '類') end",
    "concat('【第', c_nationkey, '】')",
]
# Values without any field mark, for the content check.
BARE = ["c_mktsegment" if i in (4, 9) else c for i, c in enumerate(CELLS)]
BLOCK = 1_000_000_000


def _literal(values: list[str | None]) -> str:
    return ", ".join("null" if v is None else f"'{v}'" for v in values)


class Dialect:
    def __init__(self, name: str) -> None:
        self.spark = name == "spark"
        self.text = "string" if self.spark else "varchar"

    def array(self, items: str) -> str:
        if self.spark:
            return f"cast(array({items}) as array<string>)"
        return f"cast([{items}] as varchar[])"

    def cells(self, cells: list[str]) -> str:
        return self.array(", ".join(c.format(text=self.text) for c in cells))


# The nations that occur in customer; one workbook each.
NATIONS = "(select distinct c_nationkey from customer)"
HEAD, DATA = NATIONS, "customer"


def _sheet(d: Dialect, prefix: str, rows: list[tuple[str, str, str, str]]) -> str:
    """All ``(source, condition, row number, values)`` rows of one kind of sheet.

    Spark makes the rows of a source in one pass over it; the SQL side makes one part per row kind.
    """
    book = f"concat('{prefix}_', c_nationkey) as workbook"
    if not d.spark:
        return " union all ".join(
            f"select {book}, cast({number} as bigint) as row_idx, {values} as vals"
            f" from {source} where {condition}"
            for source, condition, number, values in rows
        )
    parts = []
    for wanted in (HEAD, DATA):
        made = ", ".join(
            f"case when {condition} then named_struct('row_idx', cast({number} as bigint),"
            f" 'values', {values}) end"
            for source, condition, number, values in rows
            if source == wanted
        )
        if made:
            parts.append(f"select {book}, inline(array_compact(array({made}))) from {wanted}")
    return " union all ".join(parts)


def vertical_sheet(d: Dialect) -> str:
    """Stacked blocks. Some sheets have a note above the header, a repeated model or no header."""
    rows = []
    for block, name in enumerate(["gemma 3 27b qat", "ChatGPT 4.1", "gemma 3 27b qat"]):
        only = "c_nationkey % 4 = 0" if block == 2 else "true"
        half = "c_custkey % 2 = 0" if block == 2 else "true"
        start = block * BLOCK
        rows += [
            (HEAD, only, str(start), d.array(_literal([None, name, *[None] * 8]))),
            (HEAD, f"{only} and c_nationkey % 5 = 0", str(start + 1), d.array(_literal(["note"]))),
            (HEAD, f"{only} and c_nationkey % 6 <> 1", str(start + 2),
             d.array(_literal(GRID_HEADER))),
            (DATA, f"{only} and {half}", f"{start + 3} + c_custkey * 2", d.cells(CELLS)),
        ]
    return _sheet(d, "v", rows)


def horizontal_sheet(d: Dialect) -> str:
    """Two models side by side; every third sheet names the same model twice."""
    twelve = CELLS + [CELLS[6], CELLS[7], CELLS[8], "'【換1】'"]
    top = [*[None] * 6, "claude-3", *[None] * 3, "gemini 2.5 pro", *[None] * 3]
    same = [*[None] * 6, "claude-3", *[None] * 3, "claude-3", *[None] * 3]
    rows = [
        (HEAD, "c_nationkey % 3 <> 0", "0", d.array(_literal(top))),
        (HEAD, "c_nationkey % 3 = 0", "0", d.array(_literal(same))),
        (HEAD, "true", "3", d.array(_literal(WIDE_HEADER))),
        (DATA, "c_custkey % 3 <> 0", "4 + c_custkey", d.cells(twelve)),
        (DATA, "c_custkey % 3 = 0", "4 + c_custkey", d.cells(twelve[:11])),
    ]
    return _sheet(d, "h", rows)


def single_sheet(d: Dialect, prefix: str, header: list[str], cells: list[str]) -> str:
    """A title row, a header row, then data."""
    rows = [
        (HEAD, "true", "0", d.array(_literal(["結果"]))),
        (HEAD, "c_nationkey % 2 = 0", "1", d.array(_literal(["Gemma3 結果", None]))),
        (HEAD, "true", "2", d.array(_literal(header))),
        (DATA, "true", "3 + c_custkey", d.cells(cells)),
    ]
    return _sheet(d, prefix, rows)


def bad_sheet(d: Dialect) -> str:
    """No header words at all."""
    rows = [(DATA, "true", "c_custkey", d.array("c_name, c_mktsegment"))]
    return _sheet(d, "x", rows)


def sheet_sql(kind: str, dialect: str) -> str:
    d = Dialect(dialect)
    return {
        "vertical": lambda: vertical_sheet(d),
        "horizontal": lambda: horizontal_sheet(d),
        "single": lambda: single_sheet(d, "s", GRID_HEADER, CELLS),
        "plain": lambda: single_sheet(d, "p", PLAIN_HEADER, CELLS),
        "bare": lambda: single_sheet(d, "b", PLAIN_HEADER, BARE),
        "answer": lambda: single_sheet(d, "a", ANSWER_HEADER, BARE),
        "bad": lambda: bad_sheet(d),
    }[kind]()


ALL_KINDS = ("vertical", "horizontal", "single", "plain", "bare", "answer", "bad")


def sheets(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    customer = spread(
        table(spark, folder, "customer").select(
            "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
        )
    )
    text = " union all ".join(sheet_sql(k, "spark") for k in kinds)
    return spark.sql(
        text.replace("from customer", "from {customer}"),
        customer=customer,
    )


def kept_sheets(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """Sheet rows as a reader leaves them: written once, then read."""
    return stored(sheets(spark, folder, *kinds), "sheets")


def kept_profile(rows: DataFrame) -> DataFrame:
    return stored(profile.workbook_profile(rows), "profile")


def grid_cte(*kinds: str) -> str:
    text = " union all ".join(sheet_sql(k, "duckdb") for k in kinds)
    return f"grid as materialized ({text})"


MODEL_RE = "gemini|gemma|chatgpt|claude|gpt|llama|palm|bard"
WORDS_RE = "編號|受編|障礙|類別|ICD|備註|證明|手冊|解答|LLM|辨識"
SHORT_RE = "編號|受編|障礙|類別|ICD|備註|證明|手冊"

CELL_CTE = """cells as materialized (
  select workbook, row_idx, i - 1 as col_idx, value
  from (select workbook, row_idx, unnest(vals) as value, generate_subscripts(vals, 1) as i from grid)
  where value is not null)"""


def joined(values: str) -> Column:
    return F.array_join(values, "|", "~")


JOINED_SQL = "array_to_string(list_transform({0}, lambda x: coalesce(x, '~')), '|')"

# --- scans ---------------------------------------------------------------------------------------

register(
    "src01_grid_cells",
    lambda spark, folder: grid.rows_to_cells(sheets(spark, folder, "horizontal")).withColumn(
        "col_idx", F.col("col_idx").cast("bigint")
    ),
    f"with {grid_cte('horizontal')}, {CELL_CTE} select * from cells",
)
register(
    "src01_cells_to_rows",
    lambda spark, folder: grid.cells_to_rows(
        grid.rows_to_cells(sheets(spark, folder, "single"))
    ).select("workbook", "row_idx", joined("values").alias("cells")),
    f"with {grid_cte('single')}, {CELL_CTE}, wide as materialized (select workbook, row_idx,"
    " max(col_idx) as last from cells group by all) select g.workbook, g.row_idx, "
    + JOINED_SQL.format("vals[1:last + 1]")
    + " as cells from grid g join wide using (workbook, row_idx)",
)
register(
    "src04_model_census",
    lambda spark, folder: profile.census(
        profile.workbook_profile(sheets(spark, folder, *ALL_KINDS))
    ),
    f"with {grid_cte(*ALL_KINDS)}, {CELL_CTE} select g.workbook,"
    " count(c.value)::bigint as model_cells, count(c.value) > 1 as is_multi_model"
    " from (select distinct workbook from grid) g left join"
    f" (select * from cells where regexp_matches(lower(value), '{MODEL_RE}')) c"
    " on c.workbook = g.workbook group by g.workbook",
)
HEADER_CTE = f"""scored as materialized (
  select workbook, row_idx,
    count(*) filter (where regexp_matches(value, '{WORDS_RE}')) as n,
    bool_or(contains(value, '編號')) and bool_or(contains(value, '受編')) as ids
  from cells where row_idx < 5 group by all),
heads as materialized (
  select workbook, min(row_idx) as header_row from scored
  where (ids and n >= 4) or n >= 6 group by all)"""
SINGLE_KINDS = ("single", "plain", "bare", "answer", "bad")
register(
    "src05_header_row",
    lambda spark, folder: profile.headers(
        profile.workbook_profile(sheets(spark, folder, *SINGLE_KINDS))
    ).select("workbook", "header_row", joined("header").alias("header")),
    f"with {grid_cte(*SINGLE_KINDS)}, {CELL_CTE}, {HEADER_CTE} select h.workbook, header_row, "
    + JOINED_SQL.format("vals")
    + " as header from heads h join grid g on g.workbook = h.workbook and g.row_idx = header_row",
)
register(
    "src07_structure_profile",
    lambda spark, folder: profile.structure(
        profile.workbook_profile(sheets(spark, folder, "single"))
    ),
    f"with {grid_cte('single')} select workbook, max(row_idx) as n_rows, max(len(vals)) as n_columns"
    " from grid group by all",
)
register(
    "lim03_head_rows",
    lambda spark, folder: grid.preview(sheets(spark, folder, "single"), 5).select(
        "workbook", "row_idx", joined("values").alias("cells")
    ),
    f"with {grid_cte('single')} select workbook, row_idx, " + JOINED_SQL.format("vals")
    + " as cells from grid where row_idx between 1 and 5",
)
register(
    "flt03_drop_blank_rows",
    lambda spark, folder: grid.drop_blank_rows(
        sheets(spark, folder, "single").withColumn(
            "values", F.slice("values", 6, 1)
        )
    ).select("workbook", "row_idx"),
    f"with {grid_cte('single')} select workbook, row_idx from grid where trim(vals[6]) <> ''",
)

# --- model blocks --------------------------------------------------------------------------------

VERTICAL_CTE = f"""texts as materialized (
  select workbook, row_idx, list_transform(vals, lambda v: trim(coalesce(v, ''))) as vals from grid),
flags as materialized (
  select *, list_filter(vals, lambda v: regexp_matches(lower(v), '{MODEL_RE}'))[1] as model_here,
    len(list_filter(vals, lambda v: regexp_matches(v, '{WORDS_RE}'))) >= 3 as header_like
  from texts),
running as materialized (
  select *, max(case when model_here is not null then row_idx end)
      over (partition by workbook order by row_idx) as block_row
  from flags),
members as materialized (
  select r.*, m.model_here as model from running r join flags m
    on m.workbook = r.workbook and m.row_idx = r.block_row
  where r.model_here is null and len(list_filter(r.vals, lambda v: v <> '')) > 0),
last_rows as materialized (
  select workbook, max(row_idx) as last_row from flags where model_here is not null group by all),
blocks as materialized (
  select m.workbook, m.block_row, any_value(model) as model, min(m.row_idx) as first_row,
    bool_or(header_like) and (count(*) > 1 or m.block_row < any_value(last_row)) as used,
    count(*) as n
  from members m join last_rows l on l.workbook = m.workbook group by m.workbook, m.block_row),
winners as materialized (
  select * from (select *, row_number() over (partition by workbook, model order by block_row desc)
    as rn from blocks where n > used::int) where rn = 1)"""
VDATA_SQL = (
    "select m.workbook, m.model, m.row_idx, " + JOINED_SQL.format("vals") + " as cells"
    " from members m join winners w on w.workbook = m.workbook and w.block_row = m.block_row"
    " where not (used and m.row_idx = first_row)"
)
register(
    "rsh01_vertical_split",
    lambda spark, folder: layout.split_vertically(kept_sheets(spark, folder, "vertical"), CFG).data
    .select("workbook", "model", "row_idx", joined("values").alias("cells")),
    f"with {grid_cte('vertical')}, {VERTICAL_CTE} {VDATA_SQL}",
)
register(
    "rsh01_vertical_headers",
    lambda spark, folder: layout.split_vertically(kept_sheets(spark, folder, "vertical"), CFG).headers
    .select("workbook", "model", joined("header").alias("header")),
    f"with {grid_cte('vertical')}, {VERTICAL_CTE} select w.workbook, w.model, case when used then "
    + JOINED_SQL.format("list_resize(vals, 10, '')") + " else '0|1|2|3|4|5|6|7|8|9' end as header from winners w"
    " join members m on m.workbook = w.workbook and m.row_idx = w.first_row",
)
register(
    "win01_running_block",
    lambda spark, folder: carry_forward(
        sheets(spark, folder, "vertical").withColumn(
            "_model", grid.model_cell_of(F.col("values"))
        ),
        ["workbook"], "row_idx", F.when(F.col("_model").isNotNull(), F.col("row_idx")),
        "block_row", CFG.chunk_rows,
    ).select("workbook", "row_idx", "block_row"),
    f"with {grid_cte('vertical')}, {VERTICAL_CTE} select workbook, row_idx, block_row from running",
)
register(
    "win01_row_numbers",
    lambda spark, folder: number_rows(
        sheets(spark, folder, "vertical").drop("values"), ["workbook"], "row_idx", "n",
        CFG.chunk_rows,
    ),
    f"with {grid_cte('vertical')} select workbook, row_idx,"
    " row_number() over (partition by workbook order by row_idx) - 1 as n from grid",
)
SPAN_CTE = f"""named as materialized (
  select workbook, col_idx, max_by(trim(value), row_idx) as model from cells
  where row_idx < 5 and regexp_matches(lower(value), '{MODEL_RE}') group by all),
spans as materialized (
  select * from (
    select workbook, model, col_idx as start_col,
      coalesce(lead(col_idx) over (partition by workbook order by col_idx),
        (select max(len(vals)) from grid g where g.workbook = named.workbook)) - 1 as end_col,
      count(*) over (partition by workbook) as n from named) where n > 1),
span_heads as materialized (
  select s.workbook, s.model, s.start_col, s.end_col, min(c.row_idx) as header_row from (
    select c.workbook, c.row_idx, s.start_col, s.model, s.end_col, count(*) as n
    from cells c join spans s on s.workbook = c.workbook and c.col_idx between start_col and end_col
    where c.row_idx < 6 and regexp_matches(value, '{SHORT_RE}') group by all having count(*) >= 2) c
  join spans s on s.workbook = c.workbook and s.start_col = c.start_col group by all)"""
register(
    "win03_column_spans",
    lambda spark, folder: layout.horizontal_spans(
        profile.workbook_profile(sheets(spark, folder, "horizontal"))
    ).select(
        "workbook", "model", F.col("start_col").cast("bigint").alias("start_col"),
        F.col("end_col").cast("bigint").alias("end_col"),
    ),
    f"with {grid_cte('horizontal')}, {CELL_CTE}, {SPAN_CTE}"
    " select workbook, model, start_col, end_col from spans",
)
HDATA_CTE = """padded as materialized (
  select workbook, row_idx, list_resize(vals, 14) as vals from grid),
span_data as materialized (
  select p.workbook, s.model, s.start_col, p.row_idx,
    list_concat(vals[1:least(6, start_col)], vals[start_col + 1:end_col + 1]) as vals
  from padded p join span_heads s on s.workbook = p.workbook and p.row_idx > s.header_row
  where len(list_filter(list_concat(vals[1:least(6, start_col)], vals[start_col + 1:end_col + 1]),
    lambda v: trim(v) <> '')) > 0),
last_spans as materialized (select workbook, model, max(start_col) as start_col from span_data group by all)"""
register(
    "rsh02_horizontal_split",
    lambda spark, folder: layout.split_horizontally(kept_sheets(spark, folder, "horizontal"), CFG).data
    .select("workbook", "model", "row_idx", joined("values").alias("cells")),
    f"with {grid_cte('horizontal')}, {CELL_CTE}, {SPAN_CTE}, {HDATA_CTE}"
    " select d.workbook, d.model, d.row_idx, " + JOINED_SQL.format("vals")
    + " as cells from span_data d join last_spans using (workbook, model, start_col)",
)
register(
    "rsh02_horizontal_headers",
    lambda spark, folder: layout.split_horizontally(
        kept_sheets(spark, folder, "horizontal"), CFG
    ).headers.select("workbook", "model", joined("header").alias("header")),
    f"with {grid_cte('horizontal')}, {CELL_CTE}, {SPAN_CTE}, {HDATA_CTE}"
    " select s.workbook, s.model, "
    + JOINED_SQL.format(
        "list_concat(vals[1:least(6, s.start_col)], vals[s.start_col + 1:end_col + 1])"
    )
    + " as header from span_heads s join last_spans l using (workbook, model, start_col)"
    " join padded p on p.workbook = s.workbook and p.row_idx = s.header_row",
)
register(
    "jn04_column_ranges",
    lambda spark, folder: layout.horizontal_headers(
        profile.workbook_profile(sheets(spark, folder, "horizontal"))
    ).select(
        "workbook", "model", F.col("start_col").cast("bigint").alias("start_col"), "header_row"
    ),
    f"with {grid_cte('horizontal')}, {CELL_CTE}, {SPAN_CTE}"
    " select workbook, model, start_col, header_row from span_heads",
)


def _layouts(spark, folder):
    return certificate.find_blocks(kept_sheets(spark, folder, *ALL_KINDS), CFG)[0]


register(
    "rsh03_layout_choice",
    _layouts,
    f"with {grid_cte(*ALL_KINDS)}, {CELL_CTE}, {VERTICAL_CTE}, {SPAN_CTE}, {HDATA_CTE}"
    " select g.workbook, case when coalesce(m.n, 0) <= 1 then 'single'"
    " when coalesce(v.n, 0) > 1 then 'vertical' when coalesce(h.n, 0) > 1 then 'horizontal'"
    " else 'raw' end as layout from (select distinct workbook from grid) g"
    " left join (select workbook, count(*) as n from cells"
    f" where regexp_matches(lower(value), '{MODEL_RE}') group by all) m on m.workbook = g.workbook"
    " left join (select workbook, count(*) as n from winners group by all) v"
    " on v.workbook = g.workbook"
    " left join (select workbook, count(*) as n from last_spans group by all) h"
    " on h.workbook = g.workbook",
)

# --- column mapping ------------------------------------------------------------------------------


def _single_headers(spark, folder, *kinds):
    return grid.header_rows(sheets(spark, folder, *kinds))


def _mapping_rows(df: DataFrame, mapping) -> DataFrame:
    return df.select("workbook", F.inline(mapping)).select(
        "workbook", "field", F.col("truth_col").cast("bigint").alias("truth_col"),
        F.col("pred_col").cast("bigint").alias("pred_col"),
    )


HEAD_CELLS_CTE = """head_cells as materialized (
  select c.workbook, c.col_idx, c.value from cells c join heads h
    on h.workbook = c.workbook and h.header_row = c.row_idx)"""
FIELD_RULES = """(values ('障礙等級', '障礙等級'), ('障礙類別', '障礙類別'), ('ICD診斷', 'ICD|診斷'))
  r(field, pattern)"""
BY_NAME_CTE = f"""hits as materialized (
  select workbook, field, col_idx,
    row_number() over (partition by workbook, field order by col_idx) as rn
  from head_cells join {FIELD_RULES} on regexp_matches(trim(value), pattern)),
by_name as materialized (
  select workbook, field, max(case when rn = 1 then col_idx end) as truth_col,
    max(case when rn = 2 then col_idx end) as pred_col from hits group by all having count(*) >= 2)"""
PAIRING_CTES = f"{CELL_CTE}, {HEADER_CTE}, {HEAD_CELLS_CTE}, {BY_NAME_CTE}"
register(
    "rsh04_pairs_by_name",
    lambda spark, folder: _mapping_rows(
        _single_headers(spark, folder, "single", "plain"), layout.map_by_name(F.col("header"))
    ),
    f"with {grid_cte('single', 'plain')}, {PAIRING_CTES}"
    " select workbook, field, truth_col, pred_col from by_name",
)
POSITIONS_SQL = """(values ('障礙等級', 2, 6), ('障礙類別', 3, 8), ('ICD診斷', 4, 9))
  p(field, truth_col, pred_col)"""
MARKS_SQL = """(values ('障礙等級', '輕度|中度|重度|極重度'), ('障礙類別', '類|其他'),
  ('ICD診斷', '【|】|\\[|\\]|換|第')) k(field, marks)"""
CONTENT_CTE = f"""data_cells as materialized (
  select c.* from cells c join heads h on h.workbook = c.workbook and c.row_idx > h.header_row),
sides as materialized (
  select d.workbook, p.field, p.truth_col::bigint as truth_col, p.pred_col::bigint as pred_col,
    bool_or(regexp_matches(value, marks)) as fits,
    count(*) filter (where col_idx = truth_col) as n_l,
    count(*) filter (where col_idx = pred_col) as n_r
  from data_cells d join {POSITIONS_SQL} on d.col_idx in (p.truth_col, p.pred_col)
    join {MARKS_SQL} on k.field = p.field group by all),
fitting as materialized (select * from sides where fits and n_l > 0 and n_r > 0)"""


def _single_map(spark, folder, *kinds, **columns) -> tuple[DataFrame, DataFrame]:
    """Sheet rows and the stored pair map of their sheets; ``columns`` replace columns of the headers."""
    rows = kept_sheets(spark, folder, *kinds)
    facts = kept_profile(rows)
    heads = profile.headers(facts).withColumns({"model": F.lit("m"), **columns})
    return rows, stored(layout.map_singles(heads, facts), "pair-map")


def _fitting(spark, folder, *kinds) -> DataFrame:
    found = profile.with_header(profile.workbook_profile(sheets(spark, folder, *kinds)))
    return found.select(
        "workbook",
        F.explode(profile.fitting_fields(profile.data_flags(F.col("header_row")))).alias("field"),
    )


register(
    "rsh05_pairs_by_position",
    lambda spark, folder: _mapping_rows(
        _single_map(spark, folder, "plain", "bare")[1], F.col("mapping")
    ),
    f"with {grid_cte('plain', 'bare')}, {PAIRING_CTES}, {CONTENT_CTE}"
    " select workbook, field, truth_col, pred_col from fitting",
)
register(
    "rsh06_answer_sheets",
    lambda spark, folder: _mapping_rows(
        _single_map(spark, folder, "answer", "single")[1], F.col("mapping")
    ),
    f"with {grid_cte('answer', 'single')}, {PAIRING_CTES}"
    " select workbook, field, truth_col, pred_col from by_name union all"
    " select h.workbook, p.field, p.truth_col::bigint, p.pred_col::bigint from heads h,"
    f" {POSITIONS_SQL} where h.workbook not in (select workbook from by_name)",
)
register(
    "rsh06_copied_headers",
    lambda spark, folder: _mapping_rows(
        _single_headers(spark, folder, "single").withColumn(
            "header", grid.distinct_headers(F.col("header"))
        ),
        layout.map_answer_sheet(F.col("header")),
    ),
    f"with {grid_cte('single')}, {PAIRING_CTES}, copies as materialized (select *, row_number() over"
    " (partition by workbook, value order by col_idx) as copy from head_cells)"
    " select a.workbook, a.value as field, a.col_idx as truth_col, b.col_idx as pred_col"
    " from copies a join copies b on b.workbook = a.workbook and b.value = a.value"
    " where a.copy = 1 and b.copy = 2 and a.value in ('障礙等級', '障礙類別', 'ICD診斷')",
)
register(
    "rsh07_content_check",
    lambda spark, folder: _fitting(spark, folder, "plain", "bare"),
    f"with {grid_cte('plain', 'bare')}, {PAIRING_CTES}, {CONTENT_CTE}"
    " select workbook, field from fitting",
)
REQUIRED = [
    "正面_障礙等級", "反面_障礙等級", "正面_障礙類別", "反面_障礙類別", "正面_ICD診斷", "反面_ICD診斷",
]
MISSING_SQL = f"""missing as materialized (
  select h.workbook, r.name from heads h, (select unnest([{_literal(REQUIRED)}]) as name) r
  where not exists (select 1 from head_cells c where c.workbook = h.workbook and c.value = r.name))"""
for _name, _kind in (
    ("rsh08_required_columns", "single"), ("jn05_missing_columns", "plain"),
    ("set04_required_minus_available", "answer"),
):
    register(
        _name,
        lambda spark, folder, kind=_kind: _single_headers(spark, folder, kind).select(
            "workbook", F.explode(layout.missing_columns(F.col("header"))).alias("name")
        ),
        f"with {grid_cte(_kind)}, {PAIRING_CTES}, {MISSING_SQL} select workbook, name from missing",
    )
register(
    "rsh15_pairs_by_suffix",
    lambda spark, folder: _mapping_rows(
        _single_headers(spark, folder, "single").withColumn(
            "header", grid.distinct_headers(F.col("header"))
        ),
        pairing.map_by_suffix(F.col("header")),
    ),
    f"with {grid_cte('single')}, {PAIRING_CTES}, labelled as materialized (select workbook, col_idx,"
    " case when copy = 1 then value else concat(value, '.', copy - 1) end as label from (select *,"
    " row_number() over (partition by workbook, value order by col_idx) as copy from head_cells)),"
    f" firsts as materialized (select workbook, field, min(col_idx) as truth_col from labelled join {FIELD_RULES}"
    " on contains(label, replace(pattern, '|診斷', '')) where not regexp_matches(label, '[.][12]$')"
    " group by all) select f.workbook, f.field, truth_col, min(l.col_idx) as pred_col from firsts f"
    f" join {FIELD_RULES} on r.field = f.field join labelled l on l.workbook = f.workbook"
    " and l.col_idx > truth_col and contains(l.label, replace(pattern, '|診斷', ''))"
    " and (f.field = '障礙等級' or regexp_matches(l.label, '[.][12]$')) group by all",
)
ALIAS_ROWS = ", ".join(
    f"({t}, '{target}', {a}, '{alias}')"
    for t, (target, names) in enumerate(pairing.ALIASES.items())
    for a, alias in enumerate(names)
)
ALIAS_CTE = f"""matches as materialized (
  select workbook, t, target, col_idx,
    row_number() over (partition by workbook, t order by a, col_idx) as rn
  from head_cells join (values {ALIAS_ROWS}) al(t, target, a, alias)
    on contains(lower(value), lower(alias)) or contains(lower(alias), lower(value))),
taken as materialized (select workbook, col_idx, max(t) as t from matches where rn = 1 group by all),
kept as materialized (select k.workbook, k.col_idx, m.target from taken k join matches m
  on m.workbook = k.workbook and m.t = k.t and m.rn = 1)"""
register(
    "rsh16_pairs_by_alias",
    lambda spark, folder: _mapping_rows(
        pairing.map_by_alias(_alias_headers(spark, folder)), F.col("mapping")
    ),
    f"with {grid_cte('single')}, {CELL_CTE}, {HEADER_CTE}, head_cells as materialized (select c.workbook,"
    " c.col_idx, case when col_idx between 6 and 9 then concat('AI', replace(replace(value,"
    " 'ICD診斷', '_ICD'), '證明/手冊', '證明')) else value end as value from cells c join heads h"
    f" on h.workbook = c.workbook and h.header_row = c.row_idx), {ALIAS_CTE}"
    " select l.workbook, replace(l.target, '正面_', '') as field, l.col_idx as truth_col,"
    " r.col_idx as pred_col from kept l join kept r on r.workbook = l.workbook"
    " and replace(l.target, '正面_', '反面_') = r.target where l.target like '正面%'",
)


def _alias_headers(spark, folder):
    """The usual header with model-made names on its right half."""
    renamed = F.transform(
        "header",
        lambda h, i: F.when(
            i.between(6, 9),
            F.concat(
                F.lit("AI"), F.replace(
                    F.replace(h, F.lit("ICD診斷"), F.lit("_ICD")), F.lit("證明/手冊"), F.lit("證明")
                )
            ),
        ).otherwise(h),
    )
    return _single_headers(spark, folder, "single").withColumn("header", renamed)


PAIR_CTE = """pair_rows as materialized (
  select g.workbook, g.row_idx, b.field, coalesce(g.vals[1], 'nan') as record_id,
    coalesce(g.vals[2], 'nan') as subject_id, g.vals[truth_col + 1] as correct,
    g.vals[pred_col + 1] as predicted
  from grid g join heads h on h.workbook = g.workbook and g.row_idx > h.header_row
    join by_name b on b.workbook = g.workbook)"""


def _extracted(spark, folder):
    return layout.extract_single_pairs(*_single_map(spark, folder, "single"), CFG)


register(
    "rsh09_long_pairs",
    lambda spark, folder: _extracted(spark, folder).select(
        "workbook", "row_idx", "field", "record_id", "subject_id", "correct", "predicted"
    ),
    f"with {grid_cte('single')}, {PAIRING_CTES}, {PAIR_CTE} select * from pair_rows",
)
register(
    "rsh09_numbered_records",
    lambda spark, folder: _numbered(spark, folder),
    f"with {grid_cte('single')}, {PAIRING_CTES}, {PAIR_CTE} select workbook, row_idx, field,"
    " cast(dense_rank() over (partition by workbook order by row_idx) as varchar) as record_id"
    " from pair_rows",
)


def _numbered(spark, folder):
    """Sheets whose id columns are named otherwise: the row number is the id."""
    header = F.transform("header", lambda h: F.regexp_replace(h, "編號|受編", "no"))
    rows, pair_map = _single_map(spark, folder, "single", header=header)
    return layout.extract_single_pairs(rows, pair_map, CFG).select(
        "workbook", "row_idx", "field", "record_id"
    )


def _own_mapping(spark, folder):
    rows = kept_sheets(spark, folder, "single")
    own = profile.headers(profile.workbook_profile(rows)).select(
        "workbook", F.lit("m").alias("model"), "header_row", "header",
        pairing.pair_map_from({"證明": (5, 7), "類別": (3, 8)}).alias("mapping"),
        F.lit(0).alias("id_col"), F.lit(1).alias("subject_col"),
    )
    return layout.extract_single_pairs(rows, stored(own, "pair-map"), CFG)


register(
    "rsh23_own_mapping",
    lambda spark, folder: _own_mapping(spark, folder).select(
        "workbook", "row_idx", "field", "correct", "predicted"
    ),
    f"with {grid_cte('single')}, {CELL_CTE}, {HEADER_CTE} select g.workbook, g.row_idx, p.field,"
    " vals[p.l + 1] as correct, vals[p.r + 1] as predicted from grid g join heads h"
    " on h.workbook = g.workbook and g.row_idx > header_row,"
    " (values ('證明', 5, 7), ('類別', 3, 8)) p(field, l, r)",
)
register(
    "rsh18_renamed_columns",
    lambda spark, folder: pairing.rename_columns(
        table(spark, folder, "nation").select("n_nationkey", "n_name"),
        {"n_name": "正面_障礙等級"},
    ),
    'select n_nationkey, n_name as "正面_障礙等級" from nation',
)
register(
    "win05_field_occurrence",
    lambda spark, folder: _single_headers(spark, folder, "single").select(
        "workbook", F.posexplode(grid.distinct_headers(F.col("header"))).alias("col_idx", "label")
    ).withColumn("col_idx", F.col("col_idx").cast("bigint")),
    f"with {grid_cte('single')}, {PAIRING_CTES} select workbook, col_idx,"
    " case when copy = 1 then value else concat(value, '.', copy - 1) end as label from (select *,"
    " row_number() over (partition by workbook, value order by col_idx) as copy from head_cells)",
)

# --- diagnostics ---------------------------------------------------------------------------------


def _diagnostics(spark, folder):
    layouts, blocks = certificate.find_blocks(
        stored(sheets(spark, folder, "bad", "single"), "sheets"), CFG
    )
    return diagnostics.without_header(layouts, blocks.headers)


register(
    "flt08_failed_workbooks",
    lambda spark, folder: _diagnostics(spark, folder).select("workbook", "stage", "error_type"),
    f"with {grid_cte('bad', 'single')}, {CELL_CTE}, {HEADER_CTE} select distinct workbook,"
    " 'read' as stage, 'FileProcessingError' as error_type from grid"
    " where workbook not in (select workbook from heads)",
)
register(
    "rpt16_failure_rows",
    lambda spark, folder: reports.failure_rows(
        _diagnostics(spark, folder)
    ),
    f"with {grid_cte('bad', 'single')}, {CELL_CTE}, {HEADER_CTE} select distinct workbook,"
    " '' as model, 'failed' as status, '無法讀取Excel檔案' as reason from grid"
    " where workbook not in (select workbook from heads)",
)

# --- whole certificate job -----------------------------------------------------------------------

PLAN_KINDS = ("vertical", "horizontal", "single")
PLAN_CTE = """block_rows as materialized (
  select m.workbook, m.model, m.vals from members m join winners w
    on w.workbook = m.workbook and w.block_row = m.block_row
    where m.workbook like 'v%' and not (used and m.row_idx = first_row)
  union all select d.workbook, d.model, d.vals from span_data d
    join last_spans using (workbook, model, start_col) where d.workbook like 'h%'
    and d.workbook in (select workbook from last_spans group by all having count(*) > 1)
  union all select workbook, 'Claude-3', vals from grid where workbook like 'h%'
    and workbook in (select workbook from last_spans group by all having count(*) = 1)
  union all select g.workbook, case when cast(substr(g.workbook, 3) as int) % 2 = 0 then 'gemma3'
    else '未知模型' end, g.vals from grid g join heads h
    on h.workbook = g.workbook and g.row_idx > h.header_row where g.workbook like 's%'),
sides as materialized (
  select workbook, model, p.field, coalesce(vals[l + 1], '') as l, coalesce(vals[r + 1], '') as r
  from block_rows, (values ('障礙等級', 2, 6), ('障礙類別', 3, 8), ('ICD診斷', 4, 9)) p(field, l, r))"""
register(
    "plan_certificate_workbooks",
    lambda spark, folder: certificate.evaluate_workbooks(
        stored(sheets(spark, folder, *PLAN_KINDS), "sheets"), CFG, keep_scores=True
    ).fields.select("workbook", "model", "field", "exact_matches", "total_records"),
    f"with {grid_cte(*PLAN_KINDS)}, {CELL_CTE}, {HEADER_CTE}, {VERTICAL_CTE}, {SPAN_CTE},"
    f" {HDATA_CTE}, {PLAN_CTE} select workbook, model, field,"
    " count(*) filter (where l = r) as exact_matches, count(*) as total_records from sides"
    " group by all",
)
