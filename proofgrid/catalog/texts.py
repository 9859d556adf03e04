"""Catalogue: model names, value hygiene, scalar building blocks, files, sinks and streams."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from proofgrid.catalog import inputs
from proofgrid.catalog.certificates import RECORDS_SQL, cert_sql, lines_sql, rounded
from proofgrid.catalog.inputs import document_sql
from proofgrid.catalog.registry import register, table
from proofgrid.catalog.sheets import CELL_CTE, CFG, grid_cte, sheets
from proofgrid.catalog.typed_documents import BAND_SQL, CASES_SQL, _cases
from proofgrid.functions import hygiene, modelnames, textnorm
from proofgrid.operators import grid, reports
from proofgrid.plans.certificate import evaluate_pairs
from proofgrid.plans.storage import new_path
from proofgrid.sources import sinks, tables, workbooks
from proofgrid.streaming import incremental

# --- model names ---------------------------------------------------------------------------------


def _rules_sql(value: str, rules, otherwise: str) -> str:
    cases = " ".join(f"when contains(lower({value}), '{p}') then '{n}'" for p, n in rules)
    return f"case {cases} else {otherwise} end"


# Names made from customer rows: every rule of the tables occurs, with other text around it.
N_TEXT, N_FILE = len(modelnames.TEXT_RULES), len(modelnames.FILE_RULES)


def _made_name(key: str, rules, spark: bool) -> str:
    items = ", ".join(f"'{p}'" for p, _ in rules)
    pick = f"element_at(array({items}), cast({key} % {len(rules) + 2} + 1 as int))" if spark else \
        f"([{items}])[{key} % {len(rules) + 2} + 1]"
    safe = f"case when {key} % {len(rules) + 2} < {len(rules)} then {pick} else 'other' end"
    return f"concat('A ', case when {key} % 2 = 0 then upper({safe}) else {safe} end, ' ', c_name)"


register(
    "rsh19_model_from_text",
    lambda spark, folder: table(spark, folder, "customer")
    .selectExpr("c_custkey", _made_name("c_custkey", modelnames.TEXT_RULES, True) + " as made")
    .select("c_custkey", modelnames.from_text("made").alias("model")),
    "select c_custkey, " + _rules_sql("made", modelnames.TEXT_RULES, "''")
    + " as model from (select *, " + _made_name("c_custkey", modelnames.TEXT_RULES, False)
    + " as made from customer)",
)
FILE_FORM = (
    "concat('in/', case c_custkey % 3 when 0 then '[' when 1 then '[x] ' else '' end, {0},"
    " case c_custkey % 3 when 0 then '] b' else '' end, '.xlsx')"
)
register(
    "rsh20_model_from_file_name",
    lambda spark, folder: table(spark, folder, "customer")
    .selectExpr(
        "c_custkey",
        FILE_FORM.format(_made_name("c_custkey", modelnames.FILE_RULES, True)) + " as made",
    )
    .select("c_custkey", modelnames.from_file_name("made").alias("model")),
    "select c_custkey, " + _rules_sql(
        "made", modelnames.FILE_RULES,
        "coalesce(nullif(trim(regexp_extract(substr(made, 4), '\\[(.*?)\\]', 1)), ''),"
        " trim(regexp_replace(substr(made, 4), '[.][^.]*$', '')))",
    )
    + " as model from (select *, "
    + FILE_FORM.format(_made_name("c_custkey", modelnames.FILE_RULES, False))
    + " as made from customer)",
)
NAME_SQL = _rules_sql("value", modelnames.TEXT_RULES, "''")
register(
    "rsh21_model_in_top_rows",
    lambda spark, folder: grid.first_model_name(
        sheets(spark, folder, "vertical", "horizontal", "single")
    ),
    f"with {grid_cte('vertical', 'horizontal', 'single')}, {CELL_CTE} select g.workbook,"
    " coalesce(n.name, '未知模型') as model_name from (select distinct workbook from grid) g left join"
    f" (select workbook, arg_min(name, row_idx * 100 + col_idx) as name from (select *, {NAME_SQL}"
    " as name from cells where row_idx < 5) where name <> '' group by all) n"
    " on n.workbook = g.workbook",
)


def _naming_rows(spark, folder):
    """Single sheets whose remark column names models."""
    note = F.when(F.pmod(F.col("row_idx"), F.lit(3)) == 0, "gpt-4").when(
        F.pmod(F.col("row_idx"), F.lit(3)) == 1, "by llama"
    )
    return sheets(spark, folder, "plain").withColumn(
        "values",
        F.transform(
            "values",
            lambda v, i: F.when((i == 5) & (F.col("row_idx") > 2), F.coalesce(note, v)).otherwise(v),
        ),
    )


COMMON_CTE = f"""notes as materialized (
  select workbook, row_idx, col_idx, case when col_idx = 5 and row_idx > 2 and row_idx % 3 = 0
    then 'gpt-4' when col_idx = 5 and row_idx > 2 and row_idx % 3 = 1 then 'by llama'
    else value end as value
  from (select workbook, row_idx, i - 1 as col_idx, vals[i] as value
    from (select *, unnest(range(1, len(vals) + 1)) as i from grid))),
names as materialized (select *, {NAME_SQL} as name from notes where value is not null),
common as materialized (
  select workbook, name from (select workbook, name, row_number() over (partition by workbook
      order by count(*) desc, min(col_idx * 1000000000 + row_idx)) as rn
    from names where name <> '' and row_idx > 2 group by workbook, name) where rn = 1),
tops as materialized (
  select workbook, arg_min(name, row_idx * 100 + col_idx) as name from names
  where name <> '' and row_idx < 5 group by all)"""
for _name in ("rsh22_dominant_model", "agg18_most_common", "srt02_most_common_first"):
    register(
        _name,
        (
            lambda spark, folder: grid.dominant_model_name(
                _naming_rows(spark, folder), grid.header_rows(_naming_rows(spark, folder)), CFG
            )
        )
        if _name.startswith("rsh22")
        else lambda spark, folder: grid.most_common(
            grid.named_cells(
                _naming_rows(spark, folder), grid.header_rows(_naming_rows(spark, folder)), CFG
            ),
            "name", "model_name",
        ),
        f"with {grid_cte('plain')}, {COMMON_CTE} "
        + (
            "select g.workbook, coalesce(t.name, c.name, '未知模型') as model_name"
            " from (select distinct workbook from grid) g"
            " left join tops t on t.workbook = g.workbook left join common c on c.workbook = g.workbook"
            if _name.startswith("rsh22")
            else "select workbook, name as model_name from common"
        ),
    )

# --- value hygiene -------------------------------------------------------------------------------

CLEAN_SQL = (
    "case when {0} is null or {0} in ('', 'nan') then '' when length({1}) > 32767"
    " then concat(substr({1}, 1, 32760), '...') else {1} end"
)
CONTROL_SQL = "regexp_replace({0}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
register(
    "snk04_clean_value",
    lambda spark, folder: table(spark, folder, "documents").select(
        "doc_id", F.md5(hygiene.clean_value("text")).alias("digest"),
        F.char_length(hygiene.clean_value("text")).cast("bigint").alias("n"),
    ),
    f"select doc_id, md5({CLEAN_SQL.format('text', CONTROL_SQL.format('text'))}) as digest,"
    f" length({CLEAN_SQL.format('text', CONTROL_SQL.format('text'))}) as n from documents",
)
register(
    "snk05_clean_frame",
    lambda spark, folder: hygiene.clean_frame(
        inputs.certificates(spark, folder).select(
            "model", "row_idx", F.col("反面_障礙類別").alias("category")
        )
    ),
    cert_sql(
        "select model, cast(row_idx as varchar) as row_idx, coalesce(predicted, '') as category"
        " from pairs where field_order = 1",
        scored=False,
    ),
)
SAFE_SQL = "regexp_replace(url, '[\\\\/*?:\\[\\]]', '_', 'g')"
register(
    "snk06_sheet_names",
    lambda spark, folder: table(spark, folder, "pages").select(
        "page_id", hygiene.sheet_name("url").alias("name"),
        hygiene.document_sheet_name("url").alias("document_name"),
    ),
    f"select page_id, case when length({SAFE_SQL}) > 31 then concat(substr({SAFE_SQL}, 1, 28), '...')"
    f" else {SAFE_SQL} end as name,"
    " regexp_replace(substr(url, 1, 31), '[^A-Za-z0-9 _-]', '', 'g') as document_name from pages",
)
STEM_SQL = "case when contains(url, '.') then regexp_replace(url, '[.][^.]*$', '') else url end"
register(
    "snk07_output_names",
    lambda spark, folder: table(spark, folder, "pages").select(
        "page_id", hygiene.output_name("url", F.lit("run1")).alias("name"),
        hygiene.document_output_name("url", F.lit("run1")).alias("document_name"),
    ),
    "select page_id, concat(replace(replace(replace(replace(" + STEM_SQL
    + ", '[', ''), ']', ''), '/', '_'), chr(92), '_'), '_accuracy_evaluation_run1.xlsx') as name,"
    f" concat({STEM_SQL}, '_外來函文評估結果_run1.xlsx') as document_name from pages",
)
register(
    "snk08_value_set",
    lambda spark, folder: reports.individual_lines(inputs.certificate_scores(spark, folder))
    .groupBy("model", "value_set_id").agg(F.count(F.lit(1)).alias("n")),
    cert_sql(
        "select model, '' as value_set_id, count(*) as n from lines group by model",
        RECORDS_SQL, lines_sql("overall"),
    ),
)

# --- scalar building blocks ----------------------------------------------------------------------

PART = "part"
register(
    "scl01_text_functions",
    lambda spark, folder: table(spark, folder, PART).select(
        "p_partkey",
        textnorm.strip(F.concat(F.lit(" \t"), "p_name", F.lit("\n "))).alias("scl01_trim"),
        F.regexp_replace("p_brand", "[#0-9]+", "-").alias("scl02_replace"),
        F.rlike("p_name", F.lit("^(red|blue)")).alias("scl03_match"),
        F.lower("p_type").alias("scl04_lower"), F.upper("p_name").alias("scl04_upper"),
        textnorm.contains_any("p_name", ["ring", "bolt"]).alias("scl05_any_word"),
        F.startswith("p_brand", F.lit("Brand#1")).alias("scl06_prefix"),
        F.endswith("p_brand", F.lit("2")).alias("scl06_suffix"),
        F.get(F.split("p_name", " "), F.lit(1)).alias("scl07_second_word"),
        F.substring("p_name", 2, 3).alias("scl08_part"),
        F.size(F.split("p_name", "")).cast("bigint").alias("scl09_characters"),
        F.replace("p_brand", F.lit("Brand"), F.lit("B")).alias("scl10_replaced"),
        F.col("p_size").cast("string").alias("scl11_text"),
        F.translate("p_brand", "Brand#", "").try_cast("double").alias("scl12_number"),
        F.char_length("p_name").cast("bigint").alias("scl13_length"),
    ),
    "select p_partkey, p_name as scl01_trim, regexp_replace(p_brand, '[#0-9]+', '-', 'g')"
    " as scl02_replace, regexp_matches(p_name, '^(red|blue)') as scl03_match,"
    " lower(p_type) as scl04_lower, upper(p_name) as scl04_upper,"
    " contains(p_name, 'ring') or contains(p_name, 'bolt') as scl05_any_word,"
    " starts_with(p_brand, 'Brand#1') as scl06_prefix, suffix(p_brand, '2') as scl06_suffix,"
    " string_split(p_name, ' ')[2] as scl07_second_word, substr(p_name, 2, 3) as scl08_part,"
    " length(p_name) as scl09_characters, replace(p_brand, 'Brand', 'B') as scl10_replaced,"
    " cast(p_size as varchar) as scl11_text,"
    " try_cast(replace(p_brand, 'Brand#', '') as double) as scl12_number,"
    " length(p_name) as scl13_length from part",
)
register(
    "scl14_null_and_number_functions",
    lambda spark, folder: inputs.part_pairs(spark, folder).select(
        "model", "row_idx", "field", F.col("predicted").isNull().alias("scl14_missing"),
        F.coalesce(F.nullif("predicted", F.lit("")), F.col("record_id")).alias("scl15_default"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.char_length("predicted") / 20)).alias(
            "scl16_clipped"
        ),
        F.size(
            F.filter(
                F.zip_with(F.split("correct", " "), F.split("predicted", " "), lambda a, b: a == b),
                lambda same: same,
            )
        ).cast("bigint").alias("scl18_equal_words"),
        F.col("field").isin("品名", "型別").alias("scl21_member"),
    ).filter(F.col("scl18_equal_words") >= 0),
    inputs.part_sql(
        "select model, row_idx, field, predicted is null as scl14_missing,"
        " coalesce(nullif(predicted, ''), record_id) as scl15_default,"
        " greatest(0.0::double, least(1.0::double, length(predicted) / 20)) as scl16_clipped,"
        " len(list_filter(list_zip(string_split(correct, ' '), string_split(predicted, ' ')),"
        " lambda p: p[1] = p[2])) as scl18_equal_words, field in ('品名', '型別') as scl21_member"
        " from pairs where correct is not null and predicted is not null",
        scored=False,
    ),
)
register(
    "scl17_list_and_map_functions",
    lambda spark, folder: rounded(
        inputs.part_scores(spark, folder).groupBy("model", "row_idx").agg(
            F.avg("similarity").alias("scl17_mean"), F.min("similarity").alias("scl17_min"),
            F.max("similarity").alias("scl17_max"),
            F.stddev_pop("similarity").alias("scl17_deviation"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("field_order", "field"))),
                    lambda s: s["field"],
                ), ",",
            ).alias("scl19_fields"),
            F.array_join(
                F.array_sort(
                    F.map_keys(F.map_from_entries(F.collect_list(F.struct("field", "cer"))))
                ), ",",
            ).alias("scl20_keys"),
            F.bool_or("is_exact_match").alias("scl22_any"),
            F.concat_ws("\n", F.array_sort(F.collect_list("field"))).alias("scl25_lines"),
        ),
        "scl17_mean", "scl17_min", "scl17_max", "scl17_deviation",
    ),
    inputs.part_sql(
        "select model, row_idx, round(avg(similarity), 6) as scl17_mean,"
        " round(min(similarity), 6) as scl17_min, round(max(similarity), 6) as scl17_max,"
        " round(stddev_pop(similarity), 6) as scl17_deviation,"
        " string_agg(field, ',' order by field_order) as scl19_fields,"
        " string_agg(field, ',' order by field) as scl20_keys,"
        " bool_or(is_exact_match) as scl22_any,"
        " string_agg(field, chr(10) order by field) as scl25_lines from scores group by all"
    ),
)
register(
    "scl23_sorted_keys",
    lambda spark, folder: table(spark, folder, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names")
    ),
    "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by all",
)
register(
    "scl24_timestamp_text",
    lambda spark, folder: table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp")
    ),
    "select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp from events",
)

# --- files ---------------------------------------------------------------------------------------

register(
    "src03_headed_table",
    lambda spark, folder: tables.read_headed(spark, f"{folder}/nation.parquet"),
    "select * from nation",
)
register(
    "src06_admitted_files",
    lambda spark, folder: tables.admit_files(
        tables.list_files(spark, folder), limit=1024 * 1024, endings=(".parquet",)
    ).select(F.substring_index("path", "/", -1).alias("file"), "length", "accepted", "reason"),
)
PER_BOOK = 500
_SHEET_XML = (
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    "<sheetData>{0}</sheetData></worksheet>"
)
_BOOK_XML = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="s1" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
_LINKS_XML = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
)


def workbook_bytes(rows: list[list]) -> bytes:
    """A minimal spreadsheet file; text cells inline, numbers as numbers."""
    lines = []
    for r, values in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(values):
            ref = f"{chr(65 + c)}{r}"
            if value is None:
                continue
            if isinstance(value, str):
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{value}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("xl/workbook.xml", _BOOK_XML)
        archive.writestr("xl/_rels/workbook.xml.rels", _LINKS_XML)
        archive.writestr("xl/worksheets/sheet1.xml", _SHEET_XML.format("".join(lines)))
    return out.getvalue()


def _make_book(key, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("p_partkey")
    rows = [[int(k), n, float(p)] for k, n, p in
            zip(part["p_partkey"], part["p_name"], part["p_retailprice"])]
    return pd.DataFrame({"path": [f"book{key[0]}.xlsx"], "content": [workbook_bytes(rows)]})


def _books(spark, folder):
    """Spreadsheet files made from part, at most 500 rows each."""
    return (
        table(spark, folder, PART)
        .withColumn("book", F.floor(F.col("p_partkey") / PER_BOOK))
        .groupBy("book")
        .applyInPandas(_make_book, "path string, content binary")
    )


register(
    "src02_workbook_scan",
    lambda spark, folder: workbooks.good_rows(
        workbooks.parse_workbooks(_books(spark, folder))
    ).select(
        "workbook", "row_idx", F.get("values", F.lit(0)).alias("key"),
        F.get("values", F.lit(1)).alias("name"),
        F.get("values", F.lit(2)).cast("double").alias("price"),
    ),
    f"select concat('book', p_partkey // {PER_BOOK}, '.xlsx') as workbook,"
    f" p_partkey % {PER_BOOK} as row_idx, cast(p_partkey as varchar) as key, p_name as name,"
    " p_retailprice as price from part",
)

# --- sinks: written, then read back --------------------------------------------------------------


def _csv_grid(spark, folder):
    """Customers as CSV files, one per nation, with quoted cells, line breaks in them and ragged rows."""
    path = new_path(spark, "csv")
    quoted = "concat('\"', replace({0}, '#', concat('\"\"', chr(10))), '\"')"
    cells = (
        "c_custkey", quoted.format("c_name"), "if(c_custkey % 5 = 0, '', c_mktsegment)",
        quoted.format("concat('no ', c_custkey, ', \"\"x\"\"', chr(10), 'end')"),
    )
    wide = "concat_ws(',', " + ", ".join(cells) + ", c_mktsegment, 'last')"
    short = "concat_ws(',', " + ", ".join(cells) + ")"
    customer = table(spark, folder, "customer")
    customer.selectExpr(
        "c_nationkey as book", "c_custkey", f"if(c_custkey % 3 = 0, {wide}, {short}) as line"
    ).repartition("book").sortWithinPartitions("book", "c_custkey").select("book", "line").write.partitionBy("book").text(path)
    rows = tables.read_csv_grid(spark, path)
    return rows.select(
        F.regexp_extract("workbook", "book=([0-9]+)", 1).alias("workbook"), "row_idx",
        F.size("values").cast("bigint").alias("width"), F.array_join("values", "|", "~").alias("cells"),
    )


register(
    "src01_csv_grid",
    _csv_grid,
    "select cast(c_nationkey as varchar) as workbook,"
    " row_number() over (partition by c_nationkey order by c_custkey) - 1 as row_idx,"
    " cast(case when c_custkey % 3 = 0 then 6 else 4 end as bigint) as width,"
    " concat(c_custkey, '|', replace(c_name, '#', concat('\"', chr(10))), '|',"
    " case when c_custkey % 5 = 0 then '~' else c_mktsegment end, '|no ', c_custkey, ', \"x\"', chr(10), 'end',"
    " case when c_custkey % 3 = 0 then concat('|', c_mktsegment, '|last') else '' end) as cells from customer",
)


def _read_report(spark, path, *columns):
    return spark.read.parquet(path).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _written(spark, folder):
    path = new_path(spark, "report")
    scores = inputs.certificate_scores(spark, folder)
    sinks.write_model_report(reports.individual_lines(scores), path)
    return _read_report(spark, path, "sheet", "model")


register(
    "snk01_model_partitions",
    _written,
    cert_sql(
        "select model as sheet, model, count(*) as n from lines group by all",
        RECORDS_SQL, lines_sql("overall"),
    ),
)


def _written_single(spark, folder):
    path = new_path(spark, "single-report")
    pairs = inputs.certificate_pairs(spark, folder).filter("model = 'model_1'")
    result = evaluate_pairs(pairs)
    sinks.write_single_report(result.report, result.records, result.fields, path)
    return _read_report(spark, path, "sheet", "kind")


register(
    "snk02_single_report",
    _written_single,
    cert_sql(
        "select model as sheet, kind, count(*) as n from lines where model = 'model_1' group by all",
        RECORDS_SQL, lines_sql("overall"),
    ),
)


def _written_documents(spark, folder):
    path = new_path(spark, "document-report")
    sinks.write_document_report(reports.document_lines(_cases(spark, folder)), path)
    return _read_report(spark, path, "sheet", "band")


register(
    "snk03_document_report",
    _written_documents,
    document_sql(
        "select model as sheet, " + BAND_SQL.format("accuracy") + " as band, count(*) as n from ("
        "select model, accuracy from cases union all"
        " select model, round(avg(accuracy), 9) from cases group by workbook, model, case_id)"
        " group by all",
        CASES_SQL,
    ),
)

# --- streams -------------------------------------------------------------------------------------


def _streamed(spark, folder):
    """Pairs written as files, scored as they arrive, totals over all batches."""
    source, out, state = (new_path(spark, n) for n in ("pairs", "totals", "state"))
    pairs = inputs.certificate_pairs(spark, folder)
    pairs.repartition(4, "model", "row_idx").write.parquet(source)
    stream = incremental.pair_stream(spark, source, files_per_batch=2)
    incremental.start_field_totals(stream, out, state).awaitTermination()
    return rounded(incremental.field_totals(spark, out), "accuracy")


register(
    "str01_incremental_totals",
    _streamed,
    cert_sql(
        "select workbook, model, field, round(avg(similarity), 6) as accuracy,"
        " count(*) filter (where is_exact_match) as exact_matches, count(*) as total_records,"
        " count(*) filter (where is_mismatch) as mismatched from scores group by all"
    ),
)
