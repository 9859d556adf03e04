"""Inputs of the catalogue: pairs and sheets derived from the given tables, in Spark and in SQL.

Both sides use the same generator text. Errors depend on the row key, so every kind of edit occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofgrid.catalog.registry import table
from proofgrid.config import DEFAULT_MAPPING
from proofgrid.operators.pairing import wide_to_pairs
from proofgrid.operators.scoring import score_document_pairs, score_pairs
from proofgrid.sources.tables import spread

N_MODELS = 3


def truth(value: str, key: str) -> str:
    return f"case when ({key}) % 17 = 0 then null else {value} end"


def perturbed(value: str, key: str, swap: tuple[str, str] = ("0", "O")) -> str:
    return (
        f"case when ({key}) % 13 = 0 then null"
        f" when ({key}) % 7 = 0 then replace({value}, '{swap[0]}', '{swap[1]}')"
        f" when ({key}) % 5 = 0 then substr({value}, 1, length({value}) - 2)"
        f" when ({key}) % 11 = 0 then concat({value}, ' x')"
        f" else {value} end"
    )


# --- certificate family: three fields of customer, three models -----------------------------------

LEVEL = "c_mktsegment"
CATEGORY = "c_name"
ICD = "concat('ICD ', c_nationkey, '.', c_custkey)"
CERT_VALUES = {"障礙等級": LEVEL, "障礙類別": CATEGORY, "ICD診斷": ICD}


def _cert_columns() -> list[str]:
    """``expression AS name`` of the wide certificate table."""
    columns = []
    for i, (field, value) in enumerate(CERT_VALUES.items()):
        truth_col, predicted_col = DEFAULT_MAPPING[field]
        columns.append(f"{truth(value, f'c_custkey + {3 * i}')} as `{truth_col}`")
        columns.append(f"{perturbed(value, f'c_custkey + m + {3 * i}')} as `{predicted_col}`")
    return columns


def certificates(spark: SparkSession, folder: str) -> DataFrame:
    """Headed certificate table: one row per customer and model."""
    base = spread(table(spark, folder, "customer")).select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment",
        F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("m"),
    )
    return base.selectExpr(
        "concat('wb_', c_nationkey) as workbook", "concat('model_', m) as model",
        "c_custkey as row_idx", "c_custkey as `編號`", "c_name as `受編`", *_cert_columns(),
    )


def certificate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return wide_to_pairs(
        certificates(spark, folder), row_idx="row_idx", workbook="workbook", model="model"
    )


def certificate_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_pairs(certificate_pairs(spark, folder))


CUSTOMER_MODELS = f"""wide as materialized (
  select c_custkey, c_name, c_nationkey, c_mktsegment, m
  from customer, (select unnest(range({N_MODELS})) as m))"""


def _cert_pair_sql() -> str:
    parts = []
    for i, (field, value) in enumerate(CERT_VALUES.items()):
        parts.append(
            f"select concat('wb_', c_nationkey) as workbook, concat('model_', m) as model,"
            f" c_custkey as row_idx, cast(c_custkey as varchar) as record_id,"
            f" c_name as subject_id, '{field}' as field, {i} as field_order,"
            f" {truth(value, f'c_custkey + {3 * i}')} as correct,"
            f" {perturbed(value, f'c_custkey + m + {3 * i}')} as predicted from wide"
        )
    return "pairs as (" + " union all ".join(parts) + ")"


CERT_PAIRS_SQL = f"{CUSTOMER_MODELS}, {_cert_pair_sql()}"

# Distances over words: every distinct word of a pair becomes one ASCII character.
SCORE_SQL = r"""clean as materialized (
  select *, regexp_replace(coalesce(correct, ''), '\s+', '', 'g') as nl,
    regexp_replace(coalesce(predicted, ''), '\s+', '', 'g') as nr,
    trim(regexp_replace(coalesce(correct, ''), '\s+', ' ', 'g')) as wl,
    trim(regexp_replace(coalesce(predicted, ''), '\s+', ' ', 'g')) as wr
  from pairs),
words as materialized (
  select *, string_split(wl, ' ') as tl, string_split(wr, ' ') as tr,
    list_distinct(list_concat(string_split(wl, ' '), string_split(wr, ' '))) as vocab
  from clean),
rated as materialized (
  select *,
    case when nl = nr then 0.0::double
      else levenshtein(nl, nr) / greatest(length(nl), length(nr)) end as cer,
    case when wl = wr then 0.0::double when wl = '' or wr = '' then 1.0::double
      when not contains(wl, ' ') and not contains(wr, ' ')
        then levenshtein(wl, wr) / greatest(length(wl), length(wr))
      else levenshtein(
        array_to_string(list_transform(tl, lambda t: chr(33 + list_position(vocab, t)::int)), ''),
        array_to_string(list_transform(tr, lambda t: chr(33 + list_position(vocab, t)::int)), ''))
        / greatest(len(tl), len(tr)) end as wer
  from words),
scores as materialized (
  select workbook, model, row_idx, record_id, subject_id, field, field_order, correct, predicted,
    cer, wer, greatest(0.0, 1.0 - cer) as similarity,
    greatest(0.0, 1.0 - cer) >= 0.99 as is_exact_match,
    greatest(0.0, 1.0 - cer) < 0.8 as is_mismatch
  from rated)"""

RECORDS_SQL = """records as materialized (
  select workbook, model, row_idx, record_id, subject_id, avg(similarity) as overall_accuracy,
    count(*) filter (where is_exact_match) as matched_fields, count(*) as total_fields
  from scores where correct is not null group by all)"""

FIELDS_SQL = """fields as materialized (
  select workbook, model, field, avg(similarity) as accuracy,
    count(*) filter (where is_exact_match) as exact_matches, count(*) as total_records,
    count(*) filter (where is_mismatch) as mismatched
  from scores group by all having count(correct) > 0 and count(predicted) > 0)"""

# Words of field names with their weights.
WEIGHT_SQL = """case when contains(field, '障礙等級') then 0.3 when contains(field, '障礙類別') then 0.3
  when contains(field, 'ICD診斷') then 0.25 when contains(field, '證明/手冊') then 0.15
  else 0.25 end"""

OVERALL_SQL = f"""overall as materialized (
  select workbook, model,
    sum(accuracy * ({WEIGHT_SQL})::double) / sum(({WEIGHT_SQL})::double) as overall_accuracy
  from fields group by all)"""


def cert_sql(select: str, *extra: str, scored: bool = True) -> str:
    """A statement over the certificate pairs, their scores and further named steps."""
    steps = [CERT_PAIRS_SQL] + ([SCORE_SQL] if scored else []) + list(extra)
    return "with " + ",\n".join(steps) + "\n" + select


# --- word texts: three fields of part -------------------------------------------------------------

PART_VALUES = {
    "品名": "p_name",
    "型別": "concat(p_type, ' ', p_brand)",
    "說明": "concat(p_name, '  in size ', p_size, ' by ', p_brand)",
}
PART_SWAP = ("r", "s")


def part_pairs(spark: SparkSession, folder: str) -> DataFrame:
    base = spread(table(spark, folder, "part")).select(
        "p_partkey", "p_name", "p_type", "p_brand", "p_size",
        F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("m"),
    )
    entries = [
        f"named_struct('field', '{field}', 'field_order', {i},"
        f" 'correct', {truth(value, f'p_partkey + {3 * i}')},"
        f" 'predicted', {perturbed(value, f'p_partkey + m + {3 * i}', PART_SWAP)})"
        for i, (field, value) in enumerate(PART_VALUES.items())
    ]
    return base.selectExpr(
        "p_brand as workbook", "concat('model_', m) as model", "p_partkey as row_idx",
        "cast(p_partkey as string) as record_id", "p_name as subject_id",
        f"array({', '.join(entries)}) as pairs",
    ).select("workbook", "model", "row_idx", "record_id", "subject_id", F.inline("pairs"))


def part_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_pairs(part_pairs(spark, folder))


def _part_pair_sql() -> str:
    parts = [
        f"select p_brand as workbook, concat('model_', m) as model, p_partkey as row_idx,"
        f" cast(p_partkey as varchar) as record_id, p_name as subject_id, '{field}' as field,"
        f" {i} as field_order, {truth(value, f'p_partkey + {3 * i}')} as correct,"
        f" {perturbed(value, f'p_partkey + m + {3 * i}', PART_SWAP)} as predicted from wide"
        for i, (field, value) in enumerate(PART_VALUES.items())
    ]
    return (
        f"wide as materialized (select *, m from part, (select unnest(range({N_MODELS})) as m)),\n"
        "pairs as (" + " union all ".join(parts) + ")"
    )


PART_PAIRS_SQL = _part_pair_sql()


def part_sql(select: str, *extra: str, scored: bool = True) -> str:
    steps = [PART_PAIRS_SQL] + ([SCORE_SQL] if scored else []) + list(extra)
    return "with " + ",\n".join(steps) + "\n" + select


# --- document family: five typed fields of orders -------------------------------------------------

DOC_MODELS = 2


def _day(pattern: str, dialect: str, plus: int = 0) -> str:
    shifted = f"(o_orderdate + interval '{plus}' day)" if plus else "o_orderdate"
    if dialect == "spark":
        spelled = pattern.replace("%Y", "yyyy").replace("%y", "yy").replace("%m", "MM")
        return f"date_format({shifted}, '{spelled.replace('%d', 'dd')}')"
    return f"strftime({shifted}, '{pattern}')"


def document_values(dialect: str) -> dict[str, tuple[str, str]]:
    """Per field the truth and the prediction expression in one SQL dialect."""
    text_type = "string" if dialect == "spark" else "varchar"
    key = "o_orderkey + m"
    price = "cast(floor(o_totalprice) as bigint)"
    grouped = f"format_number({price}, 0)" if dialect == "spark" else f"format('{{:,}}', {price})"
    date_truth = f"case when o_orderkey % 17 = 0 then null else {_day('%Y%m%d', dialect)} end"
    date_pred = (
        f"case when ({key}) % 13 = 0 then null when ({key}) % 7 = 0 then {_day('%Y%m%d', dialect, 1)}"
        f" when ({key}) % 5 = 0 then {_day('%Y%m%d', dialect, 40)}"
        f" when ({key}) % 11 = 0 then {_day('%Y/%m/%d', dialect)}"
        f" when ({key}) % 19 = 0 then {_day('%y/%m/%d', dialect)}"
        f" else {_day('%Y%m%d', dialect)} end"
    )
    amount_truth = f"case when o_orderkey % 19 = 0 then null else cast({price} as {text_type}) end"
    amount_pred = (
        f"case when ({key}) % 13 = 0 then null"
        f" when ({key}) % 7 = 0 then cast({price} + 1 as {text_type})"
        f" when ({key}) % 5 = 0 then concat(cast({price} as {text_type}), '.0')"
        f" when ({key}) % 11 = 0 then 'abc' else {grouped} end"
    )
    flag = "case o_orderstatus when 'F' then 'Y' when 'O' then 'N' else 'P' end"
    flag_pred = (
        f"case when ({key}) % 13 = 0 then null when ({key}) % 7 = 0 then 'yes'"
        f" when ({key}) % 5 = 0 then '0' when ({key}) % 11 = 0 then lower(o_orderstatus)"
        f" else {flag} end"
    )
    note = (
        f"case o_orderkey % 4 when 0 then 'Y' when 1 then {_day('%y/%m/%d', dialect)}"
        f" when 2 then {grouped} else o_orderpriority end"
    )
    letter = "concat(o_orderpriority, '-', o_orderkey)"
    return {
        "發文日期": (date_truth, date_pred),
        "得請領_金額": (amount_truth, amount_pred),
        "小額終老非扣押範圍": (flag, flag_pred),
        "發文字號": (truth(letter, "o_orderkey + 2"), perturbed(letter, key)),
        "附註": (truth(note, "o_orderkey + 5"), perturbed(note, f"{key} + 3")),
    }


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    base = spread(table(spark, folder, "orders")).withColumn(
        "m", F.explode(F.sequence(F.lit(0), F.lit(DOC_MODELS - 1)))
    )
    entries = [
        f"named_struct('field', '{field}', 'field_order', {i}, 'correct', {left}, 'predicted', {right})"
        for i, (field, (left, right)) in enumerate(document_values("spark").items())
    ]
    return base.selectExpr(
        "concat('book_', o_custkey % 10) as workbook", "concat('model_', m) as model",
        "o_orderkey as row_idx", "concat('C', o_custkey) as case_id",
        f"array({', '.join(entries)}) as pairs",
    ).select("workbook", "model", "row_idx", "case_id", F.inline("pairs"))


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_document_pairs(document_pairs(spark, folder))


def _document_pair_sql() -> str:
    parts = [
        f"select concat('book_', o_custkey % 10) as workbook, concat('model_', m) as model,"
        f" o_orderkey as row_idx, concat('C', o_custkey) as case_id, '{field}' as field,"
        f" {i} as field_order, {left} as correct, {right} as predicted from wide"
        for i, (field, (left, right)) in enumerate(document_values("duckdb").items())
    ]
    return (
        f"wide as materialized (select *, m from orders, (select unnest(range({DOC_MODELS})) as m)),\n"
        "pairs as (" + " union all ".join(parts) + ")"
    )


DOCUMENT_PAIRS_SQL = _document_pair_sql()


def date_sql(value: str) -> str:
    digits = f"replace(replace({value}, '/', ''), '-', '')"
    padded = f"lpad({digits}, 8, '0')"
    return (
        f"case when regexp_full_match({digits}, '[0-9]{{7,8}}') then"
        f" concat(substr({padded}, 1, 3), '/', substr({padded}, 4, 2), '/', substr({padded}, 6, 2))"
        f" else {value} end"
    )


def amount_sql(value: str) -> str:
    return f"coalesce(try_cast(regexp_replace({value}, '[,\\s]', '', 'g') as double), 0.0::double)"


# Spellings of yes and no.
def boolean_sql(value: str) -> str:
    return (
        f"case when upper({value}) in ('Y','YES','TRUE','1','是') then 'Y'"
        f" when upper({value}) in ('N','NO','FALSE','0','否') then 'N' else upper({value}) end"
    )


# Type names, the words and value forms that decide between them.
def type_sql(name: str, left: str, right: str) -> str:
    rules = (
        f"when contains({name}, '日期') or contains(lower({name}), 'date') then '日期'"
        f" when contains({name}, '金額') or contains(lower({name}), 'amount')"
        f" or contains({name}, '元') then '金額'"
        f" when contains({name}, '範圍') and (contains(coalesce({left}, ''), '單筆')"
        f" or contains(coalesce({left}, ''), '全部')) then '文字'"
        f" when {name} = '小額終老非扣押範圍' then '布林值'"
    )
    for value in (left, right):
        rules += (
            f" when trim({value}) in ('Y','N','y','n','Yes','No','True','False') then '布林值'"
            f" when regexp_matches(trim({value}), '^[0-9]{{2,3}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}')"
            f" then '日期'"
            f" when regexp_full_match(replace(trim({value}), ',', ''), '[0-9]+([.][0-9]+)?')"
            f" then '金額'"
        )
    return f"case {rules} else '文字' end"


def value_sql(value: str, kind: str) -> str:
    return (
        f"case when {value} is null then '' when {kind} = '日期' then {date_sql(f'trim({value})')}"
        f" when {kind} = '金額' then cast({amount_sql(value)} as varchar)"
        f" when {kind} = '布林值' then {boolean_sql(f'trim({value})')} else trim({value}) end"
    )


def _parts_sql(left: str, right: str) -> str:
    terms = [
        f"case when string_split({left}, '/')[{i}] = string_split({right}, '/')[{i}]"
        f" then 1.0::double else 0.0::double end"
        for i in (1, 2, 3)
    ]
    return "(" + " + ".join(terms) + ") / 3.0::double"


DOCUMENT_SCORE_SQL = f"""typed as materialized (
  select *, {type_sql('field', 'correct', 'predicted')} as field_type from pairs),
valued as materialized (
  select *, {value_sql('correct', 'field_type')} as norm_correct,
    {value_sql('predicted', 'field_type')} as norm_predicted from typed),
redated as materialized (
  select *, {date_sql('norm_correct')} as dl, {date_sql('norm_predicted')} as dr,
    case when norm_correct = norm_predicted then 0.0::double
      when norm_correct = '' or norm_predicted = '' then 1.0::double
      else levenshtein(norm_correct, norm_predicted) / length(norm_correct) end as cer
  from valued),
scores as materialized (
  select workbook, model, row_idx, case_id, field, field_order, correct, predicted, field_type,
    norm_correct, norm_predicted, cer, cer as wer, similarity, similarity >= 0.99 as is_exact_match,
    case when similarity >= 0.99 then '' when field_type = '日期' then '日期格式或內容不符'
      when field_type = '金額' then '金額數值錯誤' when field_type = '布林值' then 'Y/N判斷錯誤'
      else '文字內容不符' end as error_description
  from (select *, case
      when field_type = '日期' then case when dl = dr then 1.0::double
        when len(string_split(dl, '/')) = 3 and len(string_split(dr, '/')) = 3
        then {_parts_sql('dl', 'dr')} else 0.0::double end
      when field_type = '金額' then
        case when {amount_sql('norm_correct')} = {amount_sql('norm_predicted')}
        then 1.0::double else 0.0::double end
      when field_type = '布林值' then
        case when {boolean_sql('norm_correct')} = {boolean_sql('norm_predicted')}
        then 1.0::double else 0.0::double end
      when norm_correct = norm_predicted then 1.0::double
      else greatest(0.0::double, 1.0 - cer) end as similarity from redated))"""


def document_sql(select: str, *extra: str, scored: bool = True) -> str:
    steps = [DOCUMENT_PAIRS_SQL] + ([DOCUMENT_SCORE_SQL] if scored else []) + list(extra)
    return "with " + ",\n".join(steps) + "\n" + select
