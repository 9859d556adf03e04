"""Registered queries against their SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, bag

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "agg03_overall", "fn06_wer", "fn24_percent_text", "agg13_field_evaluation",
    "rsh01_vertical_split", "rsh10_document_pairs", "lim01_first_mismatches", "agg08_distribution",
    "rsh16_pairs_by_alias", "src02_workbook_scan",
]
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r.model for r in rows) == ["model_0", "model_1", "model_2"]


@needs_tables
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    left: Counter = bag(df.collect(), df.columns)
    assert left == bag(result.fetchall(), columns)
