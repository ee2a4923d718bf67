"""Queries with SQL equal it; each registered query has a row for every row of its table."""

import os

import duckdb
import pytest

from cityportrait.llm import queries
from tests.test_queries import rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns) and rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op11_conversations", "op12_negatives"}))
def test_query_returns_its_whole_table(spark, name):
    source = "pages" if name in ("op4_html", "op13_warc") else "documents"
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() == spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").count()
