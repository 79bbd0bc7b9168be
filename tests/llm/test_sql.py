"""The queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from stellate.llm import warc
from stellate.llm.queries import QUERIES, SQL


def rows(cursor):
    return sorted(tuple(map(repr, r)) for r in cursor)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert rows(map(tuple, got.select(*names).collect())) == rows(want.fetchall())


def test_archives_with_equal_pages(spark, tmp_path):
    pages = [(i, f"u{i}", "x" * (i % 4)) for i in range(20)] + [(30, None, None), (31, None, "é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(SQL["op9_warc"])
    names = [c[0] for c in want.description]
    assert rows(map(tuple, warc.archive(df).select(*names).collect())) == rows(want.fetchall())
