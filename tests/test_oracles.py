"""Every query with SQL gives the rows that DuckDB gives on the same tables.

Events are those of five days, so that queries that write a lake make a hundred hour files and not five hundred; set
TEST_SF_DIR to run over the whole tables of a folder.
"""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DAYS = (0, 1, 10, 11, 12)


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    if whole := os.environ.get("TEST_SF_DIR"):
        return whole
    source, folder = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("tables"))
    for path in glob.glob(f"{source}/*.parquet"):
        if not path.endswith("/events.parquet"):
            os.symlink(path, f"{folder}/{os.path.basename(path)}")
    days = f"date_diff('day', (SELECT min(ts) FROM '{source}/events.parquet'), date_trunc('day', ts)) IN {DAYS}"
    number = "row_number() OVER (ORDER BY event_id) - 1 AS event_id"  # fifty in a row are a payload
    duckdb.sql(f"COPY (SELECT * REPLACE ({number}) FROM '{source}/events.parquet' WHERE {days} ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


def plain(value):
    if value is None or str(value) in ("<NA>", "nan", "NaT"):
        return "NULL"
    return f"{float(value):.6f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
