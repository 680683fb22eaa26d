"""All registered queries: against DuckDB where there is SQL, else that they run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lotline.catalog import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    return sorted(repr(tuple(int(v) if isinstance(v, bool) else float(v) if isinstance(v, (int, float)) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in cols)).collect()
    want = db.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({SQL[name]})").fetchall()
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
