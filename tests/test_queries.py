"""Every query with SQL against the same SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from marula.plans import packed
from marula.plans.registry import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


QUERIES = {**QUERIES, **packed.QUERIES}
SQL = {**SQL, **packed.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = db.sql(SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    theirs = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_packed_values(spark, data):
    rows = packed.p6_found(spark, data).collect()
    assert rows and all(r.row_id % 10 == 0 and r.item == r.item.strip() != "" for r in rows)
    cells = {}
    for r in rows:
        cells.setdefault((r.row_id, r.field_name), []).append(r.item_pos)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in cells.values())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
