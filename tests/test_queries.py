"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siskin import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return str([float(x) for x in v])
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return str(float(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = registry.queries()[name](spark, FOLDER)
    rows = [[cell(r[c]) for c in sorted(got.columns)] for r in got.collect()]
    want = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(rows) == sorted([cell(r[i]) for i in order] for r in want.fetchall())


def test_cms_topk_with_more_keys_than_buckets(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT CASE WHEN i % 100000 > 0 THEN i % 100000 END AS o_custkey FROM range(800000) t(i) UNION ALL SELECT 5 * i FROM range(9000) t(i) UNION ALL SELECT unnest([45000, 45000, NULL, NULL])")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    got = registry.queries()["cms_topk"](spark, str(tmp_path))
    # NULL is as frequent as the first, and comes after it
    assert [tuple(r) for r in got.collect()] == con.execute(registry.oracle_sql()["cms_topk"]).fetchall()


def test_entry(spark):
    assert entry.entry(spark).columns == ["c_mktsegment", "o_orderpriority", "n", "lines", "most"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
