"""Every query with SQL against DuckDB on the whole small tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from rowloom.registry import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return "" if x is None else str(x)


def multiset(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in at]), sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    sql = db.execute(ORACLE_SQL[name])
    assert multiset(df.columns, rows) == multiset([c[0] for c in sql.description], sql.fetchall())


def test_outer_rows_on_both_sides(spark):
    anti = QUERIES["join_symmetric_anti"](spark, SF_DIR)
    assert anti.filter("doc_id is null").count() and anti.filter("conv_id is null").count()


def test_bucketed_join_has_no_exchange(spark):
    plan = QUERIES["bucketed_inner"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
