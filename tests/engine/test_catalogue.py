"""Every catalogue query against its SQL in DuckDB, and unchanged by the order of rows."""

from __future__ import annotations

import duckdb
import pytest

from vellum.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for name in TABLES:
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return own


def plain(value):
    return round(float(value), 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in row) for row in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_kernel_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["anchor_counts", "review_items"])
@pytest.mark.parametrize("prices", [(7889.73, 78891.45), (78891.45, 7889.73), (7889.73, 7889.73)])
def test_order_lines_with_one_number(spark, tmp_path, name, prices):
    """The misread price of either line is within an edit of both prices, but each line is held against its own."""
    rows = ", ".join(f"({key}, {number}, {price})" for key in (35, 7, 1) for number, price in [(2, 95425.94), (3, prices[0]), (3, prices[1])])
    own = duckdb.connect()
    own.execute(f"CREATE TABLE lineitem AS SELECT k::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, p::DOUBLE AS l_extendedprice FROM (VALUES {rows}) v(k, n, p)")
    own.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    found = own.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted((tuple(r[c] for c in columns) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == sorted(found.fetchall(), key=repr)
