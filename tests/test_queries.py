"""Every query of the engine against its SQL on DuckDB."""

import decimal

import duckdb
import pytest

from relcheck.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df, r = QUERIES[name](spark, DIR), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    own = sorted(repr([plain(v) for v in row]) for row in df.select(*columns).collect())
    other = sorted(repr([plain(v) for v in row]) for row in r.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert own == other


def test_sum_of_large_keys(spark, tmp_path):
    """Keys that don't fit 64 bits together with the number that is added to each."""
    rows = duckdb.sql("select unnest([0, 775807, 775808, 2000000, 9223372036854775807, -5, null]::bigint[]) as o_orderkey")
    rows.write_parquet(str(tmp_path / "orders.parquet"))
    total = duckdb.sql(SQL["sum_beyond_64_bits"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet'")).fetchall()
    assert [tuple(r) for r in QUERIES["sum_beyond_64_bits"](spark, str(tmp_path)).collect()] == total
