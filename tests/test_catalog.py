"""Every query with SQL is held against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from folioforge.jobs import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "part", "documents", "embeddings", "pages")  # all that the form jobs read


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return f"{value:.6f}" if isinstance(value, float) else str(int(value)) if isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    float_ = {c for c, t in got.dtypes if t in ("double", "float")}
    key = lambda r: [shown(float(r[c]) if c in float_ and r[c] is not None else r[c]) for c in order]
    rows = sorted(map(str, map(key, (r.asDict() for r in got.collect()))))
    assert rows == sorted(map(str, map(key, want))) and rows


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
