"""Every panel query with SQL against DuckDB on the smallest tables. Models are tested in test_forecast."""

import os

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or x != x else str(x)[:10] if hasattr(x, "isoformat") else repr(x) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(str(plain(r[names.index(c)])) for c in columns) for r in cur.fetchall())
    assert sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect()) == theirs


def test_features_hold_no_keys():
    from gridloom.operators.panel import feature_columns

    class Table:
        columns = ["lat", "lon", "ID", "time", "value", "target", "is_train", "masked", "value_lag1"]

    from gridloom.plans.features import not_features

    assert feature_columns(Table, not_features()) == ["value", "value_lag1"]
