"""Every registered query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import math
import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
pd = pytest.importorskip("pandas")

from tracebook.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"


def cell(v):
    if not isinstance(v, (list, dict)) and pd.isna(v):
        return ""
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    try:
        x = float(v)
        return "" if math.isnan(x) else repr(round(x, 5) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def table_rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        want = con.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert table_rows(got) == table_rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
