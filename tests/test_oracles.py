"""Every query with SQL agrees with DuckDB on the smallest tables, compared as the driver does: by sorted columns and values."""

import glob
import math
import os

import duckdb
import pytest

from scoreloom import plans

SF = "/root/testdata/sf0.001"
ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, float) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    got = plans.queries()[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(ORACLES)))
def test_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
