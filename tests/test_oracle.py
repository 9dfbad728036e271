"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from terradelta.plans.fixtures import TABLES

from .conftest import SF

ORACLES = entry.oracle_sql()
# Long iterative queries are compared with plain loops in test_merge.py and test_extents.py.
ROWS_ONLY = [n for n in entry.queries() if n not in ORACLES and n not in ("stream_merge_cases", "merge_candidates")]


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(v + 0.0 if v else 0.0) if isinstance(v, float) else str(v)


def rows(t):
    names = sorted(t.column_names)
    return names, sorted(tuple(map(canonical, r)) for r in zip(*[t.column(n).to_pylist() for n in names]))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_contract():
    assert set(ORACLES) <= set(entry.queries()) and len(ORACLES) > 120


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert rows(entry.queries()[name](spark, SF).toArrow()) == rows(con.sql(ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
