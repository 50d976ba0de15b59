"""Every registered query equals its DuckDB oracle on the sf0.001 tables (the driver checks sf0.01)."""

import os
import sys

import duckdb
import pytest

from tests.conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as entry  # noqa: E402
from jobtrail.plans import catalog  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    r = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    duck = dict(zip(r.columns, [str(t) for t in r.types]))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == duck
    orows = r.fetchall()
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(r.columns, orows)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["content_hash", "job_title", "company_name", "job_url", "tech"]
    assert df.count() > 0
