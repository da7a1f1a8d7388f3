"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, normalised

ROWS_ONLY = ("m4_logistic_regression", "m12_degradation", "x6_model_rankings")


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, database, name):
    frame = entry.queries()[name](spark, sf_dir)
    cursor = database.execute(entry.oracle_sql()[name])
    want = normalised([d[0] for d in cursor.description], cursor.fetchall())
    assert normalised(frame.columns, [tuple(r) for r in frame.collect()]) == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 4


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
