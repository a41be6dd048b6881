import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare
from lodefield.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, name, sf).startswith("ok")


def test_entry_and_keys(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["kriging", "kriging_fast", "kriging_2d"])
def test_every_target_is_estimated(spark, sf, name):
    out = queries()[name](spark, sf).toPandas()
    assert len(out) and out.kriging_pred.notna().all() and (out.kriging_pred_status == "ok").all()
