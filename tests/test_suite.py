"""Every registered query against its SQL twin on the smallest data."""

import duckdb
import pytest

from tests.conftest import SMALL
from tidelens.suite import all_queries
from tidelens.suite.run_check import TABLES, compare

QUERIES = all_queries()
#: Queries whose rule no row of the smallest tables meets.
EMPTY = {"prj_18_alerting", "jon_21_alerts_due", "jon_13_has_match"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, name):
    ok, message = compare(spark, con, QUERIES[name], SMALL)
    assert ok, message
    assert "EMPTY" not in message or name in EMPTY


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["run_at", "zone_id", "eez_area_km2", "zone_area_km2", "nearest_km", "patch_count"]
