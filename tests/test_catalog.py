"""Every registered query against its DuckDB oracle (sf0.001), plus the entry smoke check."""
import pytest

import __spark_entry__ as E
from protoflow.plans.catalog import QUERIES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)       # the training-data queries have their own tests


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["event_type", "n", "n_value", "sum_event_id", "min_ts", "max_ts", "max_value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toArrow()
    want = con.sql(E.oracle_sql()[name]).arrow()
    if hasattr(want, "read_all"):
        want = want.read_all()
    assert compare(got, want) == []
