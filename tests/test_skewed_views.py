"""View queries on a table with one busy user and many rows without a user, against DuckDB."""
import duckdb
import pytest

import __spark_entry__ as E
from protoflow._session import new_scratch
from tests.oracle_check import compare

VIEW_QUERIES = ["q03_flatten_default", "q05_field_list", "q08_timestamp_modes", "q09_duration", "q10_explode_events",
                "q18_populated", "q22_path_date", "q23_sample", "q36_ingest_report", "q38_flatten_populated",
                "q45_read_sampled"]


@pytest.fixture(scope="module")
def skewed(spark):
    """14,000 events of one user, 5,000 rows with no user, a few others; equal times on purpose."""
    folder = new_scratch(spark, "skewed")
    spark.sql("""
        SELECT id AS event_id, timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, (id % 40000) * 7) AS ts,
               CASE WHEN id < 14000 THEN 11L WHEN id < 19000 THEN CAST(NULL AS BIGINT) ELSE id % 13 END AS user_id,
               element_at(array('click', 'view', 'error', 'purchase', 'signup'), CAST(id % 5 + 1 AS INT)) AS event_type,
               id / 8.0D AS value, concat('{"k": ', id % 10, '}') AS props
        FROM range(19500)""").repartition(3).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def con(skewed):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{skewed.removeprefix('file:')}/events.parquet/*.parquet')")
    return c


@pytest.mark.parametrize("name", VIEW_QUERIES)
def test_view_query_matches_oracle(spark, skewed, con, name):
    got = E.queries()[name](spark, skewed).toArrow()
    want = con.sql(E.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert compare(got, want) == []


def test_busy_user_is_cut_into_runs(spark, skewed):
    from protoflow.sources import fixtures as FX

    sizes = {r["view_id"]: r["watch_time"] for r in FX.view_rows(spark, skewed).select("view_id", "watch_time").collect()}
    assert [sizes[f"11-{i}"] for i in range(3)] == [5000, 5000, 4000 + sum(1 for i in range(19000, 19500) if i % 13 == 11)]
    assert sizes["none-0"] == 5000
