"""Physical-plan checks: pruning reaches the scans, no single-partition bottlenecks."""
import contextlib
import io

from pyspark.sql import functions as F

from protoflow.functions import descriptors as D
from protoflow.operators.sampling import pick_file, sample_files
from protoflow.plans.catalog import view_tree
from protoflow.sources import fixtures as FX
from protoflow.sources.files import list_files, read_messages


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_listing_never_reads_content(spark, sf_small):
    p = plan(list_files(spark, view_tree(spark, sf_small)))
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in p


def test_decode_reads_only_kept_columns(spark, sf_small):
    df = read_messages(spark, view_tree(spark, sf_small), D.view_record(), fields=["view_id"],
                       keep=("view_date",))
    p = plan(df)
    assert "ReadSchema: struct<path:string,content:binary>" in p
    assert "MapInArrow" in p


def test_filters_reach_the_table_scan(spark, sf_small):
    ev = FX.event_rows(spark, sf_small).where(F.col("event_type") == "view")
    p = plan(ev)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in p


def test_sampling_has_no_single_partition_step(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id", "event_type")
    p = plan(sample_files(ev, 0.05, by="event_type", key="event_id"))
    assert "SinglePartition" not in p
    assert "Window" in p and "Union" not in p


def test_pick_is_a_distributed_top_one(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id")
    p = plan(pick_file(ev, key="event_id"))
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_view_grouping_shuffles_on_the_bounded_view_key(spark, sf_small):
    p = plan(FX.view_rows(spark, sf_small))
    assert "hashpartitioning(user_id" in p and "_split" in p and "REPARTITION_BY_NUM" in p
    assert "windowspecdefinition(user_id" in p and "_hour" in p    # ranked inside an hour, never over a whole user


def test_spread_only_touches_small_inputs(spark, sf_small):
    from protoflow._session import spread
    small = spark.read.parquet(f"{sf_small}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert small.rdd.getNumPartitions() < cores
    assert spread(small).rdd.getNumPartitions() == cores
    wide = small.repartition(cores * 2)
    assert spread(wide) is wide                    # enough splits already: no extra shuffle


def test_sampled_read_lists_without_content(spark, sf_small):
    from protoflow.plans.catalog import q45_read_sampled
    p = plan(q45_read_sampled(spark, sf_small))
    assert "content" not in [line for line in p.splitlines() if "ReadSchema" in line][0]
    import re
    assert len(re.findall(r"^\(\d+\) MapInArrow", p, re.M)) == 2   # read the chosen files, then decode
