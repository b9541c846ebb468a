"""Seeded property test: random rows (random NULLs = unset fields) survive encode -> decode."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from protoflow.functions import descriptors as D
from protoflow.functions.api import decode, encode

VIEW = D.view_record()
I32 = st.integers(-(2**31), 2**31 - 1)
I64 = st.integers(-(2**63), 2**63 - 1)
TEXT = st.text(max_size=12)
TS = st.datetimes(min_value=dt.datetime(1900, 1, 1), max_value=dt.datetime(2200, 1, 1))
F32 = st.floats(width=32, allow_nan=False)
F64 = st.floats(allow_nan=False)


def maybe(s):
    return st.one_of(st.none(), s)


event = st.fixed_dictionaries({
    "sequence_number": st.integers(0, 2**63 - 1),
    "server_time": TS, "viewer_time": TS,
    "playhead_time": st.timedeltas(min_value=dt.timedelta(days=-30), max_value=dt.timedelta(days=30)),
    "type": TEXT,
    "rendition_info": maybe(st.fixed_dictionaries({"width": maybe(I64), "height": maybe(I64),
                                                   "fps": maybe(F64), "bitrate": maybe(I64)})),
})
row = st.fixed_dictionaries({
    "view_id": TEXT, "property_id": TEXT, "view_start": TS, "view_end": TS,
    "events": maybe(st.lists(event, min_size=1, max_size=3)),
    "asn": maybe(I32), "browser": maybe(TEXT), "exit_before_video_start": maybe(st.booleans()),
    "latitude": maybe(F64), "max_downscale_percentage": maybe(F32),
    "player_source_duration": maybe(I64), "watch_time": maybe(I32),
})
SCHEMA = ("view_id string, property_id string, view_start timestamp_ntz, view_end timestamp_ntz, "
          "events array<struct<sequence_number:long,server_time:timestamp_ntz,viewer_time:timestamp_ntz,"
          "playhead_time:interval day to second,type:string,"
          "rendition_info:struct<width:long,height:long,fps:double,bitrate:long>>>, "
          "asn int, browser string, exit_before_video_start boolean, latitude double, "
          "max_downscale_percentage float, player_source_duration long, watch_time int")


@settings(max_examples=3, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow,
                                 HealthCheck.data_too_large])
@given(st.lists(row, min_size=20, max_size=40))
def test_random_rows_round_trip(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in COLS_TOP) for r in rows], SCHEMA)
    out = decode(encode(df, VIEW), VIEW, fields=COLS_TOP, timestamp="timestamp_ntz")
    got = sorted(map(_norm, out.collect()), key=repr)
    want = sorted(map(_norm, df.collect()), key=repr)
    assert got == want


COLS_TOP = ["view_id", "property_id", "view_start", "view_end", "events", "asn", "browser",
            "exit_before_video_start", "latitude", "max_downscale_percentage",
            "player_source_duration", "watch_time"]


def _norm(r):
    d = r.asDict(recursive=True)
    if d["events"] is not None:
        for e in d["events"]:
            e.pop("orientation_info", None)        # not in the input rows
    return d
