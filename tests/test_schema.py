"""Pure schema tests: type map, keep-lists, names, fixed column sets."""
import pytest
from google.protobuf import descriptor_pb2
from pyspark.sql import types as T

from protoflow.functions import descriptors as D
from protoflow.functions.schema import (VIEW_COLUMNS_90, VIEW_COLUMNS_94, camel_name, describe_rows,
                                        snake_name, spark_schema)


def test_view_record_has_114_nullable_fields():
    st = spark_schema(*D.view_record())
    assert len(st) == 114
    assert all(f.nullable for f in st)
    assert st["view_id"].dataType == T.StringType()
    assert st["view_start"].dataType == T.TimestampType()
    assert st["player_source_duration"].dataType == T.LongType()
    assert st["max_downscale_percentage"].dataType == T.FloatType()
    ev = st["events"].dataType.elementType
    assert [f.name for f in ev] == ["sequence_number", "server_time", "viewer_time", "playhead_time",
                                    "type", "orientation_info", "rendition_info"]
    assert ev["playhead_time"].dataType == T.DayTimeIntervalType(0, 3)
    assert ev["sequence_number"].dataType == T.LongType()


def test_timestamp_and_duration_modes():
    ds, mn = D.view_record()
    assert spark_schema(ds, mn, timestamp="epoch_seconds")["view_start"].dataType == T.LongType()
    assert spark_schema(ds, mn, timestamp="string")["view_start"].dataType == T.StringType()
    assert spark_schema(ds, mn, timestamp="timestamp_ntz")["view_end"].dataType == T.TimestampNTZType()
    ev = spark_schema(ds, mn, duration="string")["events"].dataType.elementType
    assert ev["playhead_time"].dataType == T.StringType()
    with pytest.raises(ValueError):
        spark_schema(ds, mn, timestamp="bogus")


def test_keep_list_uses_dotted_paths():
    st = spark_schema(*D.view_record(), fields=["view_id", "events.type", "events.rendition_info.fps"])
    assert st.simpleString() == ("struct<view_id:string,events:array<struct<type:string,"
                                 "rendition_info:struct<fps:double>>>>")
    with pytest.raises(ValueError):
        spark_schema(*D.view_record(), fields=["no_such_field"])


def test_wide_types_and_enum_modes():
    st = spark_schema(*D.order_msg())
    assert st["status"].dataType == T.StringType()
    assert st["cust_key"].dataType == T.LongType()          # uint32 widened
    assert st["order_key_u64"].dataType == T.LongType()
    assert st["priority_bytes"].dataType == T.BinaryType()
    assert st["total_price"].dataType == T.DoubleType()     # wrapper -> scalar
    assert st["counters"].dataType == T.MapType(T.StringType(), T.LongType(), True)
    assert st["attrs"].dataType == T.StringType()           # Struct -> JSON text
    st2 = spark_schema(*D.order_msg(), enums="int", uint64="decimal")
    assert st2["status"].dataType == T.IntegerType()
    assert st2["order_key_u64"].dataType == T.DecimalType(20, 0)


def test_oneof_case_column():
    ev = spark_schema(*D.view_record(), oneof_case=True)["events"].dataType.elementType
    assert ev.fieldNames()[-1] == "info_case"


def test_evolution_pair_uses_own_clock_messages():
    st = spark_schema(*D.video_view())
    assert len(st) == 121
    assert st["view_start"].dataType.simpleString() == "struct<seconds:bigint,nanos:int>"
    assert st["asset_id"].dataType == T.StringType()


def test_recursive_message_is_cut_at_depth():
    fdp = descriptor_pb2.FileDescriptorProto(name="rec.proto", package="rec", syntax="proto2")
    node = fdp.message_type.add(name="Node")
    node.field.add(name="label", number=1, type=9, label=1)
    child = node.field.add(name="child", number=2, type=11, label=1)
    child.type_name = ".rec.Node"
    ds = D.descriptor_set(fdp)
    st = spark_schema(ds, "rec.Node", max_depth=3)
    s = st.simpleString()
    assert s.count("child") == 4 and s.endswith("child:string>>>>")   # 3 levels, then JSON text


def test_recursion_is_cut_before_it_multiplies():
    fdp = descriptor_pb2.FileDescriptorProto(name="tree.proto", package="tree", syntax="proto2")
    node = fdp.message_type.add(name="Node")
    for i, name in enumerate(("left", "middle", "right"), 1):
        node.field.add(name=name, number=i, type=11, label=1).type_name = ".tree.Node"
    ds = D.descriptor_set(fdp)
    assert spark_schema(ds, "tree.Node").simpleString().count(":string") == 3 ** 4
    assert spark_schema(ds, "tree.Node", max_recursion=1).simpleString().count(":string") == 3 ** 2
    assert len(describe_rows(ds, "tree.Node")) == 3 + 9 + 27 + 81


def test_fixed_column_sets():
    assert len(VIEW_COLUMNS_90) == 90 and len(VIEW_COLUMNS_94) == 94
    assert VIEW_COLUMNS_90[0] == "view_id" and VIEW_COLUMNS_90[-1] == "stream_type"
    at = VIEW_COLUMNS_94.index("country_name")
    assert VIEW_COLUMNS_94[at + 1:at + 5] == ("custom_2", "custom_3", "custom_4", "custom_5")
    assert "view_start" not in VIEW_COLUMNS_90 and "events" not in VIEW_COLUMNS_90


def test_names():
    assert camel_name("custom_1") == "custom1"
    assert snake_name("custom1") == "custom_1"
    assert snake_name("viewMaxPlayheadPosition") == "view_max_playhead_position"
    for _t, _l, _ft, name in D.VIEW_RECORD_FIELDS:
        assert snake_name(camel_name(name)) == name


def test_describe_rows_cover_nested_paths():
    rows = describe_rows(*D.view_record())
    paths = {r[1]: r for r in rows}
    assert paths["view_id"][2:5] == (1, "string", "required")
    assert paths["events"][3:5] == ("eventstream.Event", "repeated")
    assert paths["events.rendition_info.bitrate"][2] == 4
    assert len([p for p in paths if "." not in p]) == 114


def test_pruned_class_keeps_only_selected_fields():
    ds, mn = D.view_record()
    full = D.message_class(ds, mn)
    m = full(view_id="a", asn=3)
    m.events.add(type="x")
    pruned = D.pruned_class(ds, mn, {"asn": None, "view_id": None})
    p = pruned.FromString(m.SerializePartialToString())
    assert [f.name for f, _ in p.ListFields()] == ["view_id", "asn"]
    assert full.FromString(p.SerializePartialToString()) == m    # unknown tags are kept
    o = D.pruned_class(*D.order_msg(), {"counters": None, "status": None})
    assert o.DESCRIPTOR.fields_by_name["counters"].message_type.GetOptions().map_entry


def test_nested_pruning():
    ds, mn = D.view_record()
    full = D.message_class(ds, mn)
    m = full(view_id="a")
    e = m.events.add(type="x", sequence_number=4)
    e.server_time.seconds = 9
    p = D.pruned_class(ds, mn, {"events": {"type": None}})
    ev = p.FromString(m.SerializePartialToString()).events[0]
    assert [f.name for f, _ in ev.ListFields()] == ["type"] and ev.type == "x"
    assert full.FromString(p.FromString(m.SerializePartialToString()).SerializePartialToString()) == m


def test_decode_reslices_large_batches(monkeypatch):
    import pyarrow as pa

    from protoflow.functions import codec
    from protoflow.functions.schema import make_options
    ds, mn = D.view_record()
    cls = D.message_class(ds, mn)
    blobs = [cls(view_id=str(i), custom_1="x" * 100).SerializePartialToString() for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["value"])
    monkeypatch.setattr(codec, "MAX_SLICE_BYTES", 1000)     # ~9 messages per slice
    out = list(codec.decode_batches([batch], ds, mn, ["view_id"], make_options(), "value", (), False,
                                    True, "value"))
    assert len(out) > 1
    assert [v for b in out for v in b.column(0).to_pylist()] == [str(i) for i in range(50)]


def test_encode_takes_a_large_batch_in_parts(monkeypatch):
    """Lists, maps and NULLs of a batch come out alike whether it is converted whole or in parts, and no part is large."""
    import pyarrow as pa

    from protoflow.functions import codec
    t = pa.list_(pa.struct([("a", pa.int64()), ("m", pa.map_(pa.string(), pa.int64()))]))
    rows = [None if i % 7 == 0 else [{"a": j, "m": [("k", j)]} for j in range(i % 50)] for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, t), pa.array(range(500))], names=["l", "i"])
    parts = list(codec._parts(batch, 4096))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert max(p.nbytes for p in parts if p.num_rows > 1) <= 4096
    assert sum(len(p.column("l").values) for p in parts) == len(batch.column("l").values)    # no part keeps them all

    from pyspark.sql import types as T

    from protoflow.functions.schema import make_options
    ds, mn = D.view_record()
    sizes, real = [], codec._fast_rows
    monkeypatch.setattr(codec, "_fast_rows", lambda b, *a: sizes.append(b.num_rows) or real(b, *a))
    views = pa.RecordBatch.from_arrays(
        [pa.array([str(i) for i in range(200)]),
         pa.array([[{"sequence_number": j, "type": "click"} for j in range(i % 40)] for i in range(200)],
                  pa.list_(pa.struct([("sequence_number", pa.int64()), ("type", pa.string())])))], names=["view_id", "events"])
    event = T.StructType().add("sequence_number", T.LongType()).add("type", T.StringType())
    schema = T.StructType().add("view_id", "string").add("events", T.ArrayType(event))

    def encoded():
        out = codec.encode_batches([views], ds, mn, schema, ("view_id", "events"), ("view_id",), "value", True, make_options())
        return [v for b in out for v in b.column("value").to_pylist()]

    whole = encoded()
    assert sizes == [200]
    monkeypatch.setattr(codec, "ENCODE_BYTES", 2000)
    assert encoded() == whole and len(sizes) > 10 and max(sizes[1:]) < 200
