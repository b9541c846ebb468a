"""The protobuf JSON mapping from decoded columns against the library's printer."""
import json
import random

from google.protobuf import descriptor_pb2, json_format

from protoflow.functions import descriptors as D
from protoflow.functions.api import decode_json
from protoflow.functions.descriptors import FDP, message_class
from tests.test_presence import fill, message


def df_of(spark, msgs):
    return spark.createDataFrame([(i, bytearray(m.SerializePartialToString())) for i, m in enumerate(msgs)], "id int, value binary")


def check(spark, msg, msgs, names="camel"):
    rows = decode_json(df_of(spark, msgs), msg, mapping="protobuf", names=names, keep=("id",)).orderBy("id").collect()
    for r, m in zip(rows, msgs):
        want = json_format.MessageToJson(m, preserving_proto_field_name=names == "proto")
        assert json.loads(r["content"]) == json.loads(want), (r["content"], want)


def test_nested_lists_maps_and_recursion(spark):
    msg, rng = message(), random.Random(8)
    cls = message_class(*msg)
    check(spark, msg, [fill(cls, rng) for _ in range(40)])


def test_scalars_without_presence(spark):
    kinds = ["int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64",
             "double", "float", "bool", "string", "bytes"]
    fdp = descriptor_pb2.FileDescriptorProto(name="s.proto", package="s", syntax="proto3")
    m = fdp.message_type.add(name="M")
    for i, k in enumerate(kinds, 1):
        m.field.add(name=f"one_{k}", number=i, type=D._SCALARS[k], label=FDP.LABEL_OPTIONAL)
        m.field.add(name=f"all_{k}", number=i + 100, type=D._SCALARS[k], label=FDP.LABEL_REPEATED)
    msg = (D.descriptor_set(fdp), "s.M")
    cls, msgs = message_class(*msg), []
    for values in ({}, {"string": "é\"\\\n", "bytes": b"\x00\xff", "bool": True, "double": -0.5, "float": 2.5, "uint64": 2**64 - 1,
                        "int64": -2**63, "fixed64": 2**63, "uint32": 2**32 - 1, "sint32": -7},
                   {k: 0 for k in kinds[:12]}):
        x = cls()
        for k, v in values.items():
            setattr(x, f"one_{k}", v)
            getattr(x, f"all_{k}").extend([v, v])
        msgs.append(x)
    check(spark, msg, msgs)
    check(spark, msg, msgs, names="proto")


def test_times_wrappers_and_objects(spark):
    cls = message_class(*D.order_msg())
    full = cls(order_key=1)
    for f in cls.DESCRIPTOR.fields:
        if f.message_type is not None and not f.is_repeated and f.message_type.full_name.endswith("Value"):
            try:
                getattr(full, f.name).value = 0
                getattr(full, f.name).SetInParent()
            except (TypeError, AttributeError):
                pass
    full.attrs.update({"a": [1, "x", None, {"b": True}], "n": 1.5})
    check(spark, D.order_msg(), [full, cls()])
    view = message_class(*D.view_record())(view_id="v")
    view.view_start.seconds, view.view_start.nanos = -1, 500_000_000
    e = view.events.add(type="t")
    e.playhead_time.seconds, e.playhead_time.nanos = -1, -250_000_000
    check(spark, D.view_record(), [view])
