"""Schema compatibility verdicts, and the registry log under several writers."""
import json
import os
import threading

import pytest
from google.protobuf import descriptor_pb2
from pyspark.sql import functions as F

from protoflow._session import create_once, new_scratch, read_small, small_files
from protoflow.functions import compat as C
from protoflow.functions import descriptors as D
from protoflow.functions.descriptors import FDP, message_class
from protoflow.operators import registry as RG
from protoflow.operators.registry import (RegistryLog, decode_registered, empty_registry, encode_registered, register_schema,
                                          registry_snapshot)
from protoflow.sources import fixtures as FX


def schema(build, syntax="proto2", package="t"):
    fdp = descriptor_pb2.FileDescriptorProto(name="t.proto", package=package, syntax=syntax)
    build(fdp, fdp.message_type.add(name="M"))
    return D.descriptor_set(fdp), f"{package}.M"


def one(type_, label=FDP.LABEL_OPTIONAL, number=1, name="x", syntax="proto2", **kw):
    def build(fdp, m):
        f = m.field.add(name=name, number=number, type=type_, label=label)
        if type_ == FDP.TYPE_ENUM:
            e = fdp.enum_type.add(name="E")
            for i in kw.get("values", (0, 1)):
                e.value.add(name=f"V{i}", number=i)
            f.type_name = ".t.E"
        if type_ == FDP.TYPE_MESSAGE:
            inner = fdp.message_type.add(name="In")
            inner.field.add(name="y", number=1, type=kw.get("inner", FDP.TYPE_INT32), label=FDP.LABEL_OPTIONAL)
            f.type_name = ".t.In"
    return schema(build, syntax)


REP = FDP.LABEL_REPEATED
VERDICTS = [
    (one(FDP.TYPE_INT32), one(FDP.TYPE_INT64), "backward", "", "range"),
    (one(FDP.TYPE_UINT32), one(FDP.TYPE_INT32), "none", "range", "range"),
    (one(FDP.TYPE_BOOL), one(FDP.TYPE_INT64), "backward", "", "range"),
    (one(FDP.TYPE_SINT32), one(FDP.TYPE_INT32), "none", "type", "type"),
    (one(FDP.TYPE_FIXED32), one(FDP.TYPE_SFIXED32), "none", "range", "range"),
    (one(FDP.TYPE_FLOAT), one(FDP.TYPE_DOUBLE), "none", "type", "type"),
    (one(FDP.TYPE_STRING), one(FDP.TYPE_BYTES), "backward", "", "range"),
    (one(FDP.TYPE_MESSAGE), one(FDP.TYPE_BYTES), "backward", "", "type"),
    (one(FDP.TYPE_MESSAGE), one(FDP.TYPE_MESSAGE, inner=FDP.TYPE_STRING), "none", "type", "type"),
    (one(FDP.TYPE_STRING), one(FDP.TYPE_STRING, REP), "backward", "", "repeated"),
    (one(FDP.TYPE_ENUM), one(FDP.TYPE_ENUM, values=(0, 1, 2)), "backward", "", "enum"),
    (one(FDP.TYPE_ENUM, syntax="proto3"), one(FDP.TYPE_ENUM, values=(0, 1, 2), syntax="proto3"), "full", "", ""),
    (one(FDP.TYPE_ENUM), one(FDP.TYPE_INT32), "backward", "", "enum"),
    (one(FDP.TYPE_STRING), one(FDP.TYPE_STRING, number=2), "none", "moved", "moved"),
    (one(FDP.TYPE_STRING), one(FDP.TYPE_STRING, name="y"), "full", "", ""),
    (one(FDP.TYPE_STRING, FDP.LABEL_REQUIRED), one(FDP.TYPE_STRING), "backward", "", "required"),
]


@pytest.mark.parametrize("old, new, level, back, ahead", VERDICTS)
def test_verdicts(old, new, level, back, ahead):
    got = C.compatibility(old, new)
    assert (got[0], ",".join(i.kind for i in got[1]), ",".join(i.kind for i in got[2])) == (level, back, ahead)
    assert C.compatibility(old, old)[0] == "full"


def test_oneof_reserved_and_recursion():
    def pair(one_of):
        def build(fdp, m):
            if one_of:
                m.oneof_decl.add(name="o")
            for i, n in enumerate("ab", 1):
                f = m.field.add(name=n, number=i, type=FDP.TYPE_STRING, label=FDP.LABEL_OPTIONAL)
                if one_of:
                    f.oneof_index = 0
            m.field.add(name="self", number=9, type=FDP.TYPE_MESSAGE, label=FDP.LABEL_OPTIONAL, type_name=".t.M")
        return schema(build)

    level, back, ahead = C.compatibility(pair(False), pair(True))
    assert (level, [i.kind for i in back], ahead) == ("forward", ["oneof", "oneof"], [])

    def reserve(fdp, m):
        m.reserved_range.add(start=1, end=3)
    level, back, _ = C.compatibility(one(FDP.TYPE_STRING), schema(reserve))
    assert [i.kind for i in back] == ["reserved"]
    assert "tag 1" in str(pytest.raises(C.IncompatibleSchema, C.require, "backward", one(FDP.TYPE_STRING), schema(reserve)).value)


def test_verdicts_agree_with_the_library():
    """What a walk calls readable is read without loss, for the largest values of each whole-number type."""
    kinds = {FDP.TYPE_INT32: [-2**31, 2**31 - 1], FDP.TYPE_INT64: [-2**63, 2**63 - 1], FDP.TYPE_UINT32: [0, 2**32 - 1],
             FDP.TYPE_UINT64: [0, 2**64 - 1], FDP.TYPE_BOOL: [False, True], FDP.TYPE_SINT32: [-2**31, 2**31 - 1],
             FDP.TYPE_SINT64: [-2**63, 2**63 - 1], FDP.TYPE_FIXED32: [0, 2**32 - 1], FDP.TYPE_SFIXED32: [-2**31, 2**31 - 1],
             FDP.TYPE_FIXED64: [0, 2**64 - 1], FDP.TYPE_SFIXED64: [-2**63, 2**63 - 1]}
    for a, values in kinds.items():
        for b in kinds:
            w, r = message_class(*one(a)), message_class(*one(b))
            same = all(r.FromString(w(x=v).SerializeToString()).x == v for v in values)
            assert same == (not C.reading_issues(w.DESCRIPTOR, r.DESCRIPTOR)), (a, b)


def test_fingerprint_is_of_the_message_alone():
    def build(extra):
        def inner(fdp, m):
            m.field.add(name="x", number=1, type=FDP.TYPE_STRING, label=FDP.LABEL_OPTIONAL)
            if extra:
                fdp.message_type.add(name="Other").field.add(name="z", number=1, type=FDP.TYPE_INT32, label=FDP.LABEL_OPTIONAL)
        return inner
    assert C.closure_fingerprint(*schema(build(False))) == C.closure_fingerprint(*schema(build(True)))
    prints = {C.closure_fingerprint(*s) for v in VERDICTS for s in v[:2]}
    assert len(prints) >= 20 and C.closure_fingerprint(*D.event_msg(1)) != C.closure_fingerprint(*D.event_msg(2))


def test_create_once(spark):
    uri = f"{new_scratch(spark, 'once')}/a/1.json"
    assert create_once(spark, uri, b"first") and not create_once(spark, uri, b"second")
    assert read_small(spark, uri) == b"first" and len(small_files(spark, uri.rsplit("/", 1)[0])) == 1
    assert small_files(spark, uri + "-none") == []


def test_two_writers_never_share_an_id(spark):
    log = RegistryLog(spark, new_scratch(spark, "registry"))
    schemas = [one(FDP.TYPE_STRING, name=f"f{i}") for i in range(6)]
    found: list = []

    def work(part):
        mine = RegistryLog(spark, log.path)
        for s in part:
            found.append((s[0], mine.register("s", s)))

    threads = [threading.Thread(target=work, args=(p,)) for p in (schemas[:4], schemas[2:], schemas[::-1])]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ids = {}
    for ds, sid in found:
        assert ids.setdefault(ds, sid) == sid                      # one schema, one id, whoever registers it
    assert sorted(ids.values()) == [1, 2, 3, 4, 5, 6]
    rows = log.load().orderBy("schema_id").collect()
    assert [(r["schema_id"], r["version"]) for r in rows] == [(i, i) for i in range(1, 7)]
    assert {r["schema_id"]: bytes(r["descriptor_set"]) for r in rows} == {v: k for k, v in ids.items()}


def test_a_taken_id_is_not_taken_again(spark):
    log = RegistryLog(spark, new_scratch(spark, "registry"))
    assert log.load().count() == 0
    assert log.register("a", D.event_msg(1)) == 1
    real, lost = RG.create_once, []

    def late(spark, uri, data):                                     # another writer gets id 2 first
        if not lost:
            other = json.loads(data) | {"subject": "other", "version": 1}
            lost.append(real(spark, uri, json.dumps(other).encode()))
        return real(spark, uri, data)

    RG.create_once = late
    try:
        assert log.register("a", D.event_msg(2)) == 3
    finally:
        RG.create_once = real
    assert log.register("a", D.event_msg(2)) == 3
    assert [(r["subject"], r["version"]) for r in log.load().orderBy("schema_id").collect()] == [("a", 1), ("other", 1), ("a", 2)]


def test_register_checks_the_newest_version(spark):
    log = RegistryLog(spark, new_scratch(spark, "registry"))
    log.register("s", one(FDP.TYPE_INT32))
    assert log.register("s", one(FDP.TYPE_INT64), compatibility="backward") == 2
    with pytest.raises(C.IncompatibleSchema, match="range"):
        log.register("s", one(FDP.TYPE_INT32, name="z"), compatibility="full")
    reg, _ = register_schema(empty_registry(spark), "s", one(FDP.TYPE_INT32))
    with pytest.raises(C.IncompatibleSchema, match="type"):
        register_schema(reg, "s", one(FDP.TYPE_STRING), compatibility="forward")
    with pytest.raises(ValueError, match="level"):
        C.require("some", one(FDP.TYPE_INT32), one(FDP.TYPE_INT32))


def test_a_registry_too_large_for_a_task(spark, sf_small, monkeypatch):
    log = RegistryLog(spark, new_scratch(spark, "registry"))
    ids = [log.register("events-value", D.event_msg(1)), log.register("events-value", D.event_msg(2))]
    rows = FX.event_rows(spark, sf_small).limit(20).withColumn("w", F.lit(ids[0]))
    framed = encode_registered(rows, log.load(), schema_id=ids[0], keep=("event_id",))
    size = len(D.event_msg(1)[0]) + 100
    monkeypatch.setattr(RG, "MAX_REGISTRY_BYTES", size + 10)       # one schema fits, both do not
    with pytest.raises(ValueError, match="bytes"):
        registry_snapshot(log.load())
    dec = decode_registered(framed.withColumnRenamed("event_id", "src"), log.load(), D.event_msg(2), keep=("src",))
    assert dec.where("src = event_id").count() == 20               # only the id in use was shipped
    mixed = encode_registered(rows, log.load(), schema_id="w")
    assert mixed.count() == 20
    assert os.path.isdir(log.path.replace("file:", ""))
