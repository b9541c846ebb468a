"""Message definitions as ``FileDescriptorSet`` bytes, and per-process class cache.

Descriptors travel to executors as serialized bytes (a few KB) captured by the
task closure; every Python worker rebuilds the message classes once in a
private ``DescriptorPool``, so two versions of one message name never meet.
No ``protoc`` is needed: the files are assembled with ``descriptor_pb2``.
"""

from __future__ import annotations

import hashlib
import threading

from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
from google.protobuf import duration_pb2, struct_pb2, timestamp_pb2, wrappers_pb2, any_pb2

FDP = descriptor_pb2.FieldDescriptorProto

_SCALARS = {
    "double": FDP.TYPE_DOUBLE, "float": FDP.TYPE_FLOAT, "int64": FDP.TYPE_INT64,
    "uint64": FDP.TYPE_UINT64, "int32": FDP.TYPE_INT32, "fixed64": FDP.TYPE_FIXED64,
    "fixed32": FDP.TYPE_FIXED32, "bool": FDP.TYPE_BOOL, "string": FDP.TYPE_STRING,
    "bytes": FDP.TYPE_BYTES, "uint32": FDP.TYPE_UINT32, "sfixed32": FDP.TYPE_SFIXED32,
    "sfixed64": FDP.TYPE_SFIXED64, "sint32": FDP.TYPE_SINT32, "sint64": FDP.TYPE_SINT64,
}
_LABELS = {"optional": FDP.LABEL_OPTIONAL, "required": FDP.LABEL_REQUIRED,
           "repeated": FDP.LABEL_REPEATED}

# Well-known types by short alias, with the file that defines each.
_WKT = {
    "Timestamp": (".google.protobuf.Timestamp", timestamp_pb2),
    "Duration": (".google.protobuf.Duration", duration_pb2),
    "Struct": (".google.protobuf.Struct", struct_pb2),
    "Any": (".google.protobuf.Any", any_pb2),
    "DoubleValue": (".google.protobuf.DoubleValue", wrappers_pb2),
    "FloatValue": (".google.protobuf.FloatValue", wrappers_pb2),
    "Int64Value": (".google.protobuf.Int64Value", wrappers_pb2),
    "UInt64Value": (".google.protobuf.UInt64Value", wrappers_pb2),
    "Int32Value": (".google.protobuf.Int32Value", wrappers_pb2),
    "UInt32Value": (".google.protobuf.UInt32Value", wrappers_pb2),
    "BoolValue": (".google.protobuf.BoolValue", wrappers_pb2),
    "StringValue": (".google.protobuf.StringValue", wrappers_pb2),
    "BytesValue": (".google.protobuf.BytesValue", wrappers_pb2),
}


def _parse_lines(text: str) -> list[tuple[int, str, str, str]]:
    """``tag label type name`` lines -> tuples (a fixed-value table, not a grammar)."""
    out = []
    for line in text.strip().splitlines():
        tag, label, ftype, name = line.split()
        out.append((int(tag), label, ftype, name))
    return out


# ---------------------------------------------------------------------------
# The published view-record message (proto2, package
# eventstream), in declaration order: tag, label, type, field name.
# ---------------------------------------------------------------------------
VIEW_RECORD_FIELDS = _parse_lines("""
1 required string view_id
2 required string property_id
3 required Timestamp view_start
4 required Timestamp view_end
5 repeated Event events
6 optional int32 asn
7 optional string browser
8 optional string browser_version
9 optional string cdn
10 optional string city
11 optional string continent_code
12 optional string country
13 optional string country_name
14 optional string custom_1
15 optional string custom_2
16 optional string custom_3
17 optional string custom_4
18 optional string custom_5
19 optional int32 error_type
20 optional bool exit_before_video_start
21 optional string experiment_name
22 optional double latitude
23 optional double longitude
24 optional float max_downscale_percentage
25 optional float max_upscale_percentage
26 optional string mux_api_version
27 optional string mux_embed_version
28 optional string mux_viewer_id
29 optional string operating_system
30 optional string operating_system_version
31 optional int32 page_load_time
32 optional string page_type
33 optional string page_url
34 optional float playback_success_score
35 optional bool player_autoplay
36 optional string player_error_code
37 optional string player_error_message
38 optional int32 player_height
39 optional string player_instance_id
40 optional string player_language
41 optional string player_mux_plugin_name
42 optional string player_mux_plugin_version
43 optional string player_name
44 optional string player_poster
45 optional bool player_preload
46 optional bool player_remote_played
47 optional string player_software
48 optional string player_software_version
49 optional string player_source_domain
50 optional int64 player_source_duration
51 optional int32 player_source_height
52 optional string player_source_url
53 optional int32 player_source_width
54 optional int32 player_startup_time
55 optional string player_version
56 optional int32 player_view_count
57 optional int32 player_width
58 optional int32 rebuffer_count
59 optional int32 rebuffer_duration
60 optional float rebuffer_frequency
61 optional float rebuffer_percentage
62 optional string region
63 optional string session_id
64 optional float smoothness_score
65 optional string source_hostname
66 optional string source_type
67 optional float startup_time_score
68 optional string sub_property_id
69 optional bool used_fullscreen
70 optional string video_content_type
71 optional int32 video_duration
72 optional string video_encoding_variant
73 optional string video_id
74 optional string video_language
75 optional string video_producer
76 optional float video_quality_score
77 optional string video_series
78 optional int32 video_startup_time
79 optional string video_title
80 optional string video_variant_id
81 optional string video_variant_name
82 optional float view_downscaling_percentage
83 optional int64 view_max_playhead_position
84 optional int64 view_playing_time
85 optional int32 view_seek_count
86 optional int32 view_seek_duration
87 optional string view_session_id
88 optional int32 view_total_content_playback_time
89 optional float view_total_downscaling
90 optional float view_total_upscaling
91 optional float view_upscaling_percentage
92 optional string viewer_application_engine
93 optional string viewer_connection_type
94 optional string viewer_device_category
95 optional string viewer_device_manufacturer
96 optional string viewer_device_name
97 optional float viewer_experience_score
98 optional string viewer_os_architecture
99 optional string viewer_user_agent
100 optional string viewer_user_id
101 optional int32 watch_time
102 optional bool watched
103 optional double weighted_average_bitrate
104 optional string preroll_ad_asset_hostname
105 optional string preroll_ad_tag_hostname
106 optional bool preroll_played
107 optional bool preroll_requested
108 optional int32 requests_for_first_preroll
109 optional int32 video_startup_preroll_load_time
110 optional int32 video_startup_preroll_request_time
111 optional int32 max_request_latency
112 optional int32 request_latency
113 optional int32 request_throughput
114 optional string stream_type
""")

# The nested event messages of the same file (declaration order).
EVENT_FIELDS = _parse_lines("""
7 required uint64 sequence_number
1 required Timestamp server_time
2 required Timestamp viewer_time
3 required Duration playhead_time
4 required string type
5 optional OrientationInfo orientation_info
6 optional RenditionInfo rendition_info
""")
ORIENTATION_FIELDS = _parse_lines("""
1 required double x
2 required double y
3 required double z
""")
RENDITION_FIELDS = _parse_lines("""
1 optional int64 width
2 optional int64 height
3 optional double fps
4 optional int64 bitrate
""")

# Fields the newer view message adds (proto2, video_view.v1).
VIDEO_VIEW_ADDED_FIELDS = _parse_lines("""
116 optional string asset_id
117 optional string live_stream_id
118 optional string playback_id
119 optional int32 live_stream_latency
120 optional string environment_id
121 optional string viewer_device_model
122 optional string mux_embed
""")

# The two small demo messages (proto3).
SIMPLE_MESSAGE_FIELDS = _parse_lines("""
1 optional string name
2 optional int64 quantity
3 optional float measure
""")
APP_EVENT_FIELDS = _parse_lines("""
1 optional string name
2 optional int64 id
3 optional string context
""")

# Our own fixture messages, built from the driver's tables (not from the reference).
EVENT_MSG_FIELDS = _parse_lines("""
1 required int64 event_id
2 required Timestamp ts
3 optional int64 user_id
4 optional string event_type
5 optional double value
6 optional string props
""")
EVENT_MSG_V2_EXTRA = _parse_lines("""
7 optional string source
""")


def _resolve(ftype: str, scope: dict[str, str]) -> tuple[int, str | None]:
    if ftype in _SCALARS:
        return _SCALARS[ftype], None
    if ftype in scope:
        kind, full = scope[ftype].split(":", 1)
        return (FDP.TYPE_ENUM if kind == "enum" else FDP.TYPE_MESSAGE), full
    if ftype in _WKT:
        return FDP.TYPE_MESSAGE, _WKT[ftype][0]
    raise KeyError(f"unknown field type {ftype!r}")


def _add_fields(msg: descriptor_pb2.DescriptorProto, fields, scope, syntax: str = "proto2",
                oneofs: dict[str, list[str]] | None = None) -> None:
    oneof_of = {}
    for i, (oname, members) in enumerate((oneofs or {}).items()):
        msg.oneof_decl.add(name=oname)
        for m in members:
            oneof_of[m] = i
    for tag, label, ftype, name in fields:
        f = msg.field.add(name=name, number=tag)
        f.type, tn = _resolve(ftype, scope)
        if tn:
            f.type_name = tn
        f.label = _LABELS[label]
        if name in oneof_of:
            f.oneof_index = oneof_of[name]


def _map_entry(parent: descriptor_pb2.DescriptorProto, field_name: str, ktype: str, vtype: str,
               scope: dict[str, str], tag: int) -> None:
    entry_name = "".join(p.capitalize() for p in field_name.split("_")) + "Entry"
    entry = parent.nested_type.add(name=entry_name)
    entry.options.map_entry = True
    k = entry.field.add(name="key", number=1, label=FDP.LABEL_OPTIONAL)
    k.type, _ = _resolve(ktype, scope)
    v = entry.field.add(name="value", number=2, label=FDP.LABEL_OPTIONAL)
    v.type, tn = _resolve(vtype, scope)
    if tn:
        v.type_name = tn
    f = parent.field.add(name=field_name, number=tag, label=FDP.LABEL_REPEATED,
                         type=FDP.TYPE_MESSAGE)
    f.type_name = f"{scope['__self__']}.{entry_name}"


def _wkt_deps(*modules) -> list[descriptor_pb2.FileDescriptorProto]:
    out = []
    for mod in modules:
        fdp = descriptor_pb2.FileDescriptorProto()
        fdp.ParseFromString(mod.DESCRIPTOR.serialized_pb)
        out.append(fdp)
    return out


def _file_set(files: list[descriptor_pb2.FileDescriptorProto]) -> bytes:
    fds = descriptor_pb2.FileDescriptorSet()
    seen = set()
    for f in files:
        if f.name not in seen:
            fds.file.add().CopyFrom(f)
            seen.add(f.name)
    return fds.SerializeToString(deterministic=True)


def event_stream_file() -> descriptor_pb2.FileDescriptorProto:
    """The older view record and its event messages (package ``eventstream``)."""
    fdp = descriptor_pb2.FileDescriptorProto(name="eventstream/event_stream.proto",
                                             package="eventstream", syntax="proto2")
    fdp.dependency.extend(["google/protobuf/duration.proto", "google/protobuf/timestamp.proto"])
    scope = {n: f"msg:.eventstream.{n}" for n in ("Event", "OrientationInfo", "RenditionInfo")}
    _add_fields(fdp.message_type.add(name="ExternalVideoViewRecord"), VIEW_RECORD_FIELDS, scope, "proto2")
    _add_fields(fdp.message_type.add(name="Event"), EVENT_FIELDS, scope, "proto2",
                oneofs={"info": ["orientation_info", "rendition_info"]})
    _add_fields(fdp.message_type.add(name="OrientationInfo"), ORIENTATION_FIELDS, scope, "proto2")
    _add_fields(fdp.message_type.add(name="RenditionInfo"), RENDITION_FIELDS, scope, "proto2")
    return fdp


def video_view_file() -> descriptor_pb2.FileDescriptorProto:
    """The newer view record: own nested Timestamp/Duration, no oneof, tags 116-122."""
    fdp = descriptor_pb2.FileDescriptorProto(name="video_view/v1/video_view.proto",
                                             package="video_view.v1", syntax="proto2")
    base = ".video_view.v1.VideoView"
    scope = {n: f"msg:{base}.{n}" for n in
             ("Event", "OrientationInfo", "RenditionInfo", "Timestamp", "Duration")}
    vv = fdp.message_type.add(name="VideoView")
    _add_fields(vv, VIEW_RECORD_FIELDS + VIDEO_VIEW_ADDED_FIELDS, scope, "proto2")
    vv.reserved_range.add(start=115, end=116)
    vv.reserved_range.add(start=200, end=300)
    clock = _parse_lines("""
1 optional int64 seconds
2 optional int32 nanos
""")
    _add_fields(vv.nested_type.add(name="Duration"), clock, scope, "proto2")
    _add_fields(vv.nested_type.add(name="Timestamp"), clock, scope, "proto2")
    _add_fields(vv.nested_type.add(name="OrientationInfo"), ORIENTATION_FIELDS, scope, "proto2")
    _add_fields(vv.nested_type.add(name="RenditionInfo"), RENDITION_FIELDS, scope, "proto2")
    _add_fields(vv.nested_type.add(name="Event"), EVENT_FIELDS, scope, "proto2")
    return fdp


def simple_file() -> descriptor_pb2.FileDescriptorProto:
    fdp = descriptor_pb2.FileDescriptorProto(name="example/example.proto", package="example",
                                             syntax="proto3")
    _plain3(fdp.message_type.add(name="SimpleMessage"), SIMPLE_MESSAGE_FIELDS)
    return fdp


def app_event_file() -> descriptor_pb2.FileDescriptorProto:
    fdp = descriptor_pb2.FileDescriptorProto(name="app_event.proto", syntax="proto3")
    _plain3(fdp.message_type.add(name="AppEvent"), APP_EVENT_FIELDS)
    return fdp


def _plain3(msg, fields) -> None:
    """proto3 fields without ``optional`` (no presence)."""
    for tag, _label, ftype, name in fields:
        f = msg.field.add(name=name, number=tag, label=FDP.LABEL_OPTIONAL)
        f.type, _ = _resolve(ftype, {})


def event_msg_file(version: int = 1) -> descriptor_pb2.FileDescriptorProto:
    """Fixture message: one row of ``events`` (v2 adds ``source``, same full name)."""
    fdp = descriptor_pb2.FileDescriptorProto(name=f"protoflow/fixtures/event_msg_v{version}.proto",
                                             package="protoflow.fixtures", syntax="proto2")
    fdp.dependency.append("google/protobuf/timestamp.proto")
    fields = EVENT_MSG_FIELDS + (EVENT_MSG_V2_EXTRA if version >= 2 else [])
    _add_fields(fdp.message_type.add(name="EventMsg"), fields, {}, "proto2")
    return fdp


def order_msg_file() -> descriptor_pb2.FileDescriptorProto:
    """Fixture message over ``orders`` exercising the wide type map (proto3)."""
    fdp = descriptor_pb2.FileDescriptorProto(name="protoflow/fixtures/order_msg.proto",
                                             package="protoflow.fixtures", syntax="proto3")
    fdp.dependency.extend(["google/protobuf/timestamp.proto", "google/protobuf/wrappers.proto",
                           "google/protobuf/struct.proto"])
    status = fdp.enum_type.add(name="OrderStatus")
    for i, n in enumerate(["STATUS_UNSPECIFIED", "F", "O", "P"]):
        status.value.add(name=n, number=i)
    prio = fdp.enum_type.add(name="Priority")
    for i, n in enumerate(["PRIORITY_UNSPECIFIED", "URGENT", "HIGH", "MEDIUM", "NOT_SPECIFIED", "LOW"]):
        prio.value.add(name=n, number=i)
    scope = {"OrderStatus": "enum:.protoflow.fixtures.OrderStatus",
             "Priority": "enum:.protoflow.fixtures.Priority",
             "__self__": ".protoflow.fixtures.OrderMsg"}
    msg = fdp.message_type.add(name="OrderMsg")
    plain = _parse_lines("""
1 optional int64 order_key
2 optional OrderStatus status
3 optional Priority priority
4 optional uint32 cust_key
5 optional uint64 order_key_u64
6 optional bytes priority_bytes
7 optional DoubleValue total_price
8 optional StringValue status_text
9 optional sint64 neg_key
10 optional fixed32 cust_fixed
11 optional float price_f
12 optional Timestamp order_date
13 repeated int64 key_parts
14 optional Struct attrs
""")
    for tag, label, ftype, name in plain:
        f = msg.field.add(name=name, number=tag,
                          label=FDP.LABEL_REPEATED if label == "repeated" else FDP.LABEL_OPTIONAL)
        f.type, tn = _resolve(ftype, scope)
        if tn:
            f.type_name = tn
    _map_entry(msg, "counters", "string", "int64", scope, 15)
    return fdp


def descriptor_set(*files: descriptor_pb2.FileDescriptorProto) -> bytes:
    """Serialized ``FileDescriptorSet`` with the well-known dependencies first."""
    deps = _wkt_deps(timestamp_pb2, duration_pb2, wrappers_pb2, struct_pb2, any_pb2)
    return _file_set(deps + list(files))


# Convenience constants: (descriptor_set bytes, full message name).
def view_record() -> tuple[bytes, str]:
    return descriptor_set(event_stream_file()), "eventstream.ExternalVideoViewRecord"


def video_view() -> tuple[bytes, str]:
    return descriptor_set(video_view_file()), "video_view.v1.VideoView"


def simple_message() -> tuple[bytes, str]:
    return descriptor_set(simple_file()), "example.SimpleMessage"


def app_event() -> tuple[bytes, str]:
    return descriptor_set(app_event_file()), "AppEvent"


def event_msg(version: int = 1) -> tuple[bytes, str]:
    return descriptor_set(event_msg_file(version)), "protoflow.fixtures.EventMsg"


def order_msg() -> tuple[bytes, str]:
    return descriptor_set(order_msg_file()), "protoflow.fixtures.OrderMsg"


# ---------------------------------------------------------------------------
# Per-process class cache (executors rebuild classes from bytes once per worker).
# ---------------------------------------------------------------------------
_CACHE: dict[tuple[str, str], type] = {}
_LOCK = threading.RLock()


def fingerprint(desc_set: bytes) -> str:
    return hashlib.sha1(desc_set).hexdigest()


def message_class(desc_set: bytes, message: str):
    """Message class for ``message`` in a private pool built from ``desc_set``."""
    key = (fingerprint(desc_set), message)
    cls = _CACHE.get(key)
    if cls is None:
        with _LOCK:
            cls = _CACHE.get(key)
            if cls is None:
                fds = descriptor_pb2.FileDescriptorSet()
                fds.ParseFromString(desc_set)
                pool = descriptor_pool.DescriptorPool()
                for f in fds.file:
                    pool.Add(f)
                cls = message_factory.GetMessageClass(pool.FindMessageTypeByName(message))
                _CACHE[key] = cls
    return cls


def message_descriptor(desc_set: bytes, message: str):
    return message_class(desc_set, message).DESCRIPTOR


def pruned_class(desc_set: bytes, message: str, selection: dict):
    """Class of a copy of ``message`` that declares only the selected fields.

    ``selection`` maps proto field names to ``None`` (the whole field) or to a nested
    selection of the field's message type.  Parsing with the copy leaves every other
    tag as raw unknown bytes, so unselected subtrees (e.g. the timestamps inside a long
    event list) are never built into message objects.  Pruned copies keep names,
    numbers and types; they are added to the files that define the originals.
    Cached per worker like ``message_class``.
    """
    key = (fingerprint(desc_set), message, "prune:" + repr(_canonical(selection)))
    cls = _CACHE.get(key)
    if cls is not None:
        return cls
    with _LOCK:
        cls = _CACHE.get(key)
        if cls is not None:
            return cls
        root = message_descriptor(desc_set, message)
        fds = descriptor_pb2.FileDescriptorSet()
        fds.ParseFromString(desc_set)
        files = {f.name: f for f in fds.file}
        made: dict = {}
        new_root = _prune_type(root, selection, files, made)
        pool = descriptor_pool.DescriptorPool()
        for f in fds.file:
            pool.Add(f)
        cls = message_factory.GetMessageClass(pool.FindMessageTypeByName(new_root.lstrip(".")))
        _CACHE[key] = cls
    return cls


def _canonical(sel):
    if sel is None:
        return None
    return tuple(sorted((k, _canonical(v)) for k, v in sel.items()))


def _source_proto(fdp, desc):
    rel = desc.full_name[len(fdp.package) + 1:] if fdp.package else desc.full_name
    scope, src = fdp.message_type, None
    for part in rel.split("."):
        src = next(m for m in scope if m.name == part)
        scope = src.nested_type
    return rel, src


def _prune_type(desc, selection: dict, files: dict, made: dict) -> str:
    """Add a pruned copy of ``desc`` to its file; returns its full type name ('.pkg.Name')."""
    key = (desc.full_name, repr(_canonical(selection)))
    if key in made:
        return made[key]
    fdp = files[desc.file.name]
    rel, src = _source_proto(fdp, desc)
    suffix = hashlib.sha1(repr(key).encode()).hexdigest()[:10]
    msg = fdp.message_type.add()
    msg.name = f"{rel.replace('.', '_')}_Pruned{suffix}"
    pkg = f"{fdp.package}." if fdp.package else ""
    made[key] = full = f".{pkg}{msg.name}"
    oneof_map: dict = {}
    for fld in src.field:
        if fld.name not in selection:
            continue
        nf = msg.field.add()
        nf.CopyFrom(fld)
        if fld.HasField("oneof_index"):
            if fld.oneof_index not in oneof_map:
                oneof_map[fld.oneof_index] = len(msg.oneof_decl)
                msg.oneof_decl.add().CopyFrom(src.oneof_decl[fld.oneof_index])
            nf.oneof_index = oneof_map[fld.oneof_index]
        fd = desc.fields_by_name[fld.name]
        if fd.message_type is not None and fd.message_type.GetOptions().map_entry:
            # a map's entry type must be nested in the message holding the map: copy it along
            entry = next(n for n in src.nested_type if n.name == fd.message_type.name)
            msg.nested_type.add().CopyFrom(entry)
            nf.type_name = f"{full}.{entry.name}"
        elif fd.message_type is not None and selection[fld.name] is not None:
            nf.type_name = _prune_type(fd.message_type, selection[fld.name], files, made)
    return full


def shallow_class(desc_set: bytes, message: str):
    """Class of a copy of a proto2 ``message`` whose message-typed fields are declared as
    ``bytes`` (same tags, same length-delimited wire type): parsing it never builds a
    nested object, enough to see which top-level fields are set.  proto3 messages
    (where an empty ``bytes`` would lose presence) get the ordinary class."""
    root = message_descriptor(desc_set, message)
    key = (fingerprint(desc_set), message, "shallow")
    cls = _CACHE.get(key)
    if cls is not None:
        return cls
    with _LOCK:
        cls = _CACHE.get(key)
        if cls is not None:
            return cls
        fds = descriptor_pb2.FileDescriptorSet()
        fds.ParseFromString(desc_set)
        files = {f.name: f for f in fds.file}
        fdp = files[root.file.name]
        if fdp.syntax not in ("", "proto2"):
            cls = message_class(desc_set, message)
            _CACHE[key] = cls
            return cls
        rel, src = _source_proto(fdp, root)
        msg = fdp.message_type.add()
        msg.CopyFrom(src)
        msg.name = f"{rel.replace('.', '_')}_Shallow"
        del msg.nested_type[:]
        del msg.enum_type[:]
        for f in msg.field:
            if f.type == FDP.TYPE_MESSAGE:          # enums keep their (absolute) type names
                f.type = FDP.TYPE_BYTES
                f.ClearField("type_name")
        pool = descriptor_pool.DescriptorPool()
        for f in fds.file:
            pool.Add(f)
        pkg = f"{fdp.package}." if fdp.package else ""
        cls = message_factory.GetMessageClass(pool.FindMessageTypeByName(pkg + msg.name))
        _CACHE[key] = cls
    return cls
