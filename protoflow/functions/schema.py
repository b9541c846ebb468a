"""Descriptor -> Spark schema (the type map), shared by decode and encode.

``build_plan`` turns a message descriptor plus options into a small tree of
``Node`` objects; ``spark_schema`` reads the Spark types off that tree and the
codec walks the same tree to build Arrow columns.  Everything here runs on the
driver once per query, or once per task when a decoder is rebuilt from bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from google.protobuf.descriptor import FieldDescriptor as FD
from pyspark.sql import types as T

from .descriptors import message_descriptor

_INT32 = {FD.TYPE_INT32, FD.TYPE_SINT32, FD.TYPE_SFIXED32}
_INT64 = {FD.TYPE_INT64, FD.TYPE_SINT64, FD.TYPE_SFIXED64}
_UINT32 = {FD.TYPE_UINT32, FD.TYPE_FIXED32}
_UINT64 = {FD.TYPE_UINT64, FD.TYPE_FIXED64}

WRAPPERS = {
    "google.protobuf.DoubleValue": T.DoubleType(), "google.protobuf.FloatValue": T.FloatType(),
    "google.protobuf.Int64Value": T.LongType(), "google.protobuf.UInt64Value": T.LongType(),
    "google.protobuf.Int32Value": T.IntegerType(), "google.protobuf.UInt32Value": T.LongType(),
    "google.protobuf.BoolValue": T.BooleanType(), "google.protobuf.StringValue": T.StringType(),
    "google.protobuf.BytesValue": T.BinaryType(),
}
JSON_TYPES = {"google.protobuf.Struct", "google.protobuf.Value", "google.protobuf.ListValue",
              "google.protobuf.Any", "google.protobuf.FieldMask", "google.protobuf.Empty"}
TIMESTAMP = "google.protobuf.Timestamp"
DURATION = "google.protobuf.Duration"

PROTO_TYPE_NAMES = {
    FD.TYPE_DOUBLE: "double", FD.TYPE_FLOAT: "float", FD.TYPE_INT64: "int64",
    FD.TYPE_UINT64: "uint64", FD.TYPE_INT32: "int32", FD.TYPE_FIXED64: "fixed64",
    FD.TYPE_FIXED32: "fixed32", FD.TYPE_BOOL: "bool", FD.TYPE_STRING: "string",
    FD.TYPE_GROUP: "group", FD.TYPE_MESSAGE: "message", FD.TYPE_BYTES: "bytes",
    FD.TYPE_UINT32: "uint32", FD.TYPE_ENUM: "enum", FD.TYPE_SFIXED32: "sfixed32",
    FD.TYPE_SFIXED64: "sfixed64", FD.TYPE_SINT32: "sint32", FD.TYPE_SINT64: "sint64",
}


@dataclass(frozen=True)
class Options:
    """Decode/encode options (all have a reference-compatible setting)."""

    absent: str = "null"              # unset -> "null": NULL; "default": proto default; "primitive":
                                      # default, but messages and members of a oneof stay NULL; "set":
                                      # NULL also where a field without presence holds its default
    names: str = "proto"              # "proto" field names or "camel" (JSON names)
    enums: str = "name"               # "name" (string) or "int"
    uint64: str = "long"              # "long" (error >= 2^63) or "decimal" (DecimalType(20,0))
    timestamp: str = "timestamp"      # "timestamp" | "timestamp_ntz" | "string" | "epoch_seconds"
    duration: str = "interval"        # "interval" | "string" | "micros"
    oneof_case: bool = False          # add "<oneof>_case" string columns
    max_depth: int = 16               # nesting cut-off; deeper messages become JSON text
    max_recursion: int = 3            # so often a type is unfolded inside itself, then JSON text: with
                                      # several such fields each level multiplies the columns
    type_overrides: tuple = ()        # ((full_name, fn(message) -> value, DataType), ...)
    float_digits: int | None = None   # round float/double values to this many significant digits

    def __post_init__(self):
        checks = {"absent": ("null", "default", "primitive", "set"), "names": ("proto", "camel"),
                  "enums": ("name", "int"), "uint64": ("long", "decimal"),
                  "timestamp": ("timestamp", "timestamp_ntz", "string", "epoch_seconds"),
                  "duration": ("interval", "string", "micros")}
        for k, allowed in checks.items():
            if getattr(self, k) not in allowed:
                raise ValueError(f"{k}={getattr(self, k)!r}; expected one of {allowed}")
        if self.float_digits is not None and not (1 <= int(self.float_digits) <= 17):
            raise ValueError("float_digits must be between 1 and 17")
        if self.max_recursion < 1:
            raise ValueError("max_recursion must be 1 or more")


def make_options(type_overrides=None, **kw) -> Options:
    """Options from keyword arguments; ``type_overrides`` as {full_name: (fn, DataType)}."""
    ov = tuple((k, v[0], v[1]) for k, v in (type_overrides or {}).items())
    return Options(type_overrides=ov, **kw)


@dataclass
class Node:
    """One field of the output: how to read it from a message and its Spark type."""

    name: str                     # output column / struct field name
    attr: str                     # python attribute (proto field name)
    kind: str                     # scalar|enum|uint64|timestamp|duration|wrapper|json|message|map|override|oneof_case
    dtype: T.DataType             # Spark type of one element (not the array)
    repeated: bool = False
    presence: bool = False
    required: bool = False
    number: int = 0
    proto_type: str = ""
    default: Any = None
    children: list["Node"] = field(default_factory=list)
    key: "Node | None" = None     # map key
    value: "Node | None" = None   # map value
    enum_names: dict = field(default_factory=dict)
    enum_numbers: dict = field(default_factory=dict)
    fn: Callable | None = None    # override converter
    oneof: str | None = None
    in_oneof: bool = False        # member of a oneof, also of the implied one of a proto3 optional
    full_name: str = ""           # message full name (message-kind nodes)

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(self.dtype, True) if self.repeated else self.dtype

    def to_field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type, True)


def _selection(fields) -> dict | None:
    """Dotted paths -> nested dict; ``None`` leaf means "whole field"."""
    if fields is None:
        return None
    tree: dict = {}
    for path in fields:
        cur = tree
        parts = path.split(".")
        for i, p in enumerate(parts):
            if i == len(parts) - 1:
                cur[p] = None
            else:
                nxt = cur.get(p, {})
                if nxt is None:
                    break               # whole field already selected
                cur[p] = nxt
                cur = nxt
    return tree


def _scalar_type(fd, opts: Options) -> tuple[str, T.DataType]:
    t = fd.type
    if t in _INT32:
        return "scalar", T.IntegerType()
    if t in _INT64:
        return "scalar", T.LongType()
    if t in _UINT32:
        return "scalar", T.LongType()
    if t in _UINT64:
        return "uint64", (T.DecimalType(20, 0) if opts.uint64 == "decimal" else T.LongType())
    if t == FD.TYPE_DOUBLE:
        return "scalar", T.DoubleType()
    if t == FD.TYPE_FLOAT:
        return "scalar", T.FloatType()
    if t == FD.TYPE_BOOL:
        return "scalar", T.BooleanType()
    if t == FD.TYPE_STRING:
        return "scalar", T.StringType()
    if t == FD.TYPE_BYTES:
        return "scalar", T.BinaryType()
    if t == FD.TYPE_ENUM:
        return "enum", (T.IntegerType() if opts.enums == "int" else T.StringType())
    raise TypeError(f"unsupported field type {t} for {fd.full_name}")


def _timestamp_type(opts: Options) -> T.DataType:
    return {"timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
            "string": T.StringType(), "epoch_seconds": T.LongType()}[opts.timestamp]


def _duration_type(opts: Options) -> T.DataType:
    return {"interval": T.DayTimeIntervalType(0, 3), "string": T.StringType(),
            "micros": T.LongType()}[opts.duration]


def _field_node(fd, opts: Options, sel, depth: int, above: tuple = ()) -> Node:
    """``above`` holds the full names of the messages the field is nested in."""
    name = fd.camelcase_name if opts.names == "camel" else fd.name
    common = dict(name=name, attr=fd.name, repeated=fd.is_repeated,
                  presence=fd.has_presence and not fd.is_repeated, required=fd.is_required,
                  number=fd.number, in_oneof=fd.containing_oneof is not None,
                  proto_type=PROTO_TYPE_NAMES.get(fd.type, str(fd.type)),
                  oneof=(fd.containing_oneof.name if fd.containing_oneof is not None
                         and not getattr(fd.containing_oneof, "is_synthetic", False) else None))
    overrides = {k: (f, dt) for k, f, dt in opts.type_overrides}
    if fd.type in (FD.TYPE_MESSAGE, FD.TYPE_GROUP):
        mt = fd.message_type
        full = mt.full_name
        common["proto_type"] = full
        if mt.GetOptions().map_entry:
            k = _field_node(mt.fields_by_name["key"], opts, None, depth + 1, above)
            v = _field_node(mt.fields_by_name["value"], opts, None, depth + 1, above)
            common["repeated"] = False
            common["proto_type"] = "map"
            return Node(kind="map", dtype=T.MapType(k.dtype, v.dtype, True), key=k, value=v,
                        **common)
        if full in overrides:
            fn, dt = overrides[full]
            return Node(kind="override", dtype=dt, fn=fn, full_name=full, **common)
        if full == TIMESTAMP:
            return Node(kind="timestamp", dtype=_timestamp_type(opts), full_name=full, **common)
        if full == DURATION:
            return Node(kind="duration", dtype=_duration_type(opts), full_name=full, **common)
        if full in WRAPPERS:
            return Node(kind="wrapper", dtype=WRAPPERS[full], full_name=full, **common)
        if full in JSON_TYPES or depth >= opts.max_depth or above.count(full) > opts.max_recursion:
            return Node(kind="json", dtype=T.StringType(), full_name=full, **common)
        children = _message_nodes(mt, opts, sel, depth + 1, above)
        return Node(kind="message", dtype=T.StructType([c.to_field() for c in children]),
                    children=children, full_name=full, **common)
    kind, dtype = _scalar_type(fd, opts)
    node = Node(kind=kind, dtype=dtype, default=fd.default_value, **common)
    if kind == "enum":
        node.enum_names = {v.number: v.name for v in fd.enum_type.values}
        node.enum_numbers = {v.name: v.number for v in fd.enum_type.values}
        if opts.enums == "name" and not fd.is_repeated:
            node.default = node.enum_names.get(fd.default_value, str(fd.default_value))
    return node


def _message_nodes(desc, opts: Options, sel, depth: int, above: tuple = ()) -> list[Node]:
    nodes = []
    above = (*above, desc.full_name)
    oneofs_seen = []
    for fd in desc.fields:
        if sel is not None and fd.name not in sel and fd.camelcase_name not in sel:
            continue
        sub = None if sel is None else sel.get(fd.name, sel.get(fd.camelcase_name))
        nodes.append(_field_node(fd, opts, sub, depth, above))
        o = nodes[-1].oneof
        if opts.oneof_case and o and o not in oneofs_seen:
            oneofs_seen.append(o)
    for o in oneofs_seen:
        nodes.append(Node(name=f"{o}_case", attr=o, kind="oneof_case", dtype=T.StringType()))
    if sel is not None:
        known = {n.attr for n in nodes} | {n.name for n in nodes}
        missing = [k for k in sel if k not in known]
        if missing:
            raise ValueError(f"unknown field(s) {missing} in {desc.full_name}")
    return nodes


def build_plan(desc_set: bytes, message: str, fields=None, opts: Options | None = None) -> list[Node]:
    """Top-level ``Node`` list of ``message`` restricted to ``fields`` (dotted paths)."""
    opts = opts or Options()
    return _message_nodes(message_descriptor(desc_set, message), opts, _selection(fields), 0)


def spark_schema(desc_set: bytes, message: str, fields=None, **options) -> T.StructType:
    """Spark ``StructType`` of ``message``; all fields nullable (also proto2 required)."""
    plan = build_plan(desc_set, message, fields, make_options(**options))
    return T.StructType([n.to_field() for n in plan])


def describe_rows(desc_set: bytes, message: str, **options) -> list[tuple]:
    """(message, path, tag, proto_type, label, spark_type) for every field, nested included."""
    opts = make_options(**options)
    rows: list[tuple] = []

    def walk(desc, prefix: str, depth: int, above: tuple):
        above = (*above, desc.full_name)
        for fd in desc.fields:
            node = _field_node(fd, opts, None, depth, above)
            label = "repeated" if fd.is_repeated else ("required" if fd.is_required else "optional")
            path = f"{prefix}{node.name}"
            rows.append((desc.full_name, path, fd.number, node.proto_type, label,
                         node.spark_type.simpleString()))
            if node.kind == "message" and depth < opts.max_depth:
                walk(fd.message_type, path + ".", depth + 1, above)

    walk(message_descriptor(desc_set, message), "", 0, ())
    return rows


# ---------------------------------------------------------------------------
# Names
# ---------------------------------------------------------------------------
def snake_name(name: str, proto_names: dict | None = None) -> str:
    """The proto spelling of a camelCase name.

    ``proto_names`` ({camelCase: proto name}, see ``proto_spelling``) decides where it has
    the name.  Else a capital starts a new part, and so does a number at the end: camel-casing
    drops the underscore before it (``custom1`` was ``custom_1``).
    """
    if proto_names and name in proto_names:
        return proto_names[name]
    stem = name.rstrip("0123456789")
    parts = [""]
    for ch in stem:
        if ch.isupper() and parts[-1]:
            parts.append("")
        parts[-1] += ch.lower()
    if stem and stem != name and not stem.endswith("_"):
        parts.append("")
    parts[-1] += name[len(stem):]
    return "_".join(parts)


def proto_spelling(desc_set: bytes, message: str) -> dict:
    """{camelCase name: proto name} of a message's top-level fields."""
    return {f.camelcase_name: f.name for f in message_descriptor(desc_set, message).fields}


def camel_name(name: str) -> str:
    """snake_case -> lowerCamelCase (the JSON name protobuf derives)."""
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


# ---------------------------------------------------------------------------
# The fixed 90-column flat view table = the view record minus
# these 24 fields (tag order kept), and the 4 business renames of the
# 94-column variant, which sit right after country_name.
# ---------------------------------------------------------------------------
NOT_IN_90 = (
    "view_start", "view_end", "events", "custom_1", "custom_2", "custom_3", "custom_4",
    "custom_5", "page_type", "player_poster", "player_remote_played", "sub_property_id",
    "video_language", "video_producer", "video_variant_id", "video_variant_name",
    "view_downscaling_percentage", "view_upscaling_percentage", "preroll_ad_asset_hostname",
    "preroll_ad_tag_hostname", "preroll_requested", "max_request_latency", "request_latency",
    "request_throughput",
)
VIEW_RENAMES = {"custom_2": "site_name", "custom_3": "drm", "custom_4": "ad_strategy",
                "custom_5": "playback_failure_reason"}


def _view_columns_90() -> tuple[str, ...]:
    from .descriptors import VIEW_RECORD_FIELDS
    drop = set(NOT_IN_90)
    return tuple(name for _tag, _l, _t, name in VIEW_RECORD_FIELDS if name not in drop)


VIEW_COLUMNS_90 = _view_columns_90()


def _view_columns_94() -> tuple[str, ...]:
    cols = list(VIEW_COLUMNS_90)
    at = cols.index("country_name") + 1
    return tuple(cols[:at] + list(VIEW_RENAMES) + cols[at:])


VIEW_COLUMNS_94 = _view_columns_94()
