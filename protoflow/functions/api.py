"""DataFrame operators over protobuf bytes: decode, encode, decode_json, validate_required.

Each is one ``mapInArrow`` node (no shuffle, no driver round trip).  Catalyst
cannot see through that node, so the operators take the projection (``fields``)
and the pass-through columns (``keep``) as arguments: only the chosen tags
become Arrow columns and only ``keep`` + the bytes column are read.
Filters on path/date columns must be applied before ``decode`` so they reach
the scan.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._session import ensure_shipped
from . import codec
from .schema import build_plan, describe_rows, make_options


def _resolve(message, descriptor_set):
    """``message`` is (descriptor_set, name) or a name with ``descriptor_set`` given."""
    if isinstance(message, tuple):
        return message
    if descriptor_set is None:
        raise ValueError("descriptor_set is required when message is a name")
    return descriptor_set, message


def _fields_of(df: DataFrame, names) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def decode(df: DataFrame, message, col: str = "value", descriptor_set: bytes | None = None,
           fields=None, keep=(), absent: str = "null", names: str = "proto",
           enums: str = "name", uint64: str = "long", timestamp: str = "timestamp",
           duration: str = "interval", oneof_case: bool = False, max_depth: int = 16, max_recursion: int = 3,
           type_overrides=None, mode: str = "failfast", expanded: bool = True,
           out: str = "value", engine: str = "python", float_digits: int | None = None,
           registry=None, _registry=None, _id_col=None) -> DataFrame:
    """Binary column -> typed columns (``expanded``) or one struct column ``out``.

    One row in, one row out.  ``mode="permissive"`` turns unparseable rows into NULLs
    and adds an ``_error`` text column; ``"failfast"`` fails the task.
    ``engine="jvm"`` uses Spark's built-in ``from_protobuf`` (needs the spark-protobuf
    package on the classpath; proto names, enum names, Timestamp -> timestamp only).
    """
    if registry is not None:
        # framed records: header parsed natively, payload read into ``message`` (the reader)
        from ..operators.registry import decode_registered
        return decode_registered(df, registry, _resolve(message, descriptor_set), col=col, keep=keep,
                                 mode=mode, fields=fields, absent=absent, names=names, enums=enums,
                                 uint64=uint64, timestamp=timestamp, duration=duration,
                                 oneof_case=oneof_case, max_depth=max_depth, max_recursion=max_recursion,
                                 type_overrides=type_overrides, expanded=expanded, out=out,
                                 float_digits=float_digits)
    desc_set, msg = _resolve(message, descriptor_set)
    if engine == "jvm" and float_digits is not None:
        raise ValueError("engine='jvm' does not support options ['float_digits']; use engine='python'")
    if engine == "jvm":
        return _decode_jvm(df, desc_set, msg, col, fields, keep, absent, names, enums, uint64,
                           timestamp, duration, oneof_case, max_depth, type_overrides, mode,
                           expanded, out)
    if engine != "python":
        raise ValueError("engine must be 'python' or 'jvm'")
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode must be 'failfast' or 'permissive'")
    opts = make_options(absent=absent, names=names, enums=enums, uint64=uint64,
                        timestamp=timestamp, duration=duration, oneof_case=oneof_case,
                        max_depth=max_depth, max_recursion=max_recursion, type_overrides=type_overrides, float_digits=float_digits)
    plan = build_plan(desc_set, msg, fields, opts)
    keep = tuple(keep)
    extra = (_id_col,) if _id_col and _id_col not in keep and _id_col != col else ()
    src = df.select(*dict.fromkeys([*keep, *extra, col]))
    out_fields = _fields_of(src, keep)
    produced = [n.name for n in plan] if expanded else [out]
    if mode == "permissive":
        produced.append("_error")
    clash = sorted(set(keep) & set(produced))
    if clash:
        raise ValueError(f"kept column(s) {clash} collide with decoded output; rename them first")
    if expanded:
        out_fields += [n.to_field() for n in plan]
    else:
        out_fields.append(T.StructField(out, T.StructType([n.to_field() for n in plan]), True))
    if mode == "permissive":
        out_fields.append(T.StructField("_error", T.StringType(), True))
    ensure_shipped(df.sparkSession)
    fn = partial(codec.decode_batches, desc_set=desc_set, message=msg, fields=fields, opts=opts,
                 col=col, keep=keep, permissive=(mode == "permissive"), expanded=expanded,
                 out=out, registry=_registry, id_col=_id_col)
    return src.mapInArrow(fn, T.StructType(out_fields))


def jvm_protobuf_available(spark: SparkSession) -> bool:
    """True when the spark-protobuf package is on the driver's classpath."""
    try:
        cls = spark.sparkContext._jvm.org.apache.spark.sql.protobuf.utils.ProtobufUtils
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no JVM handle
        return False
    return type(cls).__name__ == "JavaClass"


def _decode_jvm(df, desc_set, msg, col, fields, keep, absent, names, enums, uint64, timestamp,
                duration, oneof_case, max_depth, type_overrides, mode, expanded, out):
    """Built-in ``from_protobuf`` path: the parse runs in the JVM, no Python worker."""
    unsupported = {"names": names != "proto", "timestamp": timestamp != "timestamp",
                   "duration": duration != "interval", "oneof_case": oneof_case,
                   "type_overrides": bool(type_overrides), "absent": absent != "null",
                   "nested fields": any("." in p for p in fields or ()), "mode": mode != "failfast"}
    bad = [k for k, v in unsupported.items() if v]
    if bad:
        raise ValueError(f"engine='jvm' does not support options {bad}; use engine='python'")
    if not jvm_protobuf_available(df.sparkSession):
        raise RuntimeError("engine='jvm' needs the spark-protobuf package on the classpath")
    from pyspark.sql.protobuf.functions import from_protobuf

    opts = {"mode": "FAILFAST",
            "recursive.fields.max.depth": str(max_depth),
            "enums.as.ints": str(enums == "int").lower(),
            "upcast.unsigned.ints": str(uint64 == "decimal").lower(),
            "unwrap.primitive.wrapper.types": "true"}
    st = from_protobuf(F.col(col), msg, options=opts, binaryDescriptorSet=desc_set)
    top = list(fields) if fields else None
    parsed = df.select(*keep, st.alias(out))
    if not expanded:
        return parsed
    picked = [F.col(f"{out}.{n}").alias(n) for n in dict.fromkeys(top)] if top else [F.col(f"{out}.*")]
    return parsed.select(*keep, *picked)


def encode(df: DataFrame, message=None, cols=None, col: str | None = None, out: str = "value",
           keep=(), descriptor_set: bytes | None = None, partial_ok: bool = False,
           registry=None, subject: str | None = None, schema_id=None,
           _registry=None, _id_col=None) -> DataFrame:
    """Columns (or one struct column ``col``) -> serialized message in binary column ``out``.

    NULL value = field not set.  A NULL in a required field is an error naming the
    field unless ``partial_ok`` (used to produce invalid fixtures on purpose).
    Timestamp fields take timestamp / timestamp_ntz (wall clock read as UTC),
    epoch seconds or RFC 3339 text; Duration fields take day-time intervals.
    """
    if registry is not None:
        # encode with the registered schema(s) and prefix the 5-byte header
        from ..operators.registry import encode_registered
        return encode_registered(df, registry, subject=subject, schema_id=schema_id, cols=cols,
                                 col=col, out=out, keep=keep)
    desc_set, msg = _resolve(message, descriptor_set)
    keep = tuple(keep)
    if col is None:
        plan_names = {n.name for n in build_plan(desc_set, msg)}
        if cols is None:
            cols = [c for c in df.columns if c in plan_names]
        cols = tuple(cols)
        needed = list(dict.fromkeys([*keep, *cols]))
    else:
        needed = list(dict.fromkeys([*keep, col]))
        cols = ()
    if _id_col and _id_col not in needed:
        needed.append(_id_col)
    src = df.select(*needed)
    out_schema = T.StructType(_fields_of(src, keep) + [T.StructField(out, T.BinaryType(), True)])
    ensure_shipped(df.sparkSession)
    fn = partial(codec.encode_batches, desc_set=desc_set, message=msg, in_schema=src.schema,
                 cols=cols, keep=keep, out=out, partial=partial_ok, opts=make_options(),
                 struct_col=col, registry=_registry, id_col=_id_col)
    return src.mapInArrow(fn, out_schema)


def decode_json(df: DataFrame, message, col: str = "value", out: str = "content",
                descriptor_set: bytes | None = None, names: str = "camel",
                int64_as_string: bool = False, keep=None, float_digits: int | None = None,
                mapping: str = "spark", mode: str = "failfast") -> DataFrame:
    """``withColumn``-shaped: input columns + JSON text of the message in ``out``.

    The JSON itself is made by Spark's native ``to_json``, so only the parse runs in Python.
    ``mapping="protobuf"`` follows the protobuf JSON mapping: fields at their proto3 default are left
    out, Struct, Value and Any are objects, 64-bit integers are quoted (in maps too), uint32 is not.
    ``mapping="spark"`` goes by the decoded columns: unset fields are omitted (``to_json`` drops NULLs).  With
    ``int64_as_string`` 64-bit integers are quoted as the protobuf JSON mapping does.
    """
    keep = tuple(c for c in df.columns if c != out) if keep is None else tuple(keep)
    if mapping not in ("spark", "protobuf"):
        raise ValueError("mapping must be 'spark' or 'protobuf'")
    if mapping == "protobuf":
        if int64_as_string or float_digits is not None:
            raise ValueError("int64_as_string and float_digits belong to mapping='spark'")
        return _protobuf_json(df, message, col, out, descriptor_set, names, keep, mode)
    decoded = decode(df, message, col=col, descriptor_set=descriptor_set, keep=keep,
                     names=names, timestamp="string", duration="string", expanded=False,
                     out="_msg", float_digits=float_digits, mode=mode)
    st = decoded.schema["_msg"].dataType
    value = F.col("_msg")
    if int64_as_string:
        value = _quote_longs(value, st)
    error = ("_error",) if mode == "permissive" else ()
    return decoded.select(*keep, F.to_json(value).alias(out), *error)


def _protobuf_json(df, message, col, out, descriptor_set, names, keep, mode):
    """The protobuf JSON mapping from the decoded columns: only what is set is decoded, the text is Spark's."""
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode must be 'failfast' or 'permissive'")
    if names not in ("proto", "camel"):
        raise ValueError("names must be 'proto' or 'camel'")
    error = ("_error",) if mode == "permissive" else ()
    clash = sorted(set(keep) & {out, *error})
    if clash:
        raise ValueError(f"kept column(s) {clash} collide with the output; rename them first")
    desc_set, msg = _resolve(message, descriptor_set)
    options = dict(absent="set", names=names, uint64="decimal", timestamp="string", duration="string")
    decoded = decode(df, (desc_set, msg), col=col, keep=keep, expanded=False, out="_msg", mode=mode, **options)
    value = _json_struct(F.col("_msg"), build_plan(desc_set, msg, None, make_options(**options)))
    return decoded.select(*keep, F.to_json(value).alias(out), *error)


_QUOTED = {"int64", "uint64", "sint64", "fixed64", "sfixed64",
           "google.protobuf.Int64Value", "google.protobuf.UInt64Value"}


def _json_struct(c: Column, nodes) -> Column:
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.struct(*[_json_field(c.getField(n.name), n).alias(n.name) for n in nodes]))


def _json_field(c: Column, node) -> Column:
    if node.kind == "map":
        keys = F.transform_keys(c, lambda k, _: k.cast("string"))
        return F.transform_values(keys, lambda _, v: _json_value(v, node.value))
    return F.transform(c, lambda x: _json_value(x, node)) if node.repeated else _json_value(c, node)


def _json_value(c: Column, node) -> Column:
    """One value as the mapping writes it: 64-bit integers quoted, Struct, Value and Any as objects."""
    if node.kind == "message":
        return _json_struct(c, node.children)
    if node.kind == "json":
        return F.parse_json(c)
    return c.cast("string") if node.proto_type in _QUOTED else c


def _quote_longs(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.LongType):
        return c.cast("string")
    if isinstance(dt, T.StructType):
        return F.when(c.isNull(), F.lit(None)).otherwise(
            F.struct(*[_quote_longs(c[f.name], f.dataType).alias(f.name) for f in dt.fields]))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: _quote_longs(e, dt.elementType))
    return c


def validate_required(df: DataFrame, message, col: str = "value", out: str = "_valid",
                      descriptor_set: bytes | None = None, keep=None) -> DataFrame:
    """Adds ``out`` (all required fields, nested included, are set) and
    ``<out>_missing`` (comma-separated paths of the missing ones)."""
    desc_set, msg = _resolve(message, descriptor_set)
    keep = tuple(c for c in df.columns if c not in (out, f"{out}_missing")) if keep is None \
        else tuple(keep)
    src = df.select(*dict.fromkeys([*keep, col]))
    schema = T.StructType(_fields_of(src, keep) + [T.StructField(out, T.BooleanType(), True),
                                                   T.StructField(f"{out}_missing", T.StringType(), True)])
    ensure_shipped(df.sparkSession)
    fn = partial(codec.validate_batches, desc_set=desc_set, message=msg, col=col, keep=keep, out=out)
    return src.mapInArrow(fn, schema)


def field_presence(df: DataFrame, message, col: str = "value", descriptor_set: bytes | None = None,
                   names: str = "proto", mode: str = "failfast") -> DataFrame:
    """field, n_set, n_rows over all messages of ``col`` without decoding any value.

    Each task parses with a shallow copy of the type (nested messages stay raw bytes)
    and emits one row per field; the per-task rows are summed (a shuffle of
    #tasks x #fields rows).  Empty repeated fields count as unset.  With ``mode="permissive"``
    messages that cannot be read are left out and counted in a column ``n_bad``.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode must be 'failfast' or 'permissive'")
    desc_set, msg = _resolve(message, descriptor_set)
    ensure_shipped(df.sparkSession)
    permissive = mode == "permissive"
    fn = partial(codec.presence_batches, desc_set=desc_set, message=msg, col=col, names=names, permissive=permissive)
    per_task = df.select(col).mapInArrow(fn, "field string, n_set long, n_rows long, n_bad long")
    counts = ["n_set", "n_rows", "n_bad"] if permissive else ["n_set", "n_rows"]
    return per_task.groupBy("field").agg(*[F.sum(c).alias(c) for c in counts])


def presence_tree(df: DataFrame, message, col: str = "value", descriptor_set: bytes | None = None,
                  names: str = "proto", max_depth: int = 16, mode: str = "failfast") -> DataFrame:
    """field, kind, n_set, n_values, n_parents, n_rows, n_bad for the fields at every depth.

    ``field`` is a dotted path; through lists and maps it goes into every element and value.  ``n_parents``
    is how often the message that holds the field occurs, ``n_set`` in how many of them it is set,
    ``n_values`` how many values it has there (list elements, map entries).  A ``oneof`` has a row of
    its own: how often any of its members is set.  Declared fields that are never set have zeros; a type
    nested in itself is followed as deep as the data go, ``max_depth`` levels at most.  Each task counts a
    trie of paths and emits a row per path; no column is decoded.  With ``mode="permissive"``
    messages that cannot be read are left out and counted in ``n_bad``; NULLs are no messages.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode must be 'failfast' or 'permissive'")
    desc_set, msg = _resolve(message, descriptor_set)
    ensure_shipped(df.sparkSession)
    fn = partial(codec.presence_tree_batches, desc_set=desc_set, message=msg, col=col, names=names, max_depth=max_depth,
                 permissive=mode == "permissive")
    counts = ["n_set", "n_values", "n_parents", "n_rows", "n_bad"]
    per_task = df.select(col).mapInArrow(fn, "field string, kind string, " + ", ".join(f"{c} long" for c in counts))
    summed = per_task.groupBy("field", "kind").agg(*[F.sum(c).alias(c) for c in counts])
    # a task that never met a recursive path has no row for it; a row per path, so one task may look at all
    whole = Window.partitionBy(F.lit(0))
    return summed.withColumns({c: F.max(c).over(whole) for c in ("n_rows", "n_bad")})


def describe_message(spark: SparkSession, message, descriptor_set: bytes | None = None,
                     **options) -> DataFrame:
    """One row per field path: message, path, tag, proto_type, label, spark_type."""
    desc_set, msg = _resolve(message, descriptor_set)
    schema = "message string, path string, tag int, proto_type string, label string, spark_type string"
    return spark.createDataFrame(describe_rows(desc_set, msg, **options), schema)
