"""Columnar protobuf decode / encode, run on executors in Arrow batches.

``decode_batches`` parses every message of an Arrow batch once and then builds
each output column in one pass over the parsed messages (field by field, not a
dict per row), so a 114-field record costs one list comprehension per field.
``encode_batches`` is the reverse.  Both are plain generator functions that the
DataFrame operators in ``protoflow.functions.api`` hand to ``mapInArrow``.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

import pyarrow as pa
from google.protobuf import json_format
from google.protobuf.message import EncodeError
from pyspark.sql import types as T

from .descriptors import message_class, pruned_class, shallow_class
from .schema import Node, Options, build_plan

_EPOCH = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
_I64_MAX = (1 << 63) - 1
MAX_SLICE_BYTES = 4 << 20       # message bytes parsed at once; as Python objects they take many times as much
ENCODE_BYTES = 2 << 20          # Arrow bytes turned into Python objects at once


# ---------------------------------------------------------------------------
# Spark type -> Arrow type
# ---------------------------------------------------------------------------
def arrow_type(dt: T.DataType) -> pa.DataType:
    """Arrow type that ``mapInArrow`` must emit for a Spark type."""
    if isinstance(dt, T.BooleanType):
        return pa.bool_()
    if isinstance(dt, T.ByteType):
        return pa.int8()
    if isinstance(dt, T.ShortType):
        return pa.int16()
    if isinstance(dt, T.IntegerType):
        return pa.int32()
    if isinstance(dt, T.LongType):
        return pa.int64()
    if isinstance(dt, T.FloatType):
        return pa.float32()
    if isinstance(dt, T.DoubleType):
        return pa.float64()
    if isinstance(dt, T.StringType):
        return pa.string()
    if isinstance(dt, T.BinaryType):
        return pa.binary()
    if isinstance(dt, T.DecimalType):
        return pa.decimal128(dt.precision, dt.scale)
    if isinstance(dt, T.TimestampNTZType):
        return pa.timestamp("us")
    if isinstance(dt, T.TimestampType):
        return pa.timestamp("us", tz="UTC")
    if isinstance(dt, T.DateType):
        return pa.date32()
    if isinstance(dt, T.DayTimeIntervalType):
        return pa.duration("us")
    if isinstance(dt, T.ArrayType):
        return pa.list_(arrow_type(dt.elementType))
    if isinstance(dt, T.MapType):
        return pa.map_(arrow_type(dt.keyType), arrow_type(dt.valueType))
    if isinstance(dt, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType), True) for f in dt.fields])
    raise TypeError(f"no Arrow type for {dt}")


# ---------------------------------------------------------------------------
# Text forms of Timestamp / Duration (protobuf JSON mapping)
# ---------------------------------------------------------------------------
def _frac(nanos: int) -> str:
    if nanos == 0:
        return ""
    if nanos % 1_000_000 == 0:
        return f".{nanos // 1_000_000:03d}"
    if nanos % 1000 == 0:
        return f".{nanos // 1000:06d}"
    return f".{nanos:09d}"


def timestamp_text(seconds: int, nanos: int) -> str:
    """RFC 3339 text as the protobuf JSON mapping writes it (0, 3, 6 or 9 fraction digits)."""
    day = _EPOCH + _dt.timedelta(seconds=seconds)
    return f"{day.year:04d}" + day.strftime("-%m-%dT%H:%M:%S") + _frac(nanos) + "Z"


def duration_text(seconds: int, nanos: int) -> str:
    """Duration text as the protobuf JSON mapping writes it, e.g. ``-1.500s``."""
    sign = "-" if seconds < 0 or nanos < 0 else ""
    return f"{sign}{abs(seconds)}{_frac(abs(nanos))}s"


# ---------------------------------------------------------------------------
# Decode: messages -> Arrow arrays
# ---------------------------------------------------------------------------
class DecodeError(ValueError):
    pass


class _Clock:
    """An unset Timestamp/Duration read in default mode (attribute access gives zeros)."""
    seconds = 0
    nanos = 0


_ZERO_CLOCK = _Clock()
_NOFILL = object()


def _unset_value(node: Node, opts: Options):
    """What an unset field of a present parent reads as (``_NOFILL`` = stays NULL)."""
    default_mode = opts.absent == "default"
    if opts.absent == "set":
        return _NOFILL
    if node.kind == "map" or node.repeated:
        return _NOFILL if opts.absent == "null" else ()
    if node.kind in ("timestamp", "duration"):
        return _ZERO_CLOCK if default_mode else _NOFILL
    if node.kind in ("message", "wrapper", "json", "override"):
        return _NOFILL
    if opts.absent == "primitive":
        return _NOFILL if node.in_oneof else node.default
    if not node.presence or default_mode:          # no presence (proto3 scalars): always the default
        return node.default
    return _NOFILL


def _raw_all(nodes: list, msgs: list, opts: Options) -> list[list]:
    """Raw value lists for all ``nodes`` over parent messages ``msgs`` (None = NULL parent).

    One ``ListFields()`` call per message visits only the fields that are set, so a
    wide, sparsely filled record costs per set field, not per declared field.
    """
    n = len(msgs)
    cols: list[list] = [[None] * n for _ in nodes]
    first = next((m for m in msgs if m is not None), None)
    if first is not None:
        # keyed by the field descriptors of the class actually parsed (possibly a pruned
        # copy), so the loop does one dict lookup per set field and no attribute reads
        by_number = first.DESCRIPTOR.fields_by_number
        slot = {by_number[node.number]: j for j, node in enumerate(nodes)
                if node.kind != "oneof_case" and node.number in by_number}
        get = slot.get
        for i, m in enumerate(msgs):
            if m is None:
                continue
            for fd, v in m.ListFields():
                j = get(fd)
                if j is not None:
                    cols[j][i] = v
    for j, node in enumerate(nodes):
        if node.kind == "oneof_case":
            a = node.attr
            cols[j] = [None if m is None else m.WhichOneof(a) for m in msgs]
            continue
        fill = _unset_value(node, opts)
        if fill is not _NOFILL:
            cols[j] = [fill if (v is None and m is not None) else v for v, m in zip(cols[j], msgs)]
    return cols


def _convert(node: Node, vals: list, opts: Options) -> pa.Array:
    """Element values (not containers) -> Arrow array of ``node.dtype``."""
    k = node.kind
    at = arrow_type(node.dtype)
    if k == "scalar":
        if opts.float_digits and isinstance(node.dtype, (T.FloatType, T.DoubleType)):
            fmt = f".{int(opts.float_digits)}g"
            vals = [None if v is None else float(format(v, fmt)) for v in vals]
        return pa.array(vals, type=at)
    if k == "enum":
        if opts.enums == "int":
            return pa.array(vals, type=at)
        names = node.enum_names
        return pa.array([v if (v is None or isinstance(v, str)) else names.get(v, str(v))
                         for v in vals], type=at)
    if k == "uint64":
        if opts.uint64 == "decimal":
            return pa.array([None if v is None else Decimal(v) for v in vals], type=at)
        for v in vals:
            if v is not None and v > _I64_MAX:
                raise DecodeError(f"uint64 field {node.name!r} value {v} exceeds bigint; "
                                  "decode with uint64='decimal'")
        return pa.array(vals, type=at)
    if k == "timestamp":
        if opts.timestamp == "string":
            return pa.array([None if t is None else timestamp_text(t.seconds, t.nanos)
                             for t in vals], type=at)
        if opts.timestamp == "epoch_seconds":
            return pa.array([None if t is None else t.seconds for t in vals], type=pa.int64())
        micros = [None if t is None else t.seconds * 1_000_000 + t.nanos // 1000 for t in vals]
        return pa.array(micros, type=pa.int64()).cast(at)
    if k == "duration":
        if opts.duration == "string":
            return pa.array([None if d is None else duration_text(d.seconds, d.nanos)
                             for d in vals], type=at)
        micros = [None if d is None else (d.seconds * 1_000_000_000 + d.nanos) // 1000
                  for d in vals]
        arr = pa.array(micros, type=pa.int64())
        return arr if opts.duration == "micros" else arr.cast(at)
    if k == "wrapper":
        inner = [None if w is None else w.value for w in vals]
        if opts.float_digits and isinstance(node.dtype, (T.FloatType, T.DoubleType)):
            fmt = f".{int(opts.float_digits)}g"
            inner = [None if v is None else float(format(v, fmt)) for v in inner]
        if isinstance(node.dtype, T.LongType) and node.full_name.endswith("UInt64Value"):
            for v in inner:
                if v is not None and v > _I64_MAX:
                    raise DecodeError(f"UInt64Value field {node.name!r} value {v} exceeds bigint")
        return pa.array(inner, type=at)
    if k == "json":
        return pa.array([None if m is None else json_format.MessageToJson(m, indent=None)
                         for m in vals], type=at)
    if k == "oneof_case":
        return pa.array(vals, type=pa.string())
    if k == "override":
        return pa.array([None if m is None else node.fn(m) for m in vals], type=at)
    if k == "message":
        children = [_from_raw(c, r, opts) for c, r in zip(node.children, _raw_all(node.children, vals, opts))]
        mask = pa.array([v is None for v in vals], type=pa.bool_())
        if not children:
            return pa.array([None if v is None else {} for v in vals], type=pa.struct([]))
        return pa.StructArray.from_arrays(children, fields=[pa.field(c.name, arrow_type(c.spark_type))
                                                            for c in node.children], mask=mask)
    raise TypeError(f"cannot convert kind {k}")


def _lists(containers: list, null_empty: bool):
    """Containers per row -> (offsets, flat elements, null mask)."""
    offsets = [0]
    flat: list = []
    mask = []
    pos = 0
    for c in containers:
        if c is None or (null_empty and len(c) == 0):
            mask.append(True)
        else:
            mask.append(False)
            flat.extend(c)
            pos += len(c)
        offsets.append(pos)
    return offsets, flat, mask


def _columns(nodes: list, msgs: list, opts: Options) -> list[pa.Array]:
    """Output columns for ``nodes`` over parent messages ``msgs`` (None = NULL parent)."""
    return [_from_raw(nd, r, opts) for nd, r in zip(nodes, _raw_all(nodes, msgs, opts))]


def _from_raw(node: Node, raw: list, opts: Options) -> pa.Array:
    """Arrow column of ``node`` from its raw per-row values / containers."""
    null_empty = opts.absent == "null"
    if node.kind == "map":
        offsets = [0]
        keys: list = []
        items: list = []
        mask = []
        for c in raw:
            if c is None or (null_empty and len(c) == 0):
                mask.append(True)
            else:
                mask.append(False)
                for kk in c:
                    keys.append(kk)
                    items.append(c[kk])
            offsets.append(len(keys))
        karr = _convert(node.key, keys, opts)
        varr = _convert(node.value, items, opts)
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), karr, varr,
                                       type=arrow_type(node.dtype),
                                       mask=pa.array(mask, type=pa.bool_()))
    if node.repeated:
        offsets, flat, mask = _lists(raw, null_empty)
        values = _convert(node, flat, opts)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values,
                                        type=pa.list_(arrow_type(node.dtype)),
                                        mask=pa.array(mask, type=pa.bool_()))
    return _convert(node, raw, opts)


def _slices(batch: pa.RecordBatch, col: str, max_bytes: int):
    """Split a batch so that one slice holds at most ``max_bytes`` of message bytes."""
    import pyarrow.compute  # noqa: F401  (registers pa.compute)

    arr = batch.column(col)
    n = batch.num_rows
    if n == 0:
        return
    if arr.nbytes <= max_bytes:
        yield batch
        return
    lengths = pa.compute.binary_length(arr).to_pylist()
    start = 0
    acc = 0
    for i, ln in enumerate(lengths):
        acc += ln or 0
        if acc > max_bytes and i > start:
            yield batch.slice(start, i - start)
            start, acc = i, ln or 0
    yield batch.slice(start, n - start)


def _parts(batch: pa.RecordBatch, max_bytes: int):
    """Split a batch by halves until a part holds at most ``max_bytes`` of Arrow data, nested values counted, or one row.

    A part is copied out of its batch: the children of a sliced list are still those of the whole list."""
    if batch.num_rows < 2 or batch.nbytes <= max_bytes:
        yield batch
        return
    ends = []

    def cut(start: int, n: int) -> None:
        if n < 2 or batch.slice(start, n).nbytes <= max_bytes:
            ends.append((start, n))
        else:
            cut(start, n // 2)
            cut(start + n // 2, n - n // 2)

    cut(0, batch.num_rows)
    for start, n in ends:
        columns = [pa.concat_arrays([c.slice(start, n)]) for c in batch.columns]
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def decode_batches(batches, desc_set: bytes, message: str, fields, opts: Options, col: str,
                   keep: tuple, permissive: bool, expanded: bool, out: str,
                   registry: dict | None = None, id_col: str | None = None):
    """mapInArrow body: binary column -> decoded columns (+ ``_error`` when permissive).

    With ``registry`` ({schema_id: (desc_set, message)}) every row is parsed with its
    writer's class (found by ``id_col``) and read into the one reader plan.
    """
    import pyarrow.compute  # noqa: F401  (registers pa.compute)

    plan = build_plan(desc_set, message, fields, opts)
    reader_cls = message_class(desc_set, message)
    if fields is not None:
        # parse with a copy of the message that declares only the selected fields (at
        # every depth): unselected tags stay raw bytes instead of becoming objects
        reader_cls = pruned_class(desc_set, message, _plan_selection(plan, reader_cls.DESCRIPTOR))
    known_ids = set(registry) if registry is not None else None
    for batch in batches:
        for part in _slices(batch, col, MAX_SLICE_BYTES):
            data = part.column(col).to_pylist()
            ids = part.column(id_col).to_pylist() if registry is not None else None
            msgs: list = []
            errors: list = []
            for i, b in enumerate(data):
                if b is None:
                    msgs.append(None)
                    errors.append(None)
                    continue
                try:
                    # Wire data is tag-addressed: the writer's bytes are read straight into
                    # the reader's class; tags the reader lacks are skipped, missing ones
                    # stay unset.  The registry only has to vouch for the writer's id.
                    if known_ids is not None and ids[i] not in known_ids:
                        raise DecodeError(f"schema id {ids[i]} not in registry")
                    m = reader_cls.FromString(b)
                    msgs.append(m)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - the message is recorded per row
                    if not permissive:
                        raise DecodeError(f"cannot parse {message} from column {col!r}: {e}") from e
                    msgs.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            try:
                arrays = _columns(plan, msgs, opts)
            except Exception as e:  # noqa: BLE001 - a value that cannot be converted, found row by row
                if not permissive:
                    raise e if isinstance(e, DecodeError) else DecodeError(f"cannot convert {message}: {e}") from e
                arrays, msgs, errors = _rebuild_rowwise(plan, msgs, errors, opts)
            yield _assemble(part, keep, plan, arrays, msgs, errors, permissive, expanded, out)


def _plan_selection(nodes: list, desc) -> dict:
    """Selection tree of a decode plan: field -> None (whole) or a nested selection."""
    sel: dict = {}
    for n in nodes:
        if n.kind == "oneof_case":
            # every member decides the case, also those that are not selected
            for member in desc.oneofs_by_name[n.attr].fields:
                sel.setdefault(member.name, None)
            continue
        sub = None
        if n.kind == "message":
            sub_desc = desc.fields_by_name[n.attr].message_type
            real = [c for c in n.children if c.kind != "oneof_case"]
            if len(real) < len(sub_desc.fields) or any(c.kind == "message" for c in real):
                sub = _plan_selection(n.children, sub_desc)
                if all(v is None for v in sub.values()) and len(sub) == len(sub_desc.fields):
                    sub = None
        sel[n.attr] = sub          # a selection of its own replaces the mere presence above
    return sel


def _rebuild_rowwise(plan, msgs, errors, opts):
    """Permissive path after a value error: find the failing rows one by one."""
    for i, m in enumerate(msgs):
        if m is None:
            continue
        try:
            _columns(plan, [m], opts)
        except Exception as e:  # noqa: BLE001 - recorded with the row
            msgs[i] = None
            errors[i] = f"{type(e).__name__}: {e}"
    return _columns(plan, msgs, opts), msgs, errors


def _assemble(part, keep, plan, arrays, msgs, errors, permissive, expanded, out):
    cols = [part.column(k) for k in keep]
    names = list(keep)
    if expanded:
        cols += arrays
        names += [n.name for n in plan]
    else:
        mask = pa.array([m is None for m in msgs], type=pa.bool_())
        st = pa.StructArray.from_arrays(arrays, fields=[pa.field(n.name, arrow_type(n.spark_type))
                                                         for n in plan], mask=mask) \
            if arrays else pa.array([None if m is None else {} for m in msgs], type=pa.struct([]))
        cols.append(st)
        names.append(out)
    if permissive:
        cols.append(pa.array(errors, type=pa.string()))
        names.append("_error")
    return pa.RecordBatch.from_arrays(cols, names=names)


def presence_batches(batches, desc_set: bytes, message: str, col: str, names: str, permissive: bool = False):
    """mapInArrow body: one row per top-level field with the number of messages in this
    task that set it, plus the number of messages and of bad ones; only presence is looked at."""
    cls = shallow_class(desc_set, message)
    full = message_class(desc_set, message).DESCRIPTOR
    order = [f.number for f in full.fields]
    label = {f.number: (f.camelcase_name if names == "camel" else f.name) for f in full.fields}
    counts = dict.fromkeys(order, 0)
    rows = bad = 0
    for batch in batches:
        for b in batch.column(col).to_pylist():
            if b is None:
                continue
            parsed = _parse(cls, b, message, col, permissive)
            if parsed is None:
                bad += 1
                continue
            rows += 1
            for fd, _v in parsed.ListFields():
                if fd.number in counts:
                    counts[fd.number] += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([label[n] for n in order], pa.string()), pa.array([counts[n] for n in order], pa.int64()),
         pa.array([rows] * len(order), pa.int64()), pa.array([bad] * len(order), pa.int64())],
        names=["field", "n_set", "n_rows", "n_bad"])


def _parse(cls, data: bytes, message: str, col: str, permissive: bool):
    try:
        return cls.FromString(data)
    except Exception as e:  # noqa: BLE001 - counted as a bad message
        if permissive:
            return None
        raise DecodeError(f"cannot read {message} from column {col!r}: {e}") from e


class _Presence:
    """Counts at one message of the path trie: how often it occurs, and each field and oneof in it."""

    __slots__ = ("occurs", "fields", "oneofs", "below")

    def __init__(self):
        self.occurs, self.fields, self.oneofs, self.below = 0, {}, {}, {}

    def count(self, msg, depth: int) -> None:
        self.occurs += 1
        for fd, value in msg.ListFields():
            entry = self.fields.get(fd.number)
            if entry is None:
                entry = self.fields[fd.number] = [fd, 0, 0]
            entry[1] += 1
            entry[2] += len(value) if fd.is_repeated else 1
            one = fd.containing_oneof
            if one is not None:
                self.oneofs[one.name] = self.oneofs.get(one.name, 0) + 1
            inner = fd.message_type
            if inner is None or depth <= 1:
                continue
            if inner.GetOptions().map_entry:
                if inner.fields_by_name["value"].message_type is None:
                    continue
                items = value.values()
            else:
                items = value if fd.is_repeated else (value,)
            node = self.below.get(fd.number)
            if node is None:
                node = self.below[fd.number] = _Presence()
            for m in items:
                node.count(m, depth - 1)


def _presence_rows(desc, node: _Presence | None, prefix: str, names: str, depth: int, above: tuple):
    """(path, kind, set, values, occurrences of the parent) of all declared fields, and of recursive ones met."""
    for fd in desc.fields:
        path = prefix + (fd.camelcase_name if names == "camel" else fd.name)
        entry = node.fields.get(fd.number) if node else None
        yield path, "field", entry[1] if entry else 0, entry[2] if entry else 0, node.occurs if node else 0
        inner = fd.message_type
        if inner is not None and inner.GetOptions().map_entry:
            inner = inner.fields_by_name["value"].message_type
        if inner is None or depth <= 1:
            continue
        child = node.below.get(fd.number) if node else None
        if child is not None or inner.full_name not in above:
            yield from _presence_rows(inner, child, path + ".", names, depth - 1, (*above, inner.full_name))
    for one in desc.oneofs:
        if not (len(one.fields) == 1 and one.name == f"_{one.fields[0].name}"):      # not proto3's own for ``optional``
            yield prefix + one.name, "oneof", node.oneofs.get(one.name, 0) if node else 0, 0, node.occurs if node else 0


def presence_tree_batches(batches, desc_set: bytes, message: str, col: str, names: str, max_depth: int, permissive: bool):
    """mapInArrow body: the path trie of this task's messages as rows, counted without building a column."""
    cls = message_class(desc_set, message)
    root, bad = _Presence(), 0
    for batch in batches:
        for b in (b for part in _slices(batch, col, MAX_SLICE_BYTES) for b in part.column(col).to_pylist()):
            if b is None:
                continue
            parsed = _parse(cls, b, message, col, permissive)
            if parsed is None:
                bad += 1
            else:
                root.count(parsed, max_depth)
    rows = list(_presence_rows(cls.DESCRIPTOR, root, "", names, max_depth, (cls.DESCRIPTOR.full_name,)))
    columns = list(zip(*rows)) if rows else [()] * 5
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), *[pa.array(c, pa.int64()) for c in columns[2:]],
         pa.array([root.occurs] * len(rows), pa.int64()), pa.array([bad] * len(rows), pa.int64())],
        names=["field", "kind", "n_set", "n_values", "n_parents", "n_rows", "n_bad"])


def validate_batches(batches, desc_set: bytes, message: str, col: str, keep: tuple, out: str):
    """mapInArrow body: ``out`` = message parses and all required fields (nested too) are set."""
    cls = message_class(desc_set, message)
    for batch in batches:
        valid = []
        missing = []
        for b in batch.column(col).to_pylist():
            if b is None:
                valid.append(None)
                missing.append(None)
                continue
            try:
                m = cls.FromString(b)
            except Exception as e:  # noqa: BLE001
                valid.append(False)
                missing.append(f"unparseable: {type(e).__name__}")
                continue
            errs = m.FindInitializationErrors()
            valid.append(not errs)
            missing.append(",".join(errs) if errs else None)
        cols = [batch.column(k) for k in keep] + [pa.array(valid, type=pa.bool_()),
                                                   pa.array(missing, type=pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=list(keep) + [out, f"{out}_missing"])


# ---------------------------------------------------------------------------
# Encode: Arrow rows -> messages -> bytes
# ---------------------------------------------------------------------------
def _has_time(t: pa.DataType) -> bool:
    if pa.types.is_timestamp(t) or pa.types.is_duration(t):
        return True
    if pa.types.is_struct(t):
        return any(_has_time(t.field(i).type) for i in range(t.num_fields))
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return _has_time(t.value_type)
    if pa.types.is_map(t):
        return _has_time(t.key_type) or _has_time(t.item_type)
    return False


def plain_ints(arr: pa.Array) -> pa.Array:
    """Timestamps and durations (also nested) -> int64 microseconds, so that
    ``to_pylist`` yields ints instead of datetime objects."""
    t = arr.type
    if not _has_time(t):
        return arr
    if pa.types.is_timestamp(t) or pa.types.is_duration(t):
        return arr.cast(pa.int64())
    if isinstance(arr, pa.ChunkedArray):
        return pa.chunked_array([plain_ints(c) for c in arr.chunks])
    if pa.types.is_struct(t):
        children = [plain_ints(arr.field(i)) for i in range(t.num_fields)]
        return pa.StructArray.from_arrays(children, names=[t.field(i).name for i in range(t.num_fields)],
                                          mask=arr.is_null())
    if pa.types.is_list(t):
        return pa.ListArray.from_arrays(arr.offsets, plain_ints(arr.values), mask=arr.is_null())
    if pa.types.is_map(t):
        return pa.MapArray.from_arrays(arr.offsets, plain_ints(arr.keys), plain_ints(arr.items),
                                       mask=arr.is_null())
    return arr


def _time_source(dt: T.DataType) -> str:
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "micros"
    if isinstance(dt, T.DayTimeIntervalType):
        return "micros"
    if isinstance(dt, (T.LongType, T.IntegerType)):
        return "seconds"
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, T.StructType):
        return "struct"
    raise TypeError(f"cannot encode a {dt.simpleString()} into a Timestamp/Duration")


def _setter(node: Node, dt: T.DataType):
    """Function (message, python value) that writes ``value`` into field ``node``."""
    a = node.attr
    elem_dt = dt.elementType if (node.repeated and isinstance(dt, T.ArrayType)) else dt
    one = _element_writer(node, elem_dt)
    if node.kind == "map":
        if node.value.kind in ("message",):
            fill = _filler(node.value.children, dt.valueType)

            def set_map_msg(m, v):
                cont = getattr(m, a)
                for kk, vv in v:
                    if vv is not None:
                        fill(cont[kk], vv)
            return set_map_msg
        vconv = _scalar_conv(node.value, dt.valueType)

        def set_map(m, v):
            cont = getattr(m, a)
            for kk, vv in v:
                if vv is not None:
                    cont[kk] = vconv(vv)
        return set_map
    if node.repeated:
        if node.kind in ("message", "timestamp", "duration", "wrapper", "json"):
            def set_rep_msg(m, v):
                cont = getattr(m, a)
                for e in v:
                    if e is None:
                        raise ValueError(f"NULL element in repeated field {node.name!r}")
                    one(cont.add(), e)
            return set_rep_msg
        conv = _scalar_conv(node, elem_dt)

        def set_rep(m, v):
            if any(e is None for e in v):
                raise ValueError(f"NULL element in repeated field {node.name!r}")
            getattr(m, a).extend([conv(e) for e in v])
        return set_rep
    if node.kind in ("message", "timestamp", "duration", "wrapper", "json"):
        def set_sub(m, v):
            sub = getattr(m, a)
            sub.SetInParent()
            one(sub, v)
        return set_sub
    conv = _scalar_conv(node, dt)

    def set_scalar(m, v):
        setattr(m, a, conv(v))
    return set_scalar


def _scalar_conv(node: Node, dt: T.DataType):
    if node.kind == "enum":
        numbers = node.enum_numbers

        def enum_conv(v):
            if isinstance(v, str):
                if v not in numbers:
                    raise ValueError(f"{v!r} is not a value of enum field {node.name!r}")
                return numbers[v]
            return int(v)
        return enum_conv
    if node.kind == "uint64" or isinstance(dt, T.DecimalType):
        return int
    return lambda v: v


def _element_writer(node: Node, dt: T.DataType):
    """Writer into an already-obtained sub-message (message-like kinds)."""
    k = node.kind
    if k == "timestamp" or k == "duration":
        src = _time_source(dt)
        is_ts = k == "timestamp"

        def write_time(sub, v):
            if src == "micros":
                if is_ts:
                    sub.seconds, rem = divmod(v, 1_000_000)
                    sub.nanos = rem * 1000
                else:
                    neg = v < 0
                    s, rem = divmod(abs(v), 1_000_000)
                    sub.seconds, sub.nanos = (-s, -rem * 1000) if neg else (s, rem * 1000)
            elif src == "seconds":
                sub.seconds = v
            elif src == "text":
                sub.FromJsonString(v)
            else:
                sub.seconds = v.get("seconds") or 0
                sub.nanos = v.get("nanos") or 0
        return write_time
    if k == "wrapper":
        conv = int if node.full_name.endswith("UInt64Value") else (lambda x: x)

        def write_wrapper(sub, v):
            sub.value = conv(v)
        return write_wrapper
    if k == "json":
        def write_json(sub, v):
            json_format.Parse(v, sub)
        return write_json
    if k == "message":
        return _filler(node.children, dt)
    return None


def _filler(children: list[Node], dt: T.DataType):
    """Writer that fills a message from a python dict (a Spark struct value)."""
    by_name = {f.name: f.dataType for f in dt.fields} if isinstance(dt, T.StructType) else {}
    setters = []
    for c in children:
        if c.kind == "oneof_case" or c.name not in by_name:
            continue
        setters.append((c.name, _setter(c, by_name[c.name])))

    def fill(sub, d):
        for name, st in setters:
            v = d.get(name)
            if v is not None:
                st(sub, v)
    return fill


class _Slow(Exception):
    """A field needs the per-value Python path (JSON types, text timestamps, overrides)."""


def _split_micros(us: pa.Array, trunc: bool) -> tuple[pa.Array, pa.Array]:
    import numpy as np

    v = us.fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    if trunc:                                  # Duration: both parts carry the sign
        sec = np.sign(v) * (np.abs(v) // 1_000_000)
    else:                                      # Timestamp: nanos always 0..999999999
        sec = v // 1_000_000
    nanos = ((v - sec * 1_000_000) * 1000).astype("int32")
    return pa.array(sec, pa.int64()), pa.array(nanos, pa.int32())


def _prep(node: Node, arr: pa.Array, element: bool = False) -> pa.Array:
    """Arrow column -> the shape the message constructor takes (vectorized).

    Timestamps/durations become {seconds, nanos} structs, wrappers {value},
    decimals unsigned ints; nested structs/lists/maps are rebuilt around them.
    """
    t = arr.type
    mask = arr.is_null() if arr.null_count else None
    if node.kind == "map" and not element:
        if pa.types.is_map(t):
            items = _prep(node.value, arr.items, element=True)
            return pa.MapArray.from_arrays(arr.offsets, arr.keys, items, mask=mask)
        raise _Slow()
    if node.repeated and not element:
        if not (pa.types.is_list(t) or pa.types.is_large_list(t)):
            raise TypeError(f"repeated field {node.name!r} needs an array column, got {t}")
        return pa.ListArray.from_arrays(arr.offsets, _prep(node, arr.values, element=True), mask=mask)
    k = node.kind
    if k in ("timestamp", "duration"):
        if pa.types.is_timestamp(t) or pa.types.is_duration(t):
            sec, nanos = _split_micros(arr.cast(pa.int64()), trunc=(k == "duration"))
        elif pa.types.is_integer(t):
            sec = arr.cast(pa.int64()).fill_null(0)
            nanos = pa.array([0] * len(arr), pa.int32())
        elif pa.types.is_struct(t):
            return arr
        else:
            raise _Slow()
        return pa.StructArray.from_arrays([sec, nanos], names=["seconds", "nanos"], mask=arr.is_null())
    if k == "wrapper":
        inner = _from_decimal(node, arr) if pa.types.is_decimal(t) else arr
        return pa.StructArray.from_arrays([inner], names=["value"], mask=arr.is_null())
    if k == "uint64" or (k == "scalar" and pa.types.is_decimal(t)):
        return _from_decimal(node, arr) if pa.types.is_decimal(t) else arr
    if k == "message":
        if not pa.types.is_struct(t):
            raise TypeError(f"message field {node.name!r} needs a struct column, got {t}")
        by_name = {c.name: c for c in node.children}
        names, children = [], []
        for i in range(t.num_fields):
            fname = t.field(i).name
            child = by_name.get(fname)
            if child is None:
                raise ValueError(f"struct field {fname!r} is not a field of {node.full_name}")
            names.append(fname)
            children.append(_prep(child, arr.field(i)))
        if not names:
            return arr
        return pa.StructArray.from_arrays(children, names=names, mask=arr.is_null())
    if k in ("scalar", "enum"):
        return arr
    raise _Slow()


def _from_decimal(node, arr: pa.Array) -> pa.Array:
    """A decimal column as the numbers its field takes."""
    target = arrow_type(node.dtype)
    if pa.types.is_floating(target):
        return arr.cast(pa.float64())
    unsigned = node.kind == "uint64" or node.full_name.endswith("UInt64Value")
    return arr.cast(pa.uint64() if unsigned else pa.int64())


def _pylist(arr: pa.Array) -> list:
    """Arrow -> python values column-wise: leaf columns convert in bulk, structs are
    zipped into dicts, lists sliced by offsets, maps zipped into dicts (much faster
    than per-element scalar conversion of nested arrays)."""
    t = arr.type
    if pa.types.is_struct(t):
        names = [t.field(i).name for i in range(t.num_fields)]
        cols = [_pylist(arr.field(i)) for i in range(t.num_fields)]
        rows = [dict(zip(names, vals)) for vals in zip(*cols)] if cols else [{} for _ in range(len(arr))]
    elif pa.types.is_map(t):
        keys, items = _pylist(arr.keys), _pylist(arr.items)
        o = arr.offsets.to_pylist()
        rows = [dict(zip(keys[o[i]:o[i + 1]], items[o[i]:o[i + 1]])) for i in range(len(arr))]
    elif pa.types.is_list(t) or pa.types.is_large_list(t):
        flat = _pylist(arr.values)
        o = arr.offsets.to_pylist()
        rows = [flat[o[i]:o[i + 1]] for i in range(len(arr))]
    else:
        if arr.null_count == 0 and (pa.types.is_integer(t) or pa.types.is_floating(t)):
            return arr.to_numpy(zero_copy_only=False).tolist()      # bulk, no per-scalar boxing
        return arr.to_pylist()
    if arr.null_count:
        rows = [r if ok else None for r, ok in zip(rows, arr.is_valid().to_pylist())]
    return rows


def _fast_rows(batch: pa.RecordBatch, by_name: dict, cols: tuple, struct_col: str | None):
    """List of constructor kwargs (dict, or None for a NULL struct row) per row."""
    if struct_col is not None:
        arr = batch.column(struct_col)
        t = arr.type
        names, children = [], []
        for i in range(t.num_fields):
            node = by_name.get(t.field(i).name)
            if node is None:
                raise ValueError(f"struct field {t.field(i).name!r} is not a message field")
            names.append(node.attr)
            children.append(_prep(node, arr.field(i)))
        st = pa.StructArray.from_arrays(children, names=names, mask=arr.is_null())
    else:
        names = [by_name[c].attr for c in cols]
        children = [_prep(by_name[c], batch.column(c)) for c in cols]
        st = pa.StructArray.from_arrays(children, names=names) if names else None
    if st is None:
        return [{} for _ in range(batch.num_rows)]
    return _pylist(st)


def encode_batches(batches, desc_set: bytes, message: str, in_schema: T.StructType,
                   cols: tuple, keep: tuple, out: str, partial: bool, opts: Options,
                   struct_col: str | None = None, registry: dict | None = None,
                   id_col: str | None = None):
    """mapInArrow body: columns (or one struct column) -> serialized message bytes.

    A batch is converted in parts of ``ENCODE_BYTES``, so that a task's memory does not go by the rows of a batch.
    Fast path: columns are reshaped with Arrow kernels and every message is built
    by one call of the (C-implemented) constructor; fields that need per-value
    Python work fall back to field setters.
    """
    def setters_for(ds, mn):
        plan = build_plan(ds, mn, None, opts)
        by_name = {n.name: n for n in plan}
        if struct_col is not None:
            st = in_schema[struct_col].dataType
            fields = [(f.name, f.dataType) for f in st.fields]
        else:
            fields = [(c, in_schema[c].dataType) for c in cols]
        out_setters = []
        for name, dt in fields:
            node = by_name.get(name)
            if node is None:
                if registry is not None:
                    continue        # an older writer version simply lacks this field
                raise ValueError(f"column {name!r} is not a field of {mn}")
            out_setters.append((name, _setter(node, dt)))
        return message_class(ds, mn), out_setters, by_name

    if registry is not None:
        targets = {sid: setters_for(ds, mn) for sid, (ds, mn) in registry.items()}
    else:
        targets = {None: setters_for(desc_set, message)}
    union_nodes: dict = {}
    for _cls, _st, by_name in targets.values():
        for k, v in by_name.items():
            union_nodes.setdefault(k, v)
    allowed = {sid: {n.attr for n in by_name.values()} for sid, (_c, _s, by_name) in targets.items()}

    for batch in (part for b in batches for part in _parts(b, ENCODE_BYTES)):
        n = batch.num_rows
        ids = batch.column(id_col).to_pylist() if registry is not None else [None] * n
        try:
            fast = _fast_rows(batch, union_nodes, cols, struct_col)
        except _Slow:
            fast = None
        outb = []
        if fast is not None:
            for i in range(n):
                kw = fast[i]
                if kw is None:
                    outb.append(None)
                    continue
                target = targets.get(ids[i])
                if target is None:
                    raise ValueError(f"schema id {ids[i]} not in registry")
                cls = target[0]
                if registry is not None:
                    ok = allowed[ids[i]]
                    kw = {k: v for k, v in kw.items() if k in ok}
                try:
                    m = cls(**kw)
                except (TypeError, ValueError) as e:
                    raise ValueError(f"cannot build {cls.DESCRIPTOR.full_name}: {e}") from e
                outb.append(_serialize(m, cls, partial))
        else:
            outb = _encode_slow(batch, n, ids, targets, cols, struct_col, partial)
        arrays = [batch.column(k) for k in keep] + [pa.array(outb, type=pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=list(keep) + [out])


def _serialize(m, cls, partial: bool) -> bytes:
    if partial:
        return m.SerializePartialToString()
    try:
        return m.SerializeToString()          # checks required fields itself
    except EncodeError:
        raise ValueError(f"required field(s) {m.FindInitializationErrors()} of "
                         f"{cls.DESCRIPTOR.full_name} are NULL") from None


def _encode_slow(batch, n, ids, targets, cols, struct_col, partial):
    if struct_col is not None:
        rows = plain_ints(batch.column(struct_col)).to_pylist()
        values = None
    else:
        values = {c: plain_ints(batch.column(c)).to_pylist() for c in cols}
        rows = None
    outb = []
    for i in range(n):
        if rows is not None and rows[i] is None:
            outb.append(None)
            continue
        target = targets.get(ids[i])
        if target is None:
            raise ValueError(f"schema id {ids[i]} not in registry")
        cls, setters, _ = target
        m = cls()
        for name, st in setters:
            v = rows[i].get(name) if rows is not None else values[name][i]
            if v is not None:
                try:
                    st(m, v)
                except (TypeError, ValueError) as e:
                    raise ValueError(f"field {name!r}: {e}") from e
        outb.append(_serialize(m, cls, partial))
    return outb
