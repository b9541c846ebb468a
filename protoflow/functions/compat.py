"""Whether messages written with one schema can be read with another, by walking both descriptors.

Fields meet by tag.  Their types fall into wire classes: inside a class the bytes can be read, and a
narrower reader may lose values; across classes the field cannot be read.  ``compatibility`` runs
the walk in both directions: *backward* means the new schema reads what the old one wrote,
*forward* that the old one reads what the new one writes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from google.protobuf import descriptor_pb2
from google.protobuf.descriptor import FieldDescriptor as FD

from .descriptors import message_descriptor

# wire class and value range (lowest, highest bit count) of each type; a reader must cover the writer's range
_VARINT = {FD.TYPE_BOOL: (0, 1), FD.TYPE_INT32: (-32, 31), FD.TYPE_INT64: (-64, 63), FD.TYPE_UINT32: (0, 32),
           FD.TYPE_UINT64: (0, 64), FD.TYPE_ENUM: (-32, 31)}
_CLASSES = {
    "varint": _VARINT,
    "zigzag": {FD.TYPE_SINT32: (-32, 31), FD.TYPE_SINT64: (-64, 63)},
    "fixed32": {FD.TYPE_FIXED32: (0, 32), FD.TYPE_SFIXED32: (-32, 31)},
    "fixed64": {FD.TYPE_FIXED64: (0, 64), FD.TYPE_SFIXED64: (-64, 63)},
    "float": {FD.TYPE_FLOAT: (0, 0)},
    "double": {FD.TYPE_DOUBLE: (0, 0)},
    "text": {FD.TYPE_BYTES: (0, 2), FD.TYPE_STRING: (0, 1)},
    "message": {FD.TYPE_MESSAGE: (0, 0)},
    "group": {FD.TYPE_GROUP: (0, 0)},
}
WIRE_CLASS = {t: (name, span) for name, types in _CLASSES.items() for t, span in types.items()}
PACKABLE = {"varint", "zigzag", "fixed32", "fixed64", "float", "double"}
TYPE_NAMES = {getattr(FD, n): n[5:].lower() for n in dir(FD) if n.startswith("TYPE_")}
LEVELS = ("full", "backward", "forward", "none")


class IncompatibleSchema(ValueError):
    """The issues that forbid a schema, as text."""


@dataclass(frozen=True)
class Issue:
    """``kind`` of a difference at ``path`` (dotted names of the writer, with the tag)."""
    path: str
    tag: int
    kind: str          # type, range, repeated, required, moved, oneof, enum, reserved
    detail: str


def _kind(fd) -> str:
    return TYPE_NAMES[fd.type]


def _reserved(desc) -> list[tuple[int, int]]:
    proto = descriptor_pb2.DescriptorProto()
    desc.CopyToProto(proto)
    return [(r.start, r.end) for r in proto.reserved_range]


def _real_oneof(fd):
    """The field's declared oneof (a proto3 ``optional`` has one of its own that is not declared)."""
    one = fd.containing_oneof
    return one if one is not None and not (len(one.fields) == 1 and one.name == f"_{fd.name}") else None


def _closed(enum) -> bool:
    closed = getattr(enum, "is_closed", None)
    return bool(closed() if callable(closed) else closed)


def reading_issues(writer, reader, path: str = "", seen: set | None = None) -> list[Issue]:
    """What goes wrong when bytes of message descriptor ``writer`` are read as ``reader``."""
    seen = set() if seen is None else seen
    if (writer.full_name, reader.full_name) in seen:
        return []
    seen.add((writer.full_name, reader.full_name))
    issues: list[Issue] = []
    theirs = {f.number: f for f in reader.fields}
    names = {f.name: f for f in reader.fields}
    for w in writer.fields:
        at = f"{path}.{w.name}" if path else w.name
        r = theirs.get(w.number)
        if r is not None:
            issues += _field_issues(w, r, at, seen)
            continue
        if w.name in names:
            issues.append(Issue(at, w.number, "moved", f"tag {w.number} is {names[w.name].number} for the reader"))
        for a, b in _reserved(reader):
            if a <= w.number < b:
                issues.append(Issue(at, w.number, "reserved", f"the reader reserves tags {a} to {b - 1}"))
    mine = {f.number: f for f in writer.fields}
    for r in reader.fields:
        if r.is_required and (r.number not in mine or not mine[r.number].is_required):
            issues.append(Issue(f"{path}.{r.name}" if path else r.name, r.number, "required", "the writer may leave it out"))
    # fields that the writer sets together but the reader holds in one oneof: only the last is kept
    shared: dict = {}
    for r in reader.fields:
        one, w = _real_oneof(r), mine.get(r.number)
        if one is not None and w is not None:
            own = _real_oneof(w)
            shared.setdefault(one.name, []).append((r, None if own is None else own.name))
    for name, members in shared.items():
        homes = [home for _, home in members]
        if len(members) > 1 and (None in homes or len(set(homes)) > 1):
            for r, _ in members:
                issues.append(Issue(f"{path}.{r.name}" if path else r.name, r.number, "oneof", f"the reader keeps one of {name}"))
    return issues


def _field_issues(w, r, at: str, seen: set) -> list[Issue]:
    wc, (wlow, whigh) = WIRE_CLASS[w.type]
    rc, (rlow, rhigh) = WIRE_CLASS[r.type]
    out = []
    if wc != rc:
        # an embedded message is carried as bytes, which a bytes reader keeps
        if not (wc == "message" and r.type == FD.TYPE_BYTES):
            return [Issue(at, w.number, "type", f"{_kind(w)} is not read as {_kind(r)}")]
    elif wc == "message":
        out += reading_issues(w.message_type, r.message_type, at, seen)
    elif rlow > wlow or rhigh < whigh:
        out.append(Issue(at, w.number, "range", f"{_kind(w)} has values that {_kind(r)} has not"))
    elif w.type == r.type == FD.TYPE_ENUM and _closed(r.enum_type):
        missing = sorted({v.number for v in w.enum_type.values} - {v.number for v in r.enum_type.values})
        if missing:
            out.append(Issue(at, w.number, "enum", f"the reader has no value {missing}"))
    elif r.type == FD.TYPE_ENUM and w.type != FD.TYPE_ENUM and _closed(r.enum_type):
        out.append(Issue(at, w.number, "enum", f"{_kind(w)} has numbers that are no value of the reader's enum"))
    if w.is_repeated and not r.is_repeated:
        out.append(Issue(at, w.number, "repeated", "the reader keeps the last value" if wc not in PACKABLE
                         else "the reader keeps the last value, or none of a packed list"))
    return out


def compatibility(old, new) -> tuple[str, list[Issue], list[Issue]]:
    """(level, issues of the new schema reading old data, issues of the old schema reading new data).

    ``old`` and ``new`` are (descriptor set, message name); ``level`` is ``full``, ``backward``,
    ``forward`` or ``none``.
    """
    a, b = message_descriptor(*old), message_descriptor(*new)
    back, ahead = reading_issues(a, b), reading_issues(b, a)
    return LEVELS[2 * bool(back) + bool(ahead)], back, ahead


def require(level: str, old, new) -> None:
    """Raise ``IncompatibleSchema`` unless ``new`` is at least ``level``-compatible with ``old``."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    _, back, ahead = compatibility(old, new)
    bad = [("old data", i) for i in back if level in ("full", "backward")] + \
          [("new data", i) for i in ahead if level in ("full", "forward")]
    if bad:
        raise IncompatibleSchema("; ".join(f"{who} at {i.path} (tag {i.tag}): {i.kind}: {i.detail}" for who, i in bad))


# ---- what a message depends on ---------------------------------------------------------------

def closure(desc) -> tuple[dict, dict]:
    """({full name: descriptor}, {full name: enum}) of a message and everything its fields reach."""
    messages, enums, left = {}, {}, [desc]
    while left:
        d = left.pop()
        if d.full_name in messages:
            continue
        messages[d.full_name] = d
        for f in d.fields:
            if f.message_type is not None:
                left.append(f.message_type)
            elif f.enum_type is not None:
                enums[f.enum_type.full_name] = f.enum_type
    return messages, enums


def closure_fingerprint(desc_set: bytes, message: str) -> str:
    """A digest of the message's own meaning: the fields of all messages it reaches, and their enums.

    Files, comments, options and messages that it does not reach have no part in it.
    """
    messages, enums = closure(message_descriptor(desc_set, message))
    lines = []
    for name in sorted(messages):
        d = messages[name]
        lines.append(f"message {name}")
        for f in sorted(d.fields, key=lambda f: f.number):
            target = f.message_type or f.enum_type
            one = _real_oneof(f)
            lines.append("\t".join([
                str(f.number), f.name, _kind(f), target.full_name if target is not None else "",
                "repeated" if f.is_repeated else "required" if f.is_required else "optional",
                "presence" if f.has_presence else "", one.name if one is not None else "",
                repr(f.default_value) if f.has_default_value else ""]))
    for name in sorted(enums):
        lines.append(f"enum {name} " + " ".join(f"{v.name}={v.number}" for v in enums[name].values))
    return hashlib.sha256("\n".join([message, *lines]).encode()).hexdigest()
