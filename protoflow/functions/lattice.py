"""Joins of schemas: the least type that holds the values of two types, at every depth.

``join_schemas`` is the least upper bound of two schemas: structs unite their fields by name, arrays
and maps join their elements, numbers widen only where every value survives.  Two types without a
common type (text and a number, a long and a double) are a ``SchemaConflict`` that names the path.
``conform`` casts a DataFrame to a wider schema; parts whose type does not change are left as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
MAX_DIGITS = 38
_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
# whole numbers that a binary float holds exactly
_EXACT = {T.FloatType(): 2, T.DoubleType(): 3}          # the first so many of _WHOLE


class SchemaConflict(ValueError):
    """Two types at ``path`` have no type that holds the values of both."""

    def __init__(self, path: str, a: T.DataType, b: T.DataType):
        super().__init__(f"{path or 'column'}: no type holds both {a.simpleString()} and {b.simpleString()}")
        self.path, self.types = path, (a, b)


def _numbers(a: T.DataType, b: T.DataType) -> T.DataType | None:
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        return T.DecimalType(digits, scale) if digits <= MAX_DIGITS else None
    for x, y in ((a, b), (b, a)):
        if x in _EXACT:
            if y in _EXACT:
                return T.DoubleType()
            if y in _WHOLE:
                if y in _WHOLE[:_EXACT[x]]:
                    return x
                return T.DoubleType() if y in _WHOLE[:_EXACT[T.DoubleType()]] else None
        if isinstance(x, T.DecimalType) and y in _DIGITS:
            return _numbers(x, T.DecimalType(_DIGITS[y], 0))
    return None


def join_types(a: T.DataType, b: T.DataType, path: str = "") -> T.DataType:
    """The least type that holds every value of ``a`` and of ``b``."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return join_schemas(a, b, path)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(join_types(a.elementType, b.elementType, f"{path}[]"), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(join_types(a.keyType, b.keyType, f"{path}{{key}}"),
                         join_types(a.valueType, b.valueType, f"{path}{{value}}"),
                         a.valueContainsNull or b.valueContainsNull)
    if isinstance(a, T.DayTimeIntervalType) and isinstance(b, T.DayTimeIntervalType):
        return T.DayTimeIntervalType(min(a.startField, b.startField), max(a.endField, b.endField))
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    found = _numbers(a, b)
    if found is None:
        raise SchemaConflict(path, a, b)
    return found


def join_schemas(a: T.StructType, b: T.StructType, path: str = "") -> T.StructType:
    """The least schema that holds rows of both: ``a``'s fields in their order, then those only ``b`` has.

    Names are compared without case, as Spark resolves them, and keep ``a``'s spelling.  A field that
    one side lacks is nullable.  Two names of one side that differ only in case are an error.
    """
    sides = []
    for side in (a, b):
        named = {f.name.lower(): f for f in side.fields}
        if len(named) < len(side.fields):
            raise ValueError(f"{path or 'schema'}: two fields have one name: {side.simpleString()}")
        sides.append(named)
    mine, other = sides
    fields = []
    for key, f in mine.items():
        g = other.get(key)
        inner = f"{path}.{f.name}" if path else f.name
        fields.append(T.StructField(f.name, join_types(f.dataType, g.dataType, inner) if g else f.dataType,
                                    f.nullable or g is None or g.nullable, f.metadata))
    fields += [T.StructField(g.name, g.dataType, True, g.metadata) for key, g in other.items() if key not in mine]
    return T.StructType(fields)


def join_all(schemas) -> T.StructType:
    return reduce(join_schemas, schemas)


def widens(old: T.StructType, new: T.StructType) -> bool:
    """Whether ``new`` holds every row of ``old`` (is its join with it)."""
    def bare(t):
        """Without nullability, metadata and the order and case of fields."""
        if isinstance(t, T.StructType):
            return tuple(sorted((f.name.lower(), bare(f.dataType)) for f in t.fields))
        if isinstance(t, T.ArrayType):
            return "array", bare(t.elementType)
        if isinstance(t, T.MapType):
            return "map", bare(t.keyType), bare(t.valueType)
        return t.simpleString()

    try:
        return bare(join_schemas(old, new)) == bare(new)
    except SchemaConflict:
        return False


def _same(a: T.DataType, b: T.DataType) -> bool:
    """Equal types, nullability aside, with fields in one order."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return [f.name for f in a.fields] == [f.name for f in b.fields] and all(
            _same(f.dataType, g.dataType) for f, g in zip(a.fields, b.fields))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _same(a.elementType, b.elementType)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return _same(a.keyType, b.keyType) and _same(a.valueType, b.valueType)
    return a == b


def _cast(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if _same(have, want):
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*_fields(have, want, lambda n: c.getField(n))))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: _cast(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        if not _same(have.keyType, want.keyType):
            c = F.transform_keys(c, lambda k, _: _cast(k, have.keyType, want.keyType))
        return F.transform_values(c, lambda _, v: _cast(v, have.valueType, want.valueType))
    return c.cast(want)


def _fields(have: T.StructType, want: T.StructType, get) -> list[Column]:
    named = {f.name.lower(): f for f in have.fields}
    out = []
    for f in want.fields:
        mine = named.get(f.name.lower())
        value = F.lit(None).cast(f.dataType) if mine is None else _cast(get(mine.name), mine.dataType, f.dataType)
        out.append(value.alias(f.name))
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order: values widened, missing columns and
    fields NULL at every depth.  A column that ``schema`` lacks, or that does not widen to its type there,
    is an error: nothing is dropped or narrowed without a word."""
    lost = [c for c in df.columns if c.lower() not in {f.name.lower() for f in schema.fields}]
    if lost:
        raise ValueError(f"the schema has no column {lost}")
    if not widens(df.schema, schema):
        raise ValueError(f"{df.schema.simpleString()} does not widen to {schema.simpleString()}")
    return df.select(*_fields(df.schema, schema, lambda n: df[f"`{n}`"]))
