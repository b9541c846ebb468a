"""View-record shaping: flatten, explode events, populated fields, unions, unpivot, names.

All native DataFrame expressions except the decode itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import descriptors as D
from ..functions.api import decode, field_presence
from ..functions.descriptors import message_descriptor
from ..functions.lattice import conform, join_all
from ..functions.schema import VIEW_COLUMNS_90, VIEW_RENAMES, proto_spelling, snake_name


def flatten_view(df: DataFrame, col: str = "value", message=None, fields=VIEW_COLUMNS_90,
                 renames: dict | None = None, absent: str = "default",
                 timestamp: str = "epoch_seconds", keep=(), **decode_options) -> DataFrame:
    """Flat view table straight from bytes: only ``fields`` are decoded (tags outside
    the list never become columns), nested lists are not decoded unless listed,
    columns are bound by name and optionally renamed (the 94-column variant)."""
    message = message or D.view_record()
    renames = renames or {}
    fields = list(fields)
    flat = decode(df, message, col=col, fields=fields, keep=keep, absent=absent,
                  timestamp=timestamp, **decode_options)
    if renames:
        flat = flat.withColumnsRenamed(renames)
    return flat


def flatten_view_94(df: DataFrame, col: str = "value", **kw) -> DataFrame:
    """The 94-column flat table: the 90 plus custom_2..5 under their business names."""
    cols = list(VIEW_COLUMNS_90)
    at = cols.index("country_name") + 1
    fields = cols[:at] + list(VIEW_RENAMES) + cols[at:]
    return flatten_view(df, col=col, fields=fields, renames=VIEW_RENAMES, **kw)


def explode_events(df: DataFrame, key: str = "view_id", events: str = "events",
                   outer: bool = False) -> DataFrame:
    """Child table of the nested events: key, pos (1-based), event fields, ``info_case``."""
    gen = F.posexplode_outer if outer else F.posexplode
    ex = df.select(key, gen(events).alias("pos", "_e"))
    et = df.schema[events].dataType.elementType
    cols = [F.col(key), (F.col("pos") + 1).alias("pos")]
    cols += [F.col("_e")[f.name].alias(f.name) for f in et.fields if f.name != "info_case"]
    names = {f.name for f in et.fields}
    if "info_case" in names:
        cols.append(F.col("_e")["info_case"].alias("info_case"))
    elif {"orientation_info", "rendition_info"} <= names:
        cols.append(F.when(F.col("_e")["orientation_info"].isNotNull(), F.lit("orientation_info"))
                    .when(F.col("_e")["rendition_info"].isNotNull(), F.lit("rendition_info"))
                    .alias("info_case"))
    return ex.select(*cols)


def populated_fields(df: DataFrame, exclude=("events",)) -> DataFrame:
    """field, n_set, n_rows over the whole dataset in one aggregation job.

    Replaces "keys of one random file": a column counts as populated by its
    non-NULL count across all rows (empty arrays count as unset).
    """
    cols = [c for c in df.columns if c not in set(exclude)]

    def present(c):
        dt = df.schema[c].dataType
        if isinstance(dt, (T.ArrayType, T.MapType)):
            return F.when(F.size(F.col(c)) > 0, F.lit(1))
        return F.col(c)

    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(present(c)).alias(f"__c{i}") for i, c in enumerate(cols)])
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"__c{i}").alias("n_set"))
                               for i, c in enumerate(cols)]))
    return agg.select(stack, F.col("__n").alias("n_rows"))


def flatten_populated(df: DataFrame, col: str = "value", message=None, exclude=("events",),
                      absent: str = "default", timestamp: str = "epoch_seconds", keep=(), mode: str = "failfast") -> DataFrame:
    """Flat table of the fields that are set somewhere in the data (minus ``exclude``).

    The keep-list comes from one presence count over the whole dataset (not from one
    file), read straight from the bytes; only field names reach the driver - at most
    one per message field.  With ``mode="permissive"`` messages that cannot be read take no part in the
    count and give a row of NULLs with the reason in ``_error``.
    """
    message = message or D.view_record()
    present = field_presence(df, message, col=col, mode=mode).where("n_set > 0").select("field")
    names = {r["field"] for r in present.collect()} - set(exclude)
    order = [f.name for f in message_descriptor(*message).fields if f.name in names]   # tag order
    return decode(df, message, col=col, fields=order, keep=keep, absent=absent, timestamp=timestamp, mode=mode)


def snake_names(df: DataFrame, message=None) -> DataFrame:
    """camelCase columns -> the proto names of ``message`` where it is given, else snake_case by
    rule; fails when two columns map to one name."""
    known = proto_spelling(*message) if message else None
    new = [snake_name(c, known) for c in df.columns]
    dup = {n for n in new if new.count(n) > 1}
    if dup:
        raise ValueError(f"snake_names would collide on {sorted(dup)}")
    return df.toDF(*new)


def union_days(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by name over the join of the schemas; duplicates kept.

    What a side lacks is NULL at every depth (also inside structs, arrays and maps) and numbers
    widen; types without a common one are a ``SchemaConflict``.  One plan node per input frame (a
    few days / versions), never one per file."""
    if not dfs:
        raise ValueError("union_days needs at least one DataFrame")
    schema = join_all(df.schema for df in dfs)
    return reduce(DataFrame.unionByName, [conform(df, schema) for df in dfs])


def unpivot_fields(df: DataFrame, key: str, fields) -> DataFrame:
    """key, field, value (text): one output row per (row, field), NULL values kept."""
    fields = list(fields)
    casted = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields])
    return casted.unpivot([key], fields, "field", "value")
