"""protoflow: protobuf message ingestion as ordinary Spark DataFrame code.

Public names resolve lazily, so Python workers that only need the codec do not
import the rest of the package.
"""

__version__ = "0.1.0"

_EXPORTS = {
    "decode": "protoflow.functions.api", "encode": "protoflow.functions.api",
    "decode_json": "protoflow.functions.api", "validate_required": "protoflow.functions.api",
    "field_presence": "protoflow.functions.api", "describe_message": "protoflow.functions.api",
    "spark_schema": "protoflow.functions.schema", "VIEW_COLUMNS_90": "protoflow.functions.schema",
    "list_files": "protoflow.sources.files", "with_path_partition": "protoflow.sources.files",
    "read_messages": "protoflow.sources.files", "read_day": "protoflow.sources.files",
    "land_raw_day": "protoflow.sources.files", "write_message_files": "protoflow.sources.files",
    "normalize_path": "protoflow.sources.files",
    "flatten_view": "protoflow.operators.views", "flatten_view_94": "protoflow.operators.views",
    "flatten_populated": "protoflow.operators.views", "explode_events": "protoflow.operators.views",
    "populated_fields": "protoflow.operators.views", "snake_names": "protoflow.operators.views",
    "union_days": "protoflow.operators.views", "unpivot_fields": "protoflow.operators.views",
    "sample_files": "protoflow.operators.sampling", "sample_tree": "protoflow.operators.sampling",
    "pick_file": "protoflow.operators.sampling",
    "register_schema": "protoflow.operators.registry", "encode_registered": "protoflow.operators.registry",
    "decode_registered": "protoflow.operators.registry", "frame": "protoflow.operators.registry",
    "unframe": "protoflow.operators.registry",
    "write_table": "protoflow.plans.tables", "table_detail": "protoflow.plans.tables",
    "shape": "protoflow.plans.tables", "ingest_report": "protoflow.plans.tables",
    "ingest_stream": "protoflow.streaming.ingest", "ingest_records": "protoflow.streaming.ingest",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        import importlib

        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'protoflow' has no attribute {name!r}")
