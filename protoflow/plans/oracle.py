"""DuckDB oracle SQL for the query catalogue, written against the raw tables.

The oracle never touches protobuf: it recomputes, from ``events`` / ``orders`` /
``lineitem``, what each Spark query must return after its encode -> bytes ->
decode trip.  The per-view aggregates below restate the fixture rules of
``protoflow.sources.fixtures`` in SQL.
"""

from __future__ import annotations

from ..functions.descriptors import VIEW_RECORD_FIELDS
from ..functions.schema import VIEW_COLUMNS_90, VIEW_RENAMES

SPLIT_DATE = "2024-01-16 00:00:00"

# A view is a run of 5000 consecutive events of a user; rows without a user are one more user.
VIEWS_CTE = """
_e AS (
  SELECT e.*, (row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) - 1) // 5000 AS _split
  FROM events e),
_ev AS (
  SELECT _e.*,
         coalesce(CAST(user_id AS VARCHAR), 'none') || '-' || CAST(_split AS VARCHAR) AS view_id,
         row_number() OVER (PARTITION BY user_id, _split ORDER BY ts, event_id) AS seq,
         min(ts) OVER (PARTITION BY user_id, _split) AS view_start
  FROM _e),
views AS (
  SELECT coalesce(CAST(user_id AS VARCHAR), 'none') || '-' || CAST(_split AS VARCHAR) AS view_id,
         'property-' || coalesce(CAST(((user_id % 7) + 7) % 7 AS VARCHAR), 'none') AS property_id,
         min(ts) AS view_start, max(ts) AS view_end,
         TRY_CAST(user_id AS INTEGER) AS asn,
         min(event_type) AS custom_2,
         CASE WHEN ((user_id % 2) + 2) % 2 = 1 THEN 'widevine' END AS custom_3,
         max(props) AS custom_4,
         min(CASE WHEN event_type = 'error' THEN CAST(event_id AS VARCHAR) END) AS custom_5,
         min(value) AS latitude, max(value) AS longitude,
         CAST(sum(event_id) AS BIGINT) AS player_source_duration,
         CAST(min(value) AS FLOAT) AS smoothness_score,
         bool_or(event_type = 'click') AS used_fullscreen,
         CAST(user_id AS VARCHAR) AS viewer_user_id,
         CAST(count(*) AS INTEGER) AS watch_time,
         bool_or(event_type = 'view') AS watched,
         CAST(count(*) FILTER (WHERE event_type = 'click') AS INTEGER) AS n_clicks,
         CAST(count(*) AS INTEGER) AS n_events
  FROM _e GROUP BY user_id, _split)
"""

# view-record fields the fixture sets (all others are never set)
SET_FIELDS = {"view_id", "property_id", "view_start", "view_end", "events", "asn", "custom_2",
              "custom_3", "custom_4", "custom_5", "latitude", "longitude", "player_source_duration",
              "smoothness_score", "used_fullscreen", "viewer_user_id", "watch_time", "watched"}

_DUCK = {"string": ("VARCHAR", "''"), "int32": ("INTEGER", "0"), "int64": ("BIGINT", "0"),
         "float": ("FLOAT", "0"), "double": ("DOUBLE", "0"), "bool": ("BOOLEAN", "false")}
_SPARK = {"string": "string", "int32": "int", "int64": "bigint", "float": "float", "double": "double",
          "bool": "boolean", "Timestamp": "timestamp_ntz",
          "Event": ("array<struct<sequence_number:bigint,server_time:timestamp_ntz,"
                    "viewer_time:timestamp_ntz,playhead_time:interval day to second,type:string,"
                    "orientation_info:struct<x:double,y:double,z:double>,"
                    "rendition_info:struct<width:bigint,height:bigint,fps:double,bitrate:bigint>>>")}
_PROTO = {"Timestamp": "google.protobuf.Timestamp", "Event": "eventstream.Event"}
_TYPES = {name: ftype for _t, _l, ftype, name in VIEW_RECORD_FIELDS}


def _flat_expr(name: str, absent: str, out: str | None = None) -> str:
    duck, default = _DUCK[_TYPES[name]]
    alias = out or name
    if name in SET_FIELDS:
        expr = name if absent == "null" else f"coalesce({name}, CAST({default} AS {duck}))"
    else:
        expr = f"CAST(NULL AS {duck})" if absent == "null" else f"CAST({default} AS {duck})"
    return f"{expr} AS {alias}"


def _with(body: str) -> str:
    return f"WITH {VIEWS_CTE} {body}"


def _ts_text(c: str) -> str:
    us = f"(((epoch_us({c}) % 1000000) + 1000000) % 1000000)"
    return (f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} = 0 THEN '' "
            f"WHEN {us} % 1000 = 0 THEN '.' || lpad(CAST({us} // 1000 AS VARCHAR), 3, '0') "
            f"ELSE '.' || lpad(CAST({us} AS VARCHAR), 6, '0') END || 'Z'")


def _rel(v: str = "") -> str:
    return f"strftime({v}view_start, '%Y/%m/%d/%H') || '/view-' || {v}view_id || '.pb'"


_VALUE = "CASE WHEN event_type <> 'error' THEN value END"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query key, over the raw tables (whitespace collapsed to one line)."""
    q: dict[str, str] = {}
    q["q00_min_slice"] = f"""
SELECT event_type, count(*) AS n, count({_VALUE}) AS n_value, CAST(sum(event_id) AS BIGINT) AS sum_event_id,
       min(ts) AS min_ts, max(ts) AS max_ts, max({_VALUE}) AS max_value
FROM events GROUP BY event_type"""
    q["q01_roundtrip"] = f"SELECT event_id, ts, user_id, event_type, {_VALUE} AS value, props FROM events"
    q["q02_struct_expand"] = ("SELECT coalesce(event_type, '') AS name, coalesce(event_id, 0) AS id, "
                              "coalesce(props, '') AS context FROM events")
    q["q03_flatten_default"] = _with("SELECT " + ", ".join(_flat_expr(c, "default") for c in VIEW_COLUMNS_90)
                                     + " FROM views")
    q["q04_flatten_null"] = _with("SELECT " + ", ".join(_flat_expr(c, "null") for c in VIEW_COLUMNS_90)
                                  + " FROM views")
    q["q05_field_list"] = _with("SELECT view_id, watch_time, n_events, n_clicks FROM views")
    cols94 = list(VIEW_COLUMNS_90)
    at = cols94.index("country_name") + 1
    cols94 = cols94[:at] + list(VIEW_RENAMES) + cols94[at:]
    q["q06_business_names"] = _with("SELECT " + ", ".join(
        _flat_expr(c, "default", VIEW_RENAMES.get(c)) for c in cols94) + " FROM views")
    q["q07_epoch_seconds"] = _with(
        "SELECT view_id, epoch_us(view_start) // 1000000 AS view_start, "
        "epoch_us(view_end) // 1000000 AS view_end FROM views")
    q["q08_timestamp_modes"] = _with(
        "SELECT view_id, epoch_us(view_start) AS view_start_us, epoch_us(view_end) AS view_end_us FROM views")
    q["q08b_timestamp_text"] = _with(
        f"SELECT view_id, {_ts_text('view_start')} AS view_start, {_ts_text('view_end')} AS view_end FROM views")
    q["q09_duration"] = _with(
        "SELECT view_id, CAST(seq AS BIGINT) AS sequence_number, "
        "epoch_us(ts) - epoch_us(view_start) AS playhead_us FROM _ev")
    q["q10_explode_events"] = _with(
        "SELECT view_id, CAST(seq AS INTEGER) AS pos, CAST(seq AS BIGINT) AS sequence_number, "
        "event_type AS type, ts AS server_time, "
        "CASE WHEN event_type = 'view' THEN event_id END AS width, "
        "CASE WHEN event_type = 'click' THEN value END AS x, "
        "CASE event_type WHEN 'view' THEN 'rendition_info' WHEN 'click' THEN 'orientation_info' END AS info_case "
        "FROM _ev")
    q["q11_oneof_case"] = _with(
        "SELECT view_id, CAST(seq AS BIGINT) AS sequence_number, "
        "CASE event_type WHEN 'view' THEN 'rendition_info' WHEN 'click' THEN 'orientation_info' END AS info_case "
        "FROM _ev")
    q["q12_json"] = (f"SELECT event_id, event_type, user_id, coalesce(event_type <> 'error', false) AS has_value, "
                     f"{_ts_text('ts')} AS ts_text FROM events")
    q["q13_registry"] = "SELECT event_id, user_id, event_type, CAST(1 AS INTEGER) AS schema_id FROM events"
    q["q14_mixed_versions"] = (
        "SELECT event_id, CAST(CASE WHEN ((event_id % 2) + 2) % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS schema_id, "
        "CASE WHEN ((event_id % 2) + 2) % 2 = 1 THEN event_type || '-src' END AS source FROM events")
    q["q15_evolution"] = _with(
        "SELECT view_id, epoch_us(view_start) // 1000000 AS view_start_seconds, "
        "CAST((((epoch_us(view_start) % 1000000) + 1000000) % 1000000) * 1000 AS INTEGER) AS view_start_nanos, "
        "CAST(NULL AS VARCHAR) AS asset_id, CAST(NULL AS INTEGER) AS live_stream_latency, n_events FROM views")
    q["q16_required"] = ("SELECT event_id, coalesce(event_type <> 'signup', true) AS _valid, "
                         "CASE WHEN event_type = 'signup' THEN 'ts' END AS _valid_missing FROM events")
    q["q17_corrupt"] = ("SELECT event_id, coalesce(event_type <> 'purchase', true) AS ok, "
                        "CASE WHEN coalesce(event_type <> 'purchase', true) THEN event_type END AS event_type "
                        "FROM events")
    pop = []
    for _t, _l, _ft, name in VIEW_RECORD_FIELDS:
        if name == "events":
            n = "count(*)"
        elif name in SET_FIELDS:
            n = f"count({name})"
        else:
            n = "CAST(0 AS BIGINT)"
        pop.append(f"SELECT '{name}' AS field, {n} AS n_set, count(*) AS n_rows FROM views")
    q["q18_populated"] = _with(" UNION ALL ".join(pop))
    q["q43_field_presence"] = q["q18_populated"]
    q["q44_record_stream"] = q["q14_mixed_versions"]
    q["q19_snake_names"] = _with("SELECT view_id, property_id, custom_2, custom_3, watch_time, "
                                 "used_fullscreen, player_source_duration FROM views")
    desc = ", ".join(
        f"('{name}', {tag}, '{_PROTO.get(ft, ft)}', '{label}', '{_SPARK[ft]}')"
        for tag, label, ft, name in VIEW_RECORD_FIELDS)
    pop_cte = " UNION ALL ".join(pop)
    q["q20_describe_message"] = (
        f"WITH {VIEWS_CTE}, pop AS ({pop_cte}), "
        f"d(path, tag, proto_type, label, spark_type) AS (VALUES {desc}) "
        "SELECT d.path, CAST(d.tag AS INTEGER) AS tag, d.proto_type, d.label, d.spark_type, pop.n_set "
        "FROM d JOIN pop ON d.path = pop.field")
    q["q21_files"] = _with(
        "SELECT CAST(view_start AS DATE) AS view_date, CAST(hour(view_start) AS INTEGER) AS view_hour, "
        "count(*) AS n_files FROM views GROUP BY 1, 2")
    q["q22_path_date"] = _with(
        "SELECT view_id, CAST(view_start AS DATE) AS view_date, CAST(hour(view_start) AS INTEGER) AS view_hour, "
        "watch_time FROM views")
    q["q46_days_and_hours"] = (
        f"SELECT * FROM ({q['q22_path_date']}) WHERE view_hour IN (0, 2, 13) AND "
        "(strftime(view_date, '%Y-%m-%d') = '2024-01-01' OR strftime(view_date, '%Y-%m-%d') BETWEEN '2024-01-03' AND '2024-01-09')")
    early = f"coalesce(ts < TIMESTAMP '{SPLIT_DATE}', true)"
    q["q47_growing_table"] = (
        "SELECT kept, CAST(ts AS DATE) AS view_date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, "
        "CAST(sum(user_id) AS BIGINT) AS users, "
        f"count(*) FILTER (WHERE NOT {early}) AS n_source, count(event_type) AS n_type, "
        f"max(CASE WHEN NOT {early} AND event_type <> 'error' THEN value END) AS max_value "
        "FROM events CROSS JOIN (VALUES ('path'), ('name')) k(kept) GROUP BY 1, 2")
    q["q48_union_versions"] = _with(
        "SELECT view_id, watch_time, CASE WHEN watch_time % 2 = 1 THEN custom_2 END AS custom_2, n_events, "
        "CASE WHEN watch_time % 2 = 1 THEN CAST(n_events AS BIGINT) END AS last FROM views")
    q["q51_message_source"] = f"SELECT * FROM ({q['q22_path_date']}) WHERE view_hour < 12"
    q["q52_compatibility"] = """
        SELECT change, level, reading_old, reading_new, count(*) AS n, count(*) FILTER (WHERE CASE how
            WHEN 'all' THEN true WHEN 'none' THEN false WHEN 'no user' THEN user_id IS NULL WHEN 'no props' THEN props IS NULL
            END) AS n_as_before
        FROM events CROSS JOIN (VALUES
            ('add_optional', 'full', '', '', 'all'), ('remove_field', 'full', '', '', 'all'),
            ('add_required', 'forward', 'required', '', 'none'), ('narrow_number', 'forward', 'range', '', 'all'),
            ('number_to_text', 'none', 'type', 'type', 'no user'), ('other_tag', 'none', 'moved', 'moved', 'no props'),
            ('list_of_text', 'backward', '', 'repeated', 'all'), ('shorter_float', 'none', 'type', 'type', 'none')
        ) c(change, level, reading_old, reading_new, how) GROUP BY 1, 2, 3, 4"""
    c = "substr(md5(view_id), 1, 1)"
    q["q49_incremental_landing"] = _with(
        f"SELECT CAST(view_start AS DATE) AS view_date, count(*) FILTER (WHERE {c} < '3') AS new, "
        f"count(*) FILTER (WHERE {c} BETWEEN '3' AND '5') AS changed, count(*) FILTER (WHERE {c} BETWEEN '6' AND '7') AS gone, "
        f"count(*) FILTER (WHERE {c} > '7') AS same, count(*) FILTER (WHERE {c} NOT BETWEEN '6' AND '7') AS n_files, "
        f"CAST(sum(watch_time) FILTER (WHERE {c} NOT BETWEEN '6' AND '7') AS BIGINT) AS total_watch FROM views GROUP BY 1")
    inside = {"events": "n", "events.sequence_number": "n", "events.server_time": "n", "events.viewer_time": "n",
              "events.playhead_time": "n", "events.type": "n", "events.orientation_info": "clicks",
              "events.rendition_info": "seen", "events.info": "clicks + seen"}
    inside |= {f"events.orientation_info.{x}": "clicks" for x in "xyz"}
    inside |= {f"events.rendition_info.{x}": "seen" for x in ("width", "height", "bitrate")} | {"events.rendition_info.fps": "fps"}
    parents = {f: "clicks" if ".orientation_info." in f else "seen" if ".rendition_info." in f else "n" for f in inside}
    kinds = {"events.info": "oneof"}
    lines = " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{kinds.get(f, 'field')}' AS kind, "
        f"{'good' if f == 'events' else s} AS n_set, {'good' if f == 'events' else parents[f]} AS n_parents, "
        "good AS n_rows, bad AS n_bad FROM t" for f, s in inside.items())
    q["q54_presence_at_depth"] = (
        f"WITH {VIEWS_CTE}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, "
        "count(*) FILTER (WHERE event_type = 'view') AS seen, count(value) FILTER (WHERE event_type = 'view') AS fps, "
        f"(SELECT count(*) FROM views WHERE {c} >= '3') AS good, (SELECT count(*) FROM views WHERE {c} < '3') AS bad "
        f"FROM _ev WHERE {c} >= '3') " + lines)
    n_set = len(SET_FIELDS - {"events", "view_id"}) + 2
    q["q55_flatten_dirty"] = _with(
        f"SELECT view_id, {c} >= '3' AS ok, CASE WHEN {c} >= '3' THEN watch_time END AS watch_time, "
        f"CASE WHEN {c} >= '3' THEN custom_2 END AS custom_2, CAST({n_set} AS INTEGER) AS n_cols FROM views")
    q["q56_stream_bad_records"] = _with(
        f"SELECT CAST(view_start AS DATE) AS view_date, view_id, CASE WHEN {c} < '3' THEN 'bad' ELSE 'row' END AS kind, "
        f"CASE WHEN {c} >= '3' THEN watch_time END AS watch_time FROM views")
    q["q57_primitive_digits"] = (
        f"SELECT event_id, coalesce(event_type, '') AS event_type, coalesce(CAST(printf('%.3g', {_VALUE}) AS DOUBLE), 0.0) AS value, "
        "coalesce(props, '') AS props FROM events")
    us = "(epoch_us(ts) - epoch_us(view_start))"
    q["q58_decimal_and_duration_text"] = _with(
        "SELECT view_id, CAST(seq AS DECIMAL(20,0)) AS number, CAST(u // 1000000 AS VARCHAR) || CASE "
        "WHEN u % 1000000 = 0 THEN '' WHEN u % 1000 = 0 THEN '.' || lpad(CAST(u % 1000000 // 1000 AS VARCHAR), 3, '0') "
        "ELSE '.' || lpad(CAST(u % 1000000 AS VARCHAR), 6, '0') END || 's' AS text "
        f"FROM (SELECT view_id, seq, {us} AS u FROM _ev) "
        "UNION ALL SELECT 'order', CAST(o_orderkey AS DECIMAL(20,0)), NULL FROM orders")
    q["q59_json_text"] = (
        "SELECT event_id, '{\"eventId\":\"' || event_id || '\",\"ts\":\"' || " + _ts_text("ts") + " || '\"' || "
        "coalesce(',\"userId\":\"' || user_id || '\"', '') || coalesce(',\"eventType\":' || to_json(event_type), '') || "
        f"coalesce(',\"value\":' || CAST({_VALUE} AS VARCHAR), '') || coalesce(',\"props\":' || to_json(props), '') || '}}' "
        "AS content FROM events")
    q["q53_sample_tree"] = _with(
        f"SELECT rel FROM (SELECT {c} AS c, CASE WHEN {c} = '0' THEN view_id || '.pb' ELSE 'c' || {c} || '/' || {_rel()} END AS rel "
        "FROM views) f QUALIFY c = '0' OR row_number() OVER (PARTITION BY c ORDER BY md5('/t/' || rel), rel) "
        "<= floor(0.25 * count(*) OVER (PARTITION BY c))")
    q["q50_counted_ingest"] = _with(
        f"SELECT count(*) AS found, count(*) AS read, count(*) FILTER (WHERE {c} >= '3') AS rows, "
        f"count(*) FILTER (WHERE {c} < '3') AS bad, count(*) FILTER (WHERE {c} >= '3') AS n_views, "
        f"CAST(sum(watch_time) FILTER (WHERE {c} >= '3') AS BIGINT) AS total_watch FROM views")
    q["q23_sample"] = _with(
        f"SELECT rel, day FROM (SELECT {_rel()} AS rel, strftime(view_start, '%Y/%m/%d') AS day FROM views) f "
        "QUALIFY row_number() OVER (PARTITION BY day ORDER BY md5(rel), rel) "
        "<= floor(0.25 * count(*) OVER (PARTITION BY day))")
    q["q45_read_sampled"] = _with(
        f"SELECT view_id, CAST(view_start AS DATE) AS view_date, watch_time FROM "
        f"(SELECT *, {_rel()} AS rel, strftime(view_start, '%Y/%m/%d') AS day FROM views) f "
        "QUALIFY row_number() OVER (PARTITION BY day ORDER BY md5(rel), rel) "
        "<= floor(0.25 * count(*) OVER (PARTITION BY day))")
    q["q23b_sample_events"] = (
        "SELECT event_id, event_type FROM events "
        "QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) "
        "<= floor(0.05 * count(*) OVER (PARTITION BY event_type))")
    q["q24_pick_one"] = _with(f"SELECT {_rel()} AS rel FROM views ORDER BY md5(rel), rel LIMIT 1")
    q["q25_union_days"] = (
        f"SELECT event_id, ts, event_type, CASE WHEN NOT coalesce(ts < TIMESTAMP '{SPLIT_DATE}', true) "
        "THEN event_type || '-src' END AS source FROM events")
    q["q26_shape"] = _with(f"SELECT count(*) AS n_rows, CAST({len(VIEW_RECORD_FIELDS)} AS INTEGER) AS n_cols "
                           "FROM views")
    q["q27_take"] = f"SELECT event_id, ts, user_id, event_type, {_VALUE} AS value, props FROM events ORDER BY event_id LIMIT 10"
    day_totals = _with("SELECT CAST(view_start AS DATE) AS view_date, count(*) AS n_views, "
                       "CAST(sum(watch_time) AS BIGINT) AS total_watch FROM views GROUP BY 1")
    q["q28_table"] = day_totals
    q["q29_overwrite"] = day_totals
    q["q30_custom_type"] = _with("SELECT view_id, strftime(view_start, '%Y-%m-%d') AS view_start, "
                                 "strftime(view_end, '%Y-%m-%d') AS view_end FROM views")
    prio_name = ("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'URGENT' WHEN '2' THEN 'HIGH' "
                 "WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'NOT_SPECIFIED' WHEN '5' THEN 'LOW' END")
    q["q31_enum_modes"] = f"SELECT o_orderkey AS order_key, o_orderstatus AS status, {prio_name} AS priority FROM orders"
    q["q31b_enum_int"] = ("SELECT o_orderkey AS order_key, "
                          "CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS INTEGER) AS status, "
                          "TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders")
    q["q32_wide_types"] = (
        "SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderkey AS order_key_u64, "
        "o_orderpriority AS priority_text, o_totalprice AS total_price, o_orderstatus AS status_text, "
        "-o_orderkey AS neg_key, o_custkey AS cust_fixed, CAST(o_totalprice AS FLOAT) AS price_f, "
        "o_orderdate AS order_date, o_orderkey AS key_0, CAST(2 AS INTEGER) AS n_parts, "
        "o_custkey AS counter_cust, o_orderkey AS counter_order FROM orders")
    q["q33_stream"] = q["q22_path_date"]
    q["q34_raw_landing"] = _with("SELECT CAST(view_start AS DATE) AS view_date, count(*) AS n_files, "
                                 "count(*) AS n_nonempty FROM views GROUP BY 1")
    q["q35_unpivot"] = _with(
        "SELECT view_id, 'watch_time' AS field, CAST(watch_time AS VARCHAR) AS value FROM views UNION ALL "
        "SELECT view_id, 'used_fullscreen', CAST(used_fullscreen AS VARCHAR) FROM views UNION ALL "
        "SELECT view_id, 'custom_3', custom_3 FROM views")
    q["q36_ingest_report"] = _with(
        "SELECT strftime(view_start, '%Y/%m/%d') AS day, count(*) AS n_found, "
        "CAST(floor(0.25 * count(*)) AS BIGINT) AS n_selected FROM views GROUP BY 1")
    q["q37_simple_message"] = (
        "SELECT coalesce(l_returnflag || l_linestatus, '') AS name, count(*) AS n, "
        "CAST(sum(coalesce(CAST(trunc(l_quantity) AS BIGINT), 0)) AS BIGINT) AS sum_quantity, "
        "max(coalesce(CAST(l_extendedprice AS FLOAT), CAST(0 AS FLOAT))) AS max_measure, "
        "min(coalesce(CAST(l_extendedprice AS FLOAT), CAST(0 AS FLOAT))) AS min_measure "
        "FROM lineitem GROUP BY 1")
    pop_cols = []
    for _t, _l, ft, name in VIEW_RECORD_FIELDS:
        if name not in SET_FIELDS or name == "events":
            continue
        if ft == "Timestamp":
            pop_cols.append(f"epoch_us({name}) // 1000000 AS {name}")
        else:
            pop_cols.append(_flat_expr(name, "default"))
    q["q38_flatten_populated"] = _with("SELECT " + ", ".join(pop_cols) + " FROM views")
    q["q39_hour_folders"] = _with(
        "SELECT CAST(hour(view_start) AS INTEGER) AS view_hour, count(*) AS n_views, "
        "CAST(sum(watch_time) AS BIGINT) AS total_watch FROM views GROUP BY 1")
    q["q40_path_contains"] = _with("SELECT view_id FROM views WHERE view_id LIKE '1%'")
    q["q41_normalize_path"] = _with(
        "SELECT '/mnt/views/' || strftime(view_start, '%Y/%m/%d') AS day_folder, count(*) AS n_files "
        "FROM views GROUP BY 1")
    q["q42_table_detail"] = _with("SELECT 'parquet' AS format, count(*) AS num_rows, "
                                  "'view_date' AS partition_columns FROM views")
    return {k: " ".join(v.split()) for k, v in q.items()}
