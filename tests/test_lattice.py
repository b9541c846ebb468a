"""Schema joins, widening casts, and tables whose schema grows."""
import itertools
import tempfile
import threading
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protoflow.functions.lattice import SchemaConflict, conform, join_schemas, join_types, widens
from protoflow.operators.views import union_days
from protoflow.plans import tables as TB
from protoflow.plans.tables import read_table, table_detail, write_table

B, S, I, L = T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()  # noqa: E741
FL, DO, STR = T.FloatType(), T.DoubleType(), T.StringType()


def schema(text):
    return T._parse_datatype_string(text)


@pytest.mark.parametrize("a, b, want", [
    (I, L, L), (B, S, S), (FL, DO, DO), (S, FL, FL), (I, FL, DO), (I, DO, DO), (T.NullType(), STR, STR),
    (T.DecimalType(10, 2), T.DecimalType(8, 4), T.DecimalType(12, 4)), (I, T.DecimalType(12, 3), T.DecimalType(13, 3)),
    (T.DateType(), T.TimestampNTZType(), T.TimestampNTZType()),
    (T.DayTimeIntervalType(0, 1), T.DayTimeIntervalType(2, 3), T.DayTimeIntervalType(0, 3)),
    (T.ArrayType(I, False), T.ArrayType(L), T.ArrayType(L)), (T.MapType(STR, I), T.MapType(STR, L), T.MapType(STR, L)),
])
def test_joins(a, b, want):
    assert join_types(a, b) == join_types(b, a) == want


@pytest.mark.parametrize("a, b, path", [
    ("x long", "x double", "x"), ("x string", "x int", "x"), ("x struct<y:array<int>>", "x struct<y:array<string>>", r"x.y\[\]"),
    ("x map<string,int>", "x map<string,binary>", "x{value}"), ("x timestamp", "x timestamp_ntz", "x"),
    ("x decimal(38,0)", "x decimal(38,10)", "x"), ("x struct<y:int>", "x int", "x"),
])
def test_conflicts_name_the_path(spark, a, b, path):
    with pytest.raises(SchemaConflict, match="^" + path):
        join_schemas(schema(a), schema(b))


def test_structs_unite_by_name_without_case(spark):
    got = join_schemas(schema("a int, s struct<x:int, y:string>"), schema("b date, A long, S struct<z:int, X:long>"))
    assert got.simpleString() == "struct<a:bigint,s:struct<x:bigint,y:string,z:int>,b:date>"
    with pytest.raises(ValueError, match="one name"):
        join_schemas(schema("a int, A int"), schema("b int"))


LEAF = st.sampled_from([B, S, I, L, FL, DO, STR, T.DateType(), T.DecimalType(9, 2), T.NullType()])
TYPES = st.recursive(LEAF, lambda t: st.one_of(
    st.builds(T.ArrayType, t, st.just(True)), st.builds(lambda v: T.MapType(STR, v), t),
    st.lists(st.tuples(st.sampled_from("abc"), t), min_size=1, max_size=3, unique_by=lambda f: f[0])
    .map(lambda fs: T.StructType([T.StructField(n, x) for n, x in fs]))), max_leaves=5)


def joined(*types):
    try:
        out = types[0]
        for t in types[1:]:
            out = join_types(out, t)
        return out
    except SchemaConflict:
        return None


@settings(max_examples=300, deadline=None)
@given(TYPES, TYPES, TYPES)
def test_lattice_laws(a, b, c):
    wrap = lambda t: T.StructType([T.StructField("v", t)])
    assert joined(a, a) == a
    ab, ba = joined(a, b), joined(b, a)
    assert (ab is None) == (ba is None)
    if ab is not None:
        assert widens(wrap(a), wrap(ab)) and widens(wrap(b), wrap(ab)) and widens(wrap(ba), wrap(ab))
        left, right = joined(ab, c), joined(b, c)
        right = None if right is None else joined(a, right)
        if left is not None and right is not None:
            assert widens(wrap(left), wrap(right)) and widens(wrap(right), wrap(left))


def test_conform_fills_and_widens_at_every_depth(spark):
    df = spark.createDataFrame([(1, [Row(x=1)], {"k": Row(x=2)}, None), (2, None, None, Row(p=5))],
                               "id int, a array<struct<x:int>>, m map<string,struct<x:int>>, s struct<p:int>")
    want = schema("id long, a array<struct<y:string,x:long>>, new date, m map<string,struct<x:long,y:int>>, s struct<p:long,q:int>")
    got = conform(df, want)
    assert got.schema.simpleString() == want.simpleString()
    assert [r.asDict(True) for r in got.orderBy("id").collect()] == [
        {"id": 1, "a": [{"y": None, "x": 1}], "new": None, "m": {"k": {"x": 2, "y": None}}, "s": None},
        {"id": 2, "a": None, "new": None, "m": None, "s": {"p": 5, "q": None}}]
    with pytest.raises(ValueError, match="no column"):
        conform(df, schema("id int"))
    with pytest.raises(ValueError, match="does not widen"):
        conform(df.select("id"), schema("id short"))


def test_union_of_versions(spark):
    a = spark.createDataFrame([(1, Row(x=1))], "id int, s struct<x:int>")
    b = spark.createDataFrame([(2**40, Row(y="t", x=2**40), "n")], "id long, s struct<y:string,x:long>, extra string")
    got = union_days(a, b, a)
    assert got.schema.simpleString() == "struct<id:bigint,s:struct<x:bigint,y:string>,extra:string>"
    assert sorted(str(r) for r in got.collect()) == sorted(str(r) for r in [
        Row(id=1, s=Row(x=1, y=None), extra=None), Row(id=2**40, s=Row(x=2**40, y="t"), extra="n"),
        Row(id=1, s=Row(x=1, y=None), extra=None)])


def place():
    return tempfile.mkdtemp(prefix="pf-grow-") + "/t", f"grow_{uuid.uuid4().hex[:8]}"


def versions(spark):
    v1 = spark.createDataFrame([(1, "d1", Row(x=1)), (2, "d2", Row(x=2))], "id int, day string, s struct<x:int>")
    v2 = spark.createDataFrame([(2**40, 1.5, "d2", Row(x=2**40, y="t")), (4, 2.5, "d3", None)],
                               "id long, extra double, day string, s struct<x:long,y:string>")
    return v1, v2


WANT = [(1, "d1", (1, None), None), (4, "d3", None, 2.5), (2**40, "d2", (2**40, "t"), 1.5)]


def content(df):
    return sorted((r["id"], r["day"], r["s"] and (r["s"]["x"], r["s"]["y"] if "y" in r["s"] else None), r["extra"])
                  for r in df.collect())


@pytest.mark.parametrize("named", [False, True])
def test_tables_keep_new_columns_and_fill_missing_ones(spark, named):
    path, name = place()
    target = dict(path=path, name=name) if named else dict(path=path)
    read = (lambda: spark.table(name)) if named else (lambda: read_table(spark, path))
    v1, v2 = versions(spark)
    write_table(v1, partition_by="day", **target)
    write_table(v2, partition_by="day", **target)                  # wider; day d1 keeps its old files
    assert content(read()) == WANT
    write_table(v1.where("day = 'd1'"), partition_by="day", **target)     # narrower again: filled
    assert content(read()) == WANT
    write_table(v2.where("day = 'd3'"), partition_by="day", mode="append", **target)
    assert sorted(r["id"] for r in read().collect()) == [1, 4, 4, 2**40]
    bad = v1.withColumn("extra", F.lit("text"))
    with pytest.raises(SchemaConflict, match="extra"):
        write_table(bad, partition_by="day", **target)
    assert read().count() == 4                                      # nothing was written
    if named:
        spark.sql(f"DROP TABLE {name}")


def test_foreign_table_keeps_its_other_partitions(spark):
    path, name = place()
    v1, _ = versions(spark)
    v1.write.partitionBy("day").option("path", path).saveAsTable(name)      # nothing said about overwriting
    write_table(v1.where("day = 'd1'"), name=name, partition_by="day")
    assert spark.table(name).count() == 2
    spark.sql(f"DROP TABLE {name}")


def test_managed_table_takes_new_columns_and_refuses_inner_change(spark):
    _, name = place()
    v1, v2 = versions(spark)
    write_table(v1, name=name, partition_by="day")
    write_table(v1.withColumn("extra", F.lit(1.5)), name=name, partition_by="day")
    assert [r["extra"] for r in spark.table(name).collect()] == [1.5, 1.5]
    with pytest.raises(ValueError, match="warehouse"):
        write_table(v2, name=name, partition_by="day")
    assert spark.table(name).count() == 2
    spark.sql(f"DROP TABLE {name}")


def test_replaced_table_starts_a_new_schema(spark):
    path, _ = place()
    v1, v2 = versions(spark)
    write_table(v1, path=path, partition_by=None)
    write_table(v2.drop("s"), path=path, partition_by=None)
    assert sorted(read_table(spark, path).columns) == ["day", "extra", "id"] and read_table(spark, path).count() == 2


def test_table_from_before_the_log_is_taken_up(spark):
    path, _ = place()
    v1, v2 = versions(spark)
    v1.write.partitionBy("day").parquet(path)
    write_table(v2, path=path, partition_by="day")
    assert content(read_table(spark, path)) == WANT


def test_two_writers_extend_the_schema_together(spark):
    path, _ = place()
    base = schema("id int")
    adds = [schema(f"id int, c{i} int") for i in range(6)]
    TB._evolve_path(spark, path, base, "parquet")
    threads = [threading.Thread(target=TB._evolve_path, args=(spark, path, s, "parquet")) for s in adds]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    number, found = TB._logged(spark, path)
    assert number == 7 and set(found.names) == {"id", *(f"c{i}" for i in range(6))}


def test_files_per_partition_do_not_follow_the_tasks(spark):
    path, name = place()
    df = spark.range(0, 4000, 1, 32).select("id", F.concat(F.lit("d"), (F.col("id") % 40).cast("string")).alias("day"))
    write_table(df, path=path, name=name, partition_by="day")
    detail = table_detail(spark, name).first()
    assert detail["num_files"] <= 80 and detail["num_rows"] == 4000 and detail["size_bytes"] > 0
    spark.sql(f"DROP TABLE {name}")


def test_names_of_every_pair_of_types_never_lose_a_type():
    for a, b in itertools.permutations([B, S, I, L, FL, DO], 2):
        found = joined(a, b)
        assert found is None or (joined(found, a) == found and joined(found, b) == found)
