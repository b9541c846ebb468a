"""The pipeline's stages, the registered queries against DuckDB, and planted cases."""
import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


@pytest.mark.parametrize("name", ["op7_decontamination", "op8_line_dedup"])
def test_query_matches_oracle(spark, name):
    got = E.queries()[name](spark, SF).toArrow()
    want = duck(SF).sql(E.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert compare(got, want) == []


def test_native_operators_run_no_python(spark):
    for name in ("op5_sharding", "op7_decontamination", "op8_line_dedup"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "BroadcastNestedLoop")), name


def test_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline as C
    from protoflow.llm._tables import written

    base = spark.read.parquet(f"{SF}/documents.parquet")
    fill = " ".join(f"filler{i}" for i in range(80))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id = 0").collect()[0]["text"]
    planted = spark.createDataFrame(
        [(100000, fill, "en", "a", 0), (100001, fill + " tail", "en", "b", 0),
         (100002, "and now the text " + item + " with an end", "en", "c", 0), (100003, "12345 !!", "en", "d", 0),
         (100004, None, "en", "d", 0), (100005, "the ship sailed on the sea and the wind was high in the night", "en", "e", 0)],
        base.schema)
    docs = base.unionByName(planted)
    ids = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = written(out, name.replace(" ", "-"))
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not {100003, 100004} & ids["language ID"]
    assert {100000, 100001} & ids["n-gram Jaccard join"] == {100000}
    assert 100002 in ids["n-gram Jaccard join"] and 100002 not in ids["benchmark decontamination"]
    assert 100005 in ids["benchmark decontamination"]
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids["benchmark decontamination"]


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
