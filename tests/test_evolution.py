import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans import store as stores
from quarry.plans.evolution import Added, Dropped, Renamed, Retyped, UnknownSchemaError, upgraded, versions

FIRST = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("note", T.StringType())])
LAST = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("size", T.LongType()), T.StructField("note", T.IntegerType()), T.StructField("long", T.BooleanType())])
STEPS = [Renamed("name", "title"), Retyped("size", T.IntegerType(), "size * 1000"), Dropped("note", T.StringType()), Added("note"), Added("long", "size > 5000")]


def test_versions_go_back_from_the_newest():
    found = versions(LAST, STEPS)
    assert len(found) == 6 and {(f.name, f.dataType) for f in found[0].fields} == {(f.name, f.dataType) for f in FIRST.fields}
    assert set(found[3].fieldNames()) == {"doc_id", "title", "size"} and found[-1] == LAST
    assert versions(LAST, []) == [LAST]
    for wrong in (Added("absent"), Renamed("x", "absent"), Dropped("title", T.StringType())):
        with pytest.raises(ValueError, match="doesn't lead"):
            versions(LAST, [wrong])


def test_rows_go_through_the_steps(spark):
    old = spark.createDataFrame([("a", "A", 3, "x"), ("b", None, 7, None), ("c", "C", None, "z")], FIRST).withColumn("_seq", F.lit(1))
    found = upgraded(old, 1, LAST, STEPS)
    assert found.columns == [*LAST.fieldNames(), "_seq"] and [f.dataType for f in found.schema.fields[:-1]] == [f.dataType for f in LAST.fields]
    assert [tuple(r)[:-1] for r in found.orderBy("doc_id").collect()] == [("a", "A", 3000, None, False), ("b", None, 7000, None, True), ("c", "C", None, None, None)]
    same = spark.createDataFrame([("a", "A", 1, 2, True)], LAST)
    assert upgraded(same, 6, LAST, STEPS).collect() == same.collect() and upgraded(old.limit(0), 1, LAST, STEPS).count() == 0


def test_a_store_over_two_versions(spark, tmp_path, monkeypatch):
    def known(schema, steps):
        monkeypatch.setitem(stores.SCHEMAS, "documents", schema)
        monkeypatch.setitem(stores.HISTORY, "documents", steps)

    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id string")
    rows = lambda table: sorted(map(tuple, table.where("doc_id NOT LIKE 'more%'").select(*LAST.fieldNames()).collect()))
    store = stores.Store(spark, str(tmp_path / "s"), buckets=2)
    known(FIRST, [])
    store.commit({"documents": (spark.createDataFrame([("a", "A", 3, "x"), ("b", "B", 7, "y"), ("c", "C", 9, "z"), *((f"more{k}", "M", k, "") for k in range(30))], FIRST), keys())})
    before = set(store.files.names(f"{store.root}/documents"))
    known(LAST, STEPS)
    assert rows(store.read("documents")) == [("a", "A", 3000, None, False), ("b", "B", 7000, None, True), ("c", "C", 9000, None, True)]
    store.commit({"documents": (spark.createDataFrame([("b", "new", 1, 5, False)], LAST), keys("b", "c"))})  # tombstones reach older versions
    want = [("a", "A", 3000, None, False), ("b", "new", 1, 5, False)]
    assert rows(store.read("documents")) == want and len(store.manifest()["tables"]["documents"]["rows"]) == 2 and before <= set(store.files.names(f"{store.root}/documents"))
    assert rows(store.lookup("documents", keys("a", "c", "absent"))) == want[:1]
    plan = store.read("documents").where("title = 'A'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,A)" in plan and "EqualTo(title,A)" in plan and "size" not in plan  # filters and pruning reach the older files, under their names

    known(T.StructType([*LAST.fields, T.StructField("later", T.StringType())]), [*STEPS, Added("later")])
    assert "later" in store.read("documents").columns
    store.commit({"documents": (store.read("documents").where("doc_id = 'a'"), keys("a"))})
    known(LAST, STEPS)
    with pytest.raises(UnknownSchemaError, match="version 7.*knows 6"):
        store.read("documents")
    known(T.StructType([*LAST.fields, T.StructField("later", T.StringType())]), [*STEPS, Added("later")])
    assert store.upgrade() == {"documents": True} and store.upgrade() == {"documents": False}
    assert {s["schema"] for s in store.manifest()["tables"]["documents"]["rows"]} == {7} and rows(store.read("documents")) == want
