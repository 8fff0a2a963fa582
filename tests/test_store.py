"""The store: merge on read, bytes written, concurrent writers, compaction under readers, and lookups by filters."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.plans import membership, store as stores
from quarry.sources.files import FileSystem


def docs(spark, ids, mark="a", blocks=0):
    rows = spark.createDataFrame([(i, f"{mark}{i}") for i in ids], "doc_id string, title string")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.sha2(F.concat("doc_id", k.cast("string")).cast("binary"), 256)), " ")
    return rows.withColumn("metadata", text if blocks else F.lit(None))


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id string")


def titles(table):
    return {r["doc_id"]: r["title"] for r in table.select("doc_id", "title").collect()}


def sizes(store):
    tree = FileSystem(store.spark).tree(store.root, True)
    return {p: n for p, n in tree if "/_log/" not in p}


def test_reads_equal_a_plain_model_through_merges(spark, tmp_path):
    store, rng, model = stores.Store(spark, str(tmp_path / "s"), buckets=4), random.Random(2), {}
    for step in range(9):
        gone, new = {str(rng.randrange(30)) for _ in range(3)}, {str(rng.randrange(30)) for _ in range(6)}
        store.commit({"documents": (docs(spark, sorted(new), f"v{step}-"), keys(spark, sorted(gone | new)))})
        model = {k: v for k, v in model.items() if k not in gone} | {k: f"v{step}-{k}" for k in new}
        assert titles(store.read("documents")) == model
    held = store.manifest()["tables"]["documents"]
    assert len(held["rows"]) < 9 and len(held["gone"]) <= stores.FANOUT  # merged by tiers
    some = sorted(model)[:5] + ["absent"]
    assert titles(store.lookup("documents", keys(spark, some))) == {k: v for k, v in model.items() if k in some}
    assert store.compact("documents", whole=True)
    held = store.manifest()["tables"]["documents"]
    assert len(held["rows"]) == 1 and not held["gone"] and held["rows"][0]["rows"] == len(model) and titles(store.read("documents")) == model
    assert not store.compact("documents", whole=True)


def test_bytes_in_proportion_to_changes(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    store.commit({"documents": (docs(spark, [str(k) for k in range(1000)], blocks=1), keys(spark, []))})
    first = sizes(store)
    store.commit({"documents": (docs(spark, ["7"], "new", blocks=1), keys(spark, ["7", "absent"]))})
    after = sizes(store)
    assert first.keys() <= after.keys()  # nothing is rewritten
    assert sum(after.values()) - sum(first.values()) < sum(first.values()) / 100
    assert store.read("documents").count() == 1000 and titles(store.read("documents").where("doc_id = '7'")) == {"7": "new7"}
    assert [g["rows"] for g in store.manifest()["tables"]["documents"]["gone"]] == [1]  # what no segment holds needs no tombstone


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (stores.Store(spark, str(tmp_path / "s"), buckets=2) for _ in range(2))
    one.commit({"documents": (docs(spark, ["a", "b", "c"]), keys(spark, []))})

    def meanwhile(change):
        """Commit ``change`` by the second writer while the first one's commit is under way."""
        write = stores.Store._segment

        def segment(self, *args):
            if self is one:
                monkeypatch.setattr(stores.Store, "_segment", write)
                two.commit(change)
            return write(self, *args)

        monkeypatch.setattr(stores.Store, "_segment", segment)

    meanwhile({"documents": (docs(spark, ["b"], "two-"), keys(spark, ["b"])), "embedding_cache": (spark.createDataFrame([("k",), ("l",)], "key string"), spark.createDataFrame([], "key string"))})
    one.commit({"documents": (docs(spark, ["a"], "one-"), keys(spark, ["a"])), "embedding_cache": (spark.createDataFrame([("k",), ("m",)], "key string"), spark.createDataFrame([], "key string"))})
    assert titles(one.read("documents")) == {"a": "one-a", "b": "two-b", "c": "ac"}
    assert sorted(r["key"] for r in one.read("embedding_cache").collect()) == ["k", "l", "m"]
    meanwhile({"documents": (None, keys(spark, ["c"]))})
    with pytest.raises(stores.ConcurrentCommitError, match="same keys of documents"):
        one.commit({"documents": (docs(spark, ["c"], "late-"), keys(spark, ["c"]))})
    assert titles(two.read("documents")) == {"a": "one-a", "b": "two-b"}


def test_a_dead_writer_locks_nothing_and_is_cleared(spark, tmp_path):
    now = [1000.0]
    dead, alive = (stores.Store(spark, str(tmp_path / "s"), lease=100, clock=lambda: now[0]) for _ in range(2))
    alive.commit({"documents": (docs(spark, ["a"]), keys(spark, []))})
    left = dead._segment("documents", stores.conformed(docs(spark, ["z"]), stores.SCHEMAS["documents"]), 64)  # written, never committed
    dead.stage("x", docs(spark, ["z"]))
    folder = lambda: set(alive.files.names(f"{alive.root}/documents")) | set(alive.files.names(f"{alive.root}/_stage"))
    alive.commit({"documents": (docs(spark, ["b"]), keys(spark, []))})
    assert left["id"] in folder() and titles(alive.read("documents")) == {"a": "aa", "b": "ab"}
    now[0] += 101
    alive.vacuum()
    assert not {f for f in folder() if f.startswith(dead._run)} and titles(alive.read("documents")) == {"a": "aa", "b": "ab"}


def test_readers_during_a_merge(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"), buckets=2)
    for k in range(2):
        store.commit({"documents": (docs(spark, [f"{k}", "x"], f"v{k}-"), keys(spark, [f"{k}", "x"]))})
    reading, other = store.read("documents"), stores.Store(spark, store.root)
    assert other.compact("documents", whole=True)
    assert titles(reading) == titles(store.read("documents")) == {"0": "v0-0", "1": "v1-1", "x": "v1-x"}


def test_keys_that_are_all_new_open_no_bucket(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key"))
    store.commit({"embedding_cache": (rows, rows.limit(0))})
    plan = lambda df: df._jdf.queryExecution().toString()
    new = spark.createDataFrame([("new-1",), ("new-2",), (None,)], "key string")
    found = store.lookup("embedding_cache", new)
    assert found.count() == 0 and "/embedding_cache/" not in plan(found)
    assert store.lookup("embedding_cache", rows.limit(5)).count() == 5
    assert store.lookup("ir", keys(spark, ["a"])).count() == 0  # no such table yet


def test_filters_have_no_false_negatives_and_few_false_positives(spark):
    held, size = spark.range(4000).select(F.col("id").cast("string").alias("key")), membership.blocks_for(4000)
    filters = membership.built(held, "key", size).withColumn("part", F.lit(0))
    sizes = spark.createDataFrame([(0, size)], "part int, blocks int")
    assert membership.maybe(held, "key", filters, sizes).count() == 4000
    assert membership.maybe(spark.range(4000, 24000).select(F.col("id").cast("string").alias("key")), "key", filters, sizes).count() < 200
