import os

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.config import Settings, load
from quarry.operators import embed
from quarry.plans import ingest
from quarry.plans import store as stores
from quarry.sources.files import FileSystem, scan_folder
from quarry.streaming import arrivals

MD = "---\ntitle: Handbook\n---\n# Welcome\n\nAll staff read this.\n\n## Leave\n\nEveryone gets 25 days of paid leave.\n"
HTML = "<html><head><title>Wiki</title></head><body><h1>Start</h1><p>Get a laptop first.</p></body></html>"


class Counting:
    """The hash embedder; calls are counted in a file, since they happen in workers."""

    def __init__(self, path):
        self.model, self.dims, self.path = "hash-32", 32, str(path)

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("x" * len(texts))
        return embed.HashEmbedder().embed(texts)

    def calls(self):
        return os.path.getsize(self.path) if os.path.exists(self.path) else 0


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "handbook.md").write_text(MD)
    (root / "sub" / "wiki.html").write_text(HTML)
    (root / "notes.txt").write_text("no")
    (root / ".hidden.md").write_text("no")
    (root / "_under.md").write_text("# Under\n\nAn underscore is no reason to skip a file.\n")
    return root


@pytest.fixture
def setup(spark, tmp_path, folder):
    return stores.Store(spark, str(tmp_path / "store")), Counting(tmp_path / "calls"), str(folder)


def points(store):
    return {(r["title"], r["chunk_index"]): r["chunk_id"] for r in store.read("index").collect()}


def test_scan(spark, folder, tmp_path):
    files, unsupported = scan_folder(spark, str(folder))
    assert sorted(os.path.basename(r["uri"]) for r in files.collect()) == ["_under.md", "handbook.md", "wiki.html"] and unsupported == 1
    hidden, _ = scan_folder(spark, str(folder), include_hidden=True)
    assert hidden.count() == 4
    (tmp_path / "none").mkdir()
    assert scan_folder(spark, str(tmp_path / "none"))[0].count() == 0
    with pytest.raises(NotADirectoryError):
        scan_folder(spark, str(tmp_path / "missing"))


def test_incremental_steps(spark, setup):
    store, embedder, root = setup
    first = ingest.ingest(spark, store, root, embedder)
    assert (first["scanned"], first["unsupported"], first["indexed"], first["failed"], first["pruned"]) == (3, 1, 3, 0, 0)
    before, created = points(store), {r["uri"]: r["created_at"] for r in store.read("documents").collect()}
    assert len(before) == 4 and embedder.calls() == 4 and first["embed"]["embedded"] == 4

    again = ingest.ingest(spark, store, root, embedder)
    assert (again["unchanged"], again["indexed"], embedder.calls()) == (3, 0, 4)

    with open(f"{root}/handbook.md", "a") as f:
        f.write("\n<!-- x -->\n")
    edited = ingest.ingest(spark, store, root, embedder)
    after = points(store)
    assert (edited["unchanged"], edited["indexed"]) == (2, 1) and after.keys() == before.keys()
    assert embedder.calls() == 4 and edited["embed"]["hits"] == 2
    assert all((after[k] != before[k]) == (k[0] == "Handbook") for k in before)
    assert {r["uri"]: r["created_at"] for r in store.read("documents").collect()} == created

    os.remove(f"{root}/sub/wiki.html")
    dry = ingest.ingest(spark, store, root, embedder, dry_run=True)
    assert dry["pruned"] == 1 and points(store) == after
    kept = ingest.ingest(spark, store, root, embedder, prune=False)
    assert kept["pruned"] == 0 and points(store) == after
    gone = ingest.ingest(spark, store, root, embedder)
    assert gone["pruned"] == 1 and {k[0] for k in points(store)} == {"Handbook", "Under"}
    assert store.read("documents").count() == 2 and store.read("ir").count() == 2

    forced = ingest.ingest(spark, store, root, embedder, force=True)
    assert forced["indexed"] == 2 and embedder.calls() == 4

    re = ingest.reindex(store, embedder, recreate=True)
    assert re["indexed"] == 2 and embedder.calls() == 4 and len(points(store)) == 3
    assert store.read("documents").where("parsed_path IS NULL").isEmpty()

    ingest.delete_documents(store, store.read("documents").where("title = 'Under'").select("doc_id"))
    assert {k[0] for k in points(store)} == {"Handbook"}


def test_failures_stay_apart_and_are_tried_again(spark, setup):
    store, embedder, root = setup
    ingest.ingest(spark, store, root, embedder)
    before = points(store)
    with open(f"{root}/broken.pdf", "wb") as f:
        f.write(b"%PDF-broken")
    for _ in range(2):
        report = ingest.ingest(spark, store, root, embedder)
        assert report["failed"] == 1 and "PDF" in report["errors"][0][1] and points(store) == before
    row = store.read("documents").where("status = 'failed'").first()
    assert row["uri"].endswith("broken.pdf") and row["error"]


def test_guard(spark, setup):
    store, embedder, root = setup
    ingest.ingest(spark, store, root, embedder)
    other = Settings(pipeline_version=2)
    with pytest.raises(stores.IndexConfigMismatchError, match="pipeline_version"):
        ingest.ingest(spark, store, root, embedder, other)
    assert ingest.ingest(spark, store, root, embedder, other, dry_run=True)["to_index"] == 3


def test_store_reads(spark, setup):
    store, embedder, root = setup
    assert store.read("index").isEmpty() and store.config() is None
    ingest.ingest(spark, store, root, embedder)
    index, docs = store.read("index"), store.read("documents")
    doc = docs.where("title = 'Handbook'").first()
    assert [r["chunk_index"] for r in stores.scroll_doc(index, doc["doc_id"]).collect()] == [0, 1]
    assert stores.count_points(index) == 4 and stores.count_points(index, F.col("doc_id") == doc["doc_id"]) == 2
    assert stores.find_document(docs, "local", doc["uri"]).count() == 1
    assert stores.scroll(index, 2).count() == 2 and "vector" not in stores.scroll(index).columns
    assert len(FileSystem(spark).tree(f"{store.root}/index", True)) > 0


def test_streamed_arrivals(spark, setup, tmp_path):
    store, embedder, root = setup
    where = str(tmp_path / "checkpoint")
    arrivals.ingest_arrivals(spark, store, root, embedder, where).awaitTermination()
    assert {k[0] for k in points(store)} == {"Handbook", "Wiki"}
    with open(f"{root}/new.md", "w") as f:
        f.write("# New\n\nArrived later.\n")
    arrivals.ingest_arrivals(spark, store, root, embedder, where).awaitTermination()
    assert {k[0] for k in points(store)} == {"Handbook", "Wiki", "New"}


def test_windows_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    spark.sql("SELECT TIMESTAMP '2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, id) AS ts, 'a' AS event_type, 1.0D AS value FROM range(60)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = arrivals.event_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("counted").collect()) == [14, 22, 24]


def test_embedding_errors(spark):
    keyed = spark.createDataFrame([("k", "t")], "key string, text string")

    class Wrong(embed.HashEmbedder):
        def embed(self, texts):
            return [[1.0]]

    with pytest.raises(Exception, match="dimensions"):
        embed.embedded(keyed, Wrong()).collect()
    tried = []

    def flaky():
        tried.append(1)
        if len(tried) < 3:
            raise OSError
        return "ok"

    assert embed.retried(flaky, sleep=lambda _: None) == "ok" and len(tried) == 3

    def refused():
        tried.append(1)
        raise embed.PermanentError

    with pytest.raises(embed.PermanentError):
        embed.retried(refused, sleep=lambda _: None)
    assert len(tried) == 4


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("retrieval:\n  top_k: 5\n  unknown: 1\nchunking: {target_tokens: 10}\n")
    (tmp_path / ".env").write_text("# note\nexport QUARRY_RETRIEVAL__TOP_K=6\nQUARRY_PIPELINE_VERSION='3'\n")
    found = load(tmp_path / "s.yaml", tmp_path / ".env", {"QUARRY_PIPELINE_VERSION": "4", "OTHER": "1"})
    assert (found.retrieval.top_k, found.chunking.target_tokens, found.pipeline_version, found.retrieval.prefetch_k) == (6, 10, 4, 40)
    assert load(None, None, {}) == Settings()


def test_command_line(spark, setup, tmp_path, capsys, monkeypatch):
    store, _, root = setup
    monkeypatch.chdir(tmp_path)
    base = ["--store", store.root]
    assert cli.main([*base, "status"]) == 1 and cli.main([*base, "config"]) == 0
    assert cli.main([*base, "ingest", "--path", root]) == 0
    assert cli.main([*base, "status"]) == 0
    capsys.readouterr()
    assert cli.main([*base, "query", "How many days of paid leave?", "--json"]) == 0
    assert "25 days" in capsys.readouterr().out
    assert spark.read.parquet(f"{store.root}/traces").count() == 1
    golden = tmp_path / "golden.jsonl"
    golden.write_text('{"id": "a", "question": "How many days of paid leave?", "expected": [{"uri": "handbook.md", "span": "25 days"}]}\n\n{"id": "b", "question": "zzz qqq", "kind": "refusal"}\n')
    assert cli.main([*base, "eval", "--golden", str(tmp_path / "none.jsonl")]) == 2
    assert cli.main([*base, "eval", "--golden", str(golden), "--answers", "--save-baseline", str(tmp_path / "base.json"), "--out", str(tmp_path / "out")]) == 0
    assert cli.main([*base, "eval", "--golden", str(golden), "--compare", str(tmp_path / "base.json")]) == 0
    assert cli.main([*base, "generate-golden", "--out", str(tmp_path / "made"), "--max-chunks", "5"]) == 0
    assert cli.main([*base, "reindex", "--recreate", "--yes"]) == 0
