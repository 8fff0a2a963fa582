"""Incremental ingest: what changed is parsed, chunked, embedded and indexed; what is gone is pruned; all of it in one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import chunk, embed
from quarry.operators.parse import parsed
from quarry.plans.store import SCHEMAS, Store, payload
from quarry.sources.files import scan_folder, uri_prefix

ERROR_CHARS = 4000


def config_of(settings: Settings) -> dict:
    return {"embedding_model": settings.embedding.model, "dims": settings.embedding.dims, "pipeline_version": settings.pipeline_version}


def current(settings: Settings) -> Column:
    """Whether a known document needs nothing, given its row as ``known`` and the item's hash as ``item_hash``."""
    k = F.col("known")
    same = [k["status"].isin("indexed", "empty"), k["content_hash"] == F.col("item_hash"), k["pipeline_version"] == settings.pipeline_version, k["embedding_model"] == settings.embedding.model, k["embedding_dims"] == settings.embedding.dims]
    test = same[0]
    for x in same[1:]:
        test = test & x
    return F.coalesce(test, F.lit(False))


def plan(items: DataFrame, known: DataFrame, is_current: Column) -> DataFrame:
    """Rows (uri, action): new, changed, unchanged or prune, from one full join on the uri. ``known`` are the rows that the scan answers for."""
    left = items.select("uri", F.col("content_hash").alias("item_hash"), F.lit(True).alias("there"))
    right = known.select("uri", F.struct(*known.columns).alias("known"))
    both = left.join(right, "uri", "full")
    action = F.when(F.col("there").isNull(), "prune").when(F.col("known").isNull(), "new").when(is_current, "unchanged").otherwise("changed")
    return both.select("uri", action.alias("action"), F.col("known.doc_id").alias("known_doc_id"))


def counts(planned: DataFrame) -> dict[str, int]:
    found = {r["action"]: r["count"] for r in planned.groupBy("action").count().collect()}  # four rows
    return {a: found.get(a, 0) for a in ("new", "changed", "unchanged", "prune")}


def index_files(store: Store, files: DataFrame, embedder: embed.Embedder, settings: Settings, *, pruned: DataFrame | None = None, make_counter: Callable | None = None) -> dict:
    """Parse, chunk, embed and index files, and drop documents (doc_id) that are gone. One failed file fails no other, and keeps its old points."""
    try:
        return _index(store, store.stage("parsed", parsed(files)), embedder, settings, pruned=pruned, make_counter=make_counter)
    finally:
        store.unstage()


def _index(store: Store, docs: DataFrame, embedder: embed.Embedder, settings: Settings, *, pruned: DataFrame | None, make_counter: Callable | None) -> dict:
    spark = store.spark
    good, bad = docs.where("error IS NULL"), docs.where("error IS NOT NULL")
    chunks = store.stage("chunks", chunk.chunk(good, settings.chunking, make_counter))
    # of the cache and of the known documents only what this run's keys may meet is opened
    keys = embed.with_keys(chunks, "embed_text", embedder.model, embedder.dims).select("key")
    cache = store.stage("cached", store.lookup("embedding_cache", keys))
    keyed, new = embed.cached_embed(chunks, cache, embedder, settings.embedding)
    new = store.stage("vectors", new)  # the model is called once
    stats = embed.embed_stats(keyed, embed.misses(keyed, cache, "embed_text"), settings.embedding).first().asDict()

    known = store.stage("known", store.lookup("documents", docs.select("doc_id")))
    now = F.current_timestamp()
    sizes = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    created = known.select("doc_id", F.col("created_at").alias("old_created_at"))
    rows = good.join(sizes, "doc_id", "left").join(created, "doc_id", "left").withColumns(
        {
            "chunk_count": F.coalesce("chunk_count", F.lit(0)),
            "pipeline_version": F.lit(settings.pipeline_version),
            "embedding_model": F.lit(embedder.model),
            "embedding_dims": F.lit(embedder.dims),
            "error": F.lit(None).cast("string"),
            "parsed_path": F.concat(F.lit("ir/"), F.col("doc_id")),
            "indexed_at": now,
            "created_at": F.coalesce("old_created_at", now),
            "updated_at": now,
        }
    )
    rows = rows.withColumn("status", F.when(F.col("chunk_count") > 0, "indexed").otherwise("empty")).select(*known.columns)
    # a failed document's other columns stay as they were
    was = known.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in known.columns if c != "doc_id"])
    fresh = {"source", "uri", "content_hash", "status", "error", "updated_at", "created_at"}
    failed = bad.join(was, "doc_id", "left").select(
        "doc_id",
        *[F.col(f"old_{c}").alias(c) for c in known.columns if c not in fresh and c != "doc_id"],
        "source",
        "uri",
        "content_hash",
        F.lit("failed").alias("status"),
        F.substring("error", 1, ERROR_CHARS).alias("error"),
        F.coalesce("old_created_at", now).alias("created_at"),
        now.alias("updated_at"),
    )
    gone = spark.createDataFrame([], "doc_id string") if pruned is None else pruned.select("doc_id")
    vectors = cache.unionByName(new.select(*cache.columns))
    points = embed.joined(payload(keyed, rows), vectors)
    done = good.select("doc_id").union(gone)
    store.commit(
        {
            "index": (points.select(*SCHEMAS["index"].fieldNames()), done),
            "documents": (rows.unionByName(failed), docs.select("doc_id").union(gone)),
            "ir": (good.select(*SCHEMAS["ir"].fieldNames()), done),
            "embedding_cache": (new.select(*cache.columns), new.select("key").limit(0)),
        }
    )
    errors = [(r["uri"], (r["error"] or "").split("\n")[0]) for r in bad.select("uri", "error").orderBy("uri").limit(1000).collect()]
    tally = rows.agg(F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "empty").alias("empty"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")).first()
    report = {"indexed": tally["indexed"], "empty": tally["empty"], "chunks": tally["chunks"], "failed": bad.count(), "errors": errors, "embed": stats}
    return report


def ingest(spark: SparkSession, store: Store, root: str, embedder: embed.Embedder, settings: Settings = Settings(), *, force: bool = False, prune: bool = True, dry_run: bool = False, make_counter: Callable | None = None) -> dict:
    """Bring the store in line with a folder; the report counts scanned, unsupported, unchanged, indexed, empty, failed, pruned and chunks.

    A dry run changes nothing and doesn't check the index's configuration. Pruning reaches documents below the folder only.
    """
    if not dry_run:
        store.guard(config_of(settings))
    files, unsupported = scan_folder(spark, root)
    known = store.read("documents").where(F.col("uri").startswith(uri_prefix(spark, root)))
    planned = plan(files, known, F.lit(False) if force else current(settings))
    if not dry_run:
        planned = store.stage("plan", planned)
    n = counts(planned)
    report = {"scanned": n["new"] + n["changed"] + n["unchanged"], "unsupported": unsupported, "unchanged": n["unchanged"], "to_index": n["new"] + n["changed"], "pruned": n["prune"] if prune else 0, "indexed": 0, "empty": 0, "failed": 0, "chunks": 0, "errors": []}
    if dry_run or not report["to_index"] + report["pruned"]:
        return report
    todo = files.join(planned.where(F.col("action").isin("new", "changed")).select("uri"), "uri", "left_semi")
    gone = planned.where("action = 'prune'").select(F.col("known_doc_id").alias("doc_id")) if prune else None
    return report | index_files(store, todo, embedder, settings, pruned=gone, make_counter=make_counter)


def reindex(store: Store, embedder: embed.Embedder, settings: Settings = Settings(), *, recreate: bool = False, make_counter: Callable | None = None) -> dict:
    """Chunk and index again from the stored documents; texts that are in the cache aren't embedded again."""
    if recreate:
        store.drop_index()
    store.guard(config_of(settings))
    docs = store.read("ir").withColumn("error", F.lit(None).cast("string"))
    try:
        return _index(store, store.stage("parsed", docs), embedder, settings, pruned=None, make_counter=make_counter)
    finally:
        store.unstage()


def delete_documents(store: Store, doc_ids: DataFrame) -> None:
    """Remove documents from all tables."""
    store.commit({name: (None, doc_ids.select("doc_id")) for name in ("index", "documents", "ir")})
