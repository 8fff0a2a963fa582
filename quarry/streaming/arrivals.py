"""Files as they arrive, indexed batch by batch: a stream of new files, and one of changes.

``arrivals`` tells files by path: an edited file isn't delivered again, and a deleted one isn't noticed. ``ingest_changes`` follows both, on file systems that keep times of folders.
``plans.ingest`` stays the authority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.config import Settings
from quarry.operators.embed import Embedder
from quarry.operators.parse import supported
from quarry.plans.ingest import config_of, index_files
from quarry.plans.store import Store
from quarry.sources.files import FileSystem, described, uri_prefix
from quarry.sources.folders import contents, listed

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, root: str, *, most_files: int = 1000) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(root)
    return stream.where(supported("path"))


def ingest_arrivals(spark: SparkSession, store: Store, root: str, embedder: Embedder, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Index all files that have arrived since the checkpoint, then stop. A batch that is delivered again replaces its own documents, so it counts once."""
    store.guard(config_of(settings))

    def batch(files: DataFrame, _: int) -> None:
        index_files(store, described(files), embedder, settings)

    return arrivals(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_changes(spark: SparkSession, store: Store, root: str, embedder: Embedder, checkpoint: str, settings: Settings = Settings(), **options: object) -> StreamingQuery:
    """Bring the store in line with what has changed below a folder since the checkpoint, then stop: new and edited files are indexed, and documents below it whose files are gone are
    dropped where a folder tells that something in it went or came. A batch that is delivered again does the same again. Only supported files that changed are read."""
    store.guard(config_of(settings))

    def batch(rows: DataFrame, _: int) -> None:
        try:
            changed = store.stage("changed", rows)
            files = described(contents(changed.where(supported("path"))))
            gone = None
            if changed.where("is_folder").limit(1).count():
                there = listed(spark, root, **options).where("NOT is_folder").select(F.col("path").alias("uri"))
                known = store.read("documents").where(F.col("uri").startswith(uri_prefix(spark, root)))
                gone = store.stage("gone", known.join(there, "uri", "left_anti").select("doc_id"))
            index_files(store, files, embedder, settings, pruned=gone)
        finally:
            store.unstage()

    stream = listed(spark, root, stream=True, **options)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, *, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Trace-like events counted by type in windows; works on a stream with a watermark and on a table."""
    kind = events.schema["ts"].dataType
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events  # a watermark needs a time zone
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")


def streamed_counts(spark: SparkSession, path: str, folder: str, **how: str) -> DataFrame:
    """``event_counts`` of a table read as a stream: all that is there, in batches. Each batch writes the windows that it changed, under its number, so that a batch that is
    repeated changes nothing and the watermark frees the state of windows that are over; of a window the last batch counts. The state is kept in the folder too, so that a
    later call goes on."""
    reader, (above, _, name) = spark.readStream.schema(spark.read.parquet(path).schema), path.rpartition("/")
    # a stream reads folders: of a table that is one file, that with the file's name
    events = reader.parquet(path) if FileSystem(spark).is_folder(path) else reader.option("pathGlobFilter", name).parquet(above)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    counts = event_counts(events, **how)
    counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if not FileSystem(spark).is_folder(f"{folder}/changes"):
        return spark.createDataFrame([], counts.schema)
    changes = spark.read.schema(counts.schema.add("batch", "long")).parquet(f"{folder}/changes")
    last = changes.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return last.select("start", "event_type", "last.n", "last.total")
