"""Embedding with a cache: distinct missing texts are embedded in batches, in parallel partitions, and joined back by key."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import Embedding
from quarry.functions import columns as C

MOST_BATCH = 2048


class Embedder(Protocol):
    model: str
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """A deterministic unit vector of 32 numbers from a text's SHA-256: (byte - 128) / 128, scaled to length 1."""

    model: str = "hash-32"
    dims: int = 32

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = [(b - 128) / 128 for b in hashlib.sha256(t.encode()).digest()]
            length = math.sqrt(sum(x * x for x in raw)) or 1.0
            out.append([x / length for x in raw])
        return out


def hash_vector(text: Column | str) -> Column:
    """``HashEmbedder`` as an expression, in doubles."""
    digest = F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)
    raw = lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)
    return C.bound(digest, lambda d: C.unit(raw(d)))


class PermanentError(RuntimeError):
    """An error that trying again can't mend, such as a refused key or a bad request."""


def retried(call: Callable, *, attempts: int = 5, first_wait: float = 0.5, most_wait: float = 20.0, sleep: Callable[[float], None] = time.sleep):
    """Call until it works: exponential waits with jitter; permanent errors and the last one are raised."""
    for k in range(attempts):
        try:
            return call()
        except PermanentError:
            raise
        except Exception:
            if k == attempts - 1:
                raise
            sleep(random.uniform(0, min(most_wait, first_wait * 2**k)))


def embedded(keyed: DataFrame, embedder: Embedder, settings: Embedding = Embedding()) -> DataFrame:
    """Rows (key, text) to (key, vector), in as many partitions as a shuffle has; each has up to ``concurrency`` calls of the model under way, of ``batch_size`` texts."""
    size = min(settings.batch_size, MOST_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(settings.concurrency) as pool:
            for batch in batches:
                yield from pool.map(vectors, [batch.slice(at, size) for at in range(0, batch.num_rows, size)])

    def vectors(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(1).to_pylist()
        found = retried(lambda: embedder.embed(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(texts)} texts, but {len(found)} vectors")
        if any(len(v) != embedder.dims for v in found):
            raise ValueError(f"a vector hasn't {embedder.dims} dimensions")
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32()))], names=["key", "vector"])

    return keyed.select("key", "text").repartition("key").mapInArrow(run, "key string, vector array<float>")


def with_keys(rows: DataFrame, text: str, model: str, dims: int) -> DataFrame:
    return rows.withColumn("key", C.cache_key(text, F.lit(model), F.lit(dims)))


def misses(keyed: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (key, text) that the cache hasn't. Equal keys have equal texts, so any of them serves."""
    return keyed.groupBy("key").agg(F.first(text).alias("text")).join(cache.select("key"), "key", "left_anti")


def embed_stats(keyed: DataFrame, missed: DataFrame, settings: Embedding = Embedding(), text: str = "text") -> DataFrame:
    """One row: texts, hits, embedded, api_calls, tokens, usd. Repeats of a missing text within the run are hits."""
    texts = keyed.agg(F.count("*").alias("texts"))
    new = missed.agg(F.count("*").alias("embedded"), F.coalesce(F.sum(C.token_count("text")), F.lit(0)).cast("long").alias("tokens"))
    both = texts.crossJoin(new)  # one row each
    return both.select("texts", (F.col("texts") - F.col("embedded")).alias("hits"), "embedded", F.ceil(F.col("embedded") / settings.batch_size).alias("api_calls"), "tokens", cost(F.col("tokens"), settings).alias("usd"))


def cost(tokens: Column, settings: Embedding = Embedding()) -> Column:
    return F.round(tokens / 1e6 * settings.usd_per_million_tokens, 9)


def cached_embed(rows: DataFrame, cache: DataFrame, embedder: Embedder, settings: Embedding = Embedding(), text: str = "embed_text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``vector``, what is new for the cache). The new vectors should be stored before the rows are written, or they are made twice."""
    keyed = with_keys(rows, text, embedder.model, embedder.dims)
    made = embedded(misses(keyed, cache, text), embedder, settings)
    new = made.select("key", F.lit(embedder.model).alias("model"), F.lit(embedder.dims).alias("dims"), "vector", F.current_timestamp().alias("created_at"))
    return keyed, new


def joined(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("key", "vector"), "key").drop("key")
