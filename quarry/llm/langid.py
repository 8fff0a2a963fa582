"""Language identification: nearest of several clustered centroids per language, by cosine over TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import free_name

BLOCK = 1 << 20  # characters whose n-grams are hashed at once


@dataclass(frozen=True)
class Settings:
    """``sample_per_lang`` and ``sample_total`` bound the labelled rows on which the centroids are clustered; inverse document
    frequencies count all labelled rows. ``reject_share`` times the lowest similarity that a centroid's own sample has is the
    similarity below which a text is rejected."""

    buckets: int = 8192
    clusters: int = 3
    sample_per_lang: int = 400
    sample_total: int = 4000
    rounds: int = 8
    reject_share: float = 0.5


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]  # of each centroid
    centroids: np.ndarray  # centroids x buckets, rows of length 1
    idf: np.ndarray
    floors: np.ndarray  # of each centroid: the similarity below which it rejects


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """The lower-case form of each letter's code point, 0 for all else."""
    global _letters
    if _letters is None:
        _letters = np.zeros(0x110000, np.uint32)
        for c in range(0x30000):
            if (x := chr(c)).isalpha():
                _letters[c] = ord(y) if len(y := x.lower()) == 1 else c
    return _letters


def counts(text: str | None, buckets: int) -> np.ndarray:
    """How often each bucket's n-grams of one to three letters occur in the whole text; the edges of words count as a letter."""
    out, text = np.zeros(buckets, np.int64), text or ""
    table, m = _letter_table(), np.uint32(buckets)
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - 2) : at + BLOCK]
        c = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate([np.zeros(1 if at == 0 else 0, np.uint32), c, np.zeros(1 if at + BLOCK >= len(text) else 0, np.uint32)])
        seen = 0 if at == 0 else 2  # characters that the block before has counted
        pairs = c[:-1] * np.uint32(2654435761) + c[1:]
        triples = pairs[:-1] * np.uint32(2246822519) + c[2:]
        is_letter = c > 0
        one = c[seen:][is_letter[seen:]] * np.uint32(3266489917)
        start = max(seen - 1, 0)
        two = (pairs * np.uint32(668265263))[start:][(is_letter[:-1] | is_letter[1:])[start:]]
        three = (triples * np.uint32(374761393))[is_letter[1:-1]]
        for grams in (one, two, three):
            out += np.bincount(((grams ^ (grams >> np.uint32(15))) % m).astype(np.int64), minlength=buckets)
    return out


def _weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(tf, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _cluster(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; the centroids and each point's. There are ``k``, or as many as there are different points.

    It begins from points spread evenly by their similarity to the mean. A centroid that loses all its points takes the half of the largest cluster that is farther
    from its centroid; the last round keeps what it has split.
    """
    k = min(k, len(np.unique(x, axis=0)))
    order = np.argsort(x @ x.mean(0), kind="stable")
    c = x[order[[(2 * j + 1) * len(x) // (2 * k) for j in range(k)]]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            largest = np.argmax(np.bincount(own, minlength=k))
            members = np.flatnonzero(own == largest)
            own[members[np.argsort(x[members] @ c[largest], kind="stable")[: len(members) // 2]]] = j
        c = np.array([x[own == j].mean(0) for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, own


def fit(docs: DataFrame, learnable: Column, *, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Learn from the rows that are ``learnable`` and have a text and a language; None if there are none.

    Document frequencies come from all those rows, summed on the executors. The centroids come from a sample of at most
    ``sample_per_lang`` rows a language (the smallest hashes of id and text) and ``sample_total`` in all.
    """
    n_buckets = settings.buckets
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, per = np.zeros(n_buckets, np.int64), 0, {}
        for batch in batches:
            for text in batch.column(1):
                df += counts(text.as_py(), n_buckets) > 0
            for lang in batch.column(0).to_pylist():
                per[lang] = per.get(lang, 0) + 1
            n += batch.num_rows
        if n:
            kinds = [*["df"] * n_buckets, *["lang"] * len(per)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([*map(str, range(n_buckets)), *per]), pa.array([*df.tolist(), *per.values()], pa.int64())], names=["kind", "name", "n"])

    totals = rows.select("lang", "text").mapInArrow(frequencies, "kind string, name string, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")).collect()
    langs = {r["name"]: r["n"] for r in totals if r["kind"] == "lang"}
    if not langs:
        return None
    df = np.zeros(n_buckets)
    for r in totals:
        if r["kind"] == "df":
            df[int(r["name"])] = r["n"]
    idf = np.log((1 + sum(langs.values())) / (1 + df)).astype(np.float32) + np.float32(0.05)
    bound = max(1, min(settings.sample_per_lang, settings.sample_total // len(langs)))

    # hashes are uniform: twice the bound's share of a language's rows holds the bound with near certainty, and the driver cuts the rest
    share = F.lit(0)
    for lang, n in langs.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, 2 * bound / n) * (1 << 31))).otherwise(share)
    picked = rows.where(F.pmod("h", F.lit(1 << 31)) < share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(x.as_py(), n_buckets) for x in batch.column(1)]
            at = [np.flatnonzero(x) for x in found]
            cols = [batch.column(0), batch.column(2), pa.array([a.astype("<u2" if n_buckets <= 65536 else "<u4").tobytes() for a in at], pa.binary()), pa.array([x[a].astype("<f4").tobytes() for x, a in zip(found, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "h", "at", "tf"])

    sample: dict[str, list] = {}
    few = picked.mapInArrow(features, "lang string, h long, at binary, tf binary").repartition(4)  # the iterator runs a job for each partition
    for r in few.toLocalIterator():
        sample.setdefault(r["lang"], []).append((r["h"], bytes(r["at"]), bytes(r["tf"])))
    names, centroids, floors = [], [], []
    for lang in sorted(sample):
        own = sorted(sample[lang])[:bound]
        tf = np.zeros((len(own), n_buckets), np.float32)
        for i, (_, at, values) in enumerate(own):
            tf[i, np.frombuffer(at, "<u2" if n_buckets <= 65536 else "<u4")] = np.frombuffer(values, "<f4")
        x = _weigh(tf[tf.any(1)], idf)
        if not len(x):
            continue
        c, member = _cluster(x, settings.clusters, settings.rounds)
        for j in range(len(c)):
            near = x[member == j] @ c[j]
            names.append(lang)
            centroids.append(c[j])
            floors.append(settings.reject_share * max(0.0, float(near.min())))
    return Model(tuple(names), np.array(centroids, np.float32), idf, np.array(floors, np.float32)) if names else None


def predict(texts: pd.Series | list, model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """The language of the nearest centroid, the cosine to it, and whether it is too far from it; ``und``, 0 and True without a letter."""
    langs, scores, rejected = [], [], []
    for at in range(0, len(texts), 128):
        part = texts[at : at + 128]
        if model is None:
            langs, scores, rejected = langs + ["und"] * len(part), scores + [0.0] * len(part), rejected + [True] * len(part)
            continue
        tf = np.zeros((len(part), len(model.idf)), np.float32)
        for i, text in enumerate(part):
            tf[i] = counts(text, len(model.idf))
        near = _weigh(tf, model.idf) @ model.centroids.T
        best = np.argmax(near, axis=1)
        for i, j in enumerate(best):
            some = tf[i].any()
            langs.append(model.langs[j] if some else "und")
            scores.append(float(min(1.0, max(0.0, near[i, j]))) if some else 0.0)
            rejected.append(bool(not some or near[i, j] < model.floors[j]))
    return langs, scores, rejected


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with a last column, a struct of ``lang``, ``score`` and ``rejected``. It is called ``_langid``, with underscores after it
    while ``docs`` has such a column.

    A null or empty text, or one without a letter, has the language ``und``, the score 0, and is rejected; so does every text without a
    model. A very long text is read whole, in blocks. Of centroids that are equally near, the first one counts. Repeated rows have the same result; an empty table
    gives an empty one.
    """
    shared, place, name = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), free_name(docs, "_langid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = predict(batch.column(place).cast(pa.string()).to_pylist(), shared.value)
            found = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang", "score", "rejected"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL("lang string, score double, rejected boolean"))])
    return docs.mapInArrow(run, schema)
