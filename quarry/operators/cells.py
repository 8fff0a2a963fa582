"""Vector search by an inverted file: points are kept by the cell of their nearest centroid, and a query reads the cells nearest to it.

Centroids come from spherical k-means on a bounded sample; every point is assigned and written, cells being partition values, so a search's scan is pruned to the probed
cells. What is read is ranked by exact cosines. How many cells a query probes is measured on the sample when the index is built, for a wanted recall; probing all cells is the
exact search, and ``retrieve.dense_topk`` stays beside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.retrieve import BLOCK, MOST_QUERIES, _matrix, _unit, ranked
from quarry.sources.files import FileSystem

SAMPLE_ROWS = 20_000  # that k-means sees, chosen by a hash of the id
MOST_CELLS = 4096
TRIED = 200  # sampled queries that the number of probes is measured with


def centroids(vectors: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors, by Lloyd's rounds from the first different vectors. A cell that loses all of its members takes the vector that is farthest from its centroid."""
    found = np.unique(vectors, axis=0)
    found = found[np.random.default_rng(7).permutation(len(found))[:cells]].copy()
    for _ in range(rounds):
        scores = vectors @ found.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        empty = np.flatnonzero(np.bincount(own, minlength=len(found)) == 0)
        if len(empty):
            sums[empty] = vectors[np.argsort(scores.max(axis=1), kind="stable")[: len(empty)]]
        found = _unit(sums)
    return found


def probes_for(vectors: np.ndarray, found: np.ndarray, recall: float, k: int = 10) -> int:
    """The fewest cells to probe so that sampled queries find ``recall`` of their k nearest in the sample."""
    if len(vectors) < 2:
        return 1
    asked = vectors[:: max(1, len(vectors) // TRIED)][:TRIED]
    nearest = np.argsort(-(asked @ vectors.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ found.T), axis=1, kind="stable"), axis=1, kind="stable")  # of each cell in each query's order
    at = np.sort(np.take_along_axis(place, (vectors @ found.T).argmax(axis=1)[nearest], axis=1).ravel())
    return int(at[min(len(at), int(np.ceil(recall * len(at)))) - 1]) + 1


@dataclass(frozen=True)
class CellIndex:
    """Points under ``path``: ``points/cell=N`` (their own columns), and ``about.json`` with the centroids and the measured number of probes."""

    path: str
    id_col: str
    vector_col: str
    centroids: np.ndarray
    probes: int
    schema: T.StructType

    @staticmethod
    def build(points: DataFrame, path: str, *, id_col: str = "chunk_id", vector_col: str = "vector", cells: int | None = None, sample_rows: int = SAMPLE_ROWS, recall: float = 0.95) -> CellIndex:
        """Index every row of ``points``: those without a vector, and zero vectors, are in the cell -1, which no search reads, since they have no direction. There are about as many cells as a
        cell has rows, up to ``MOST_CELLS``, unless given."""
        rows = points.where(F.col(vector_col).isNotNull())
        n = rows.count()
        sample = rows.select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).toArrow()  # bounded
        vectors = _unit(_matrix(sample.column(1).combine_chunks())) if sample.num_rows else np.zeros((0, 1))
        vectors = vectors[np.abs(vectors).sum(axis=1) > 0]
        found = centroids(vectors, cells or int(np.clip(np.sqrt(n), 1, MOST_CELLS))) if len(vectors) else np.zeros((0, 1))
        index = CellIndex(path, id_col, vector_col, found, probes_for(vectors, found, recall), T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())]))
        at = points.columns.index(vector_col)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, cell = batch.column(at), np.full(batch.num_rows, -1, np.int32)
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                if len(there) and len(found):
                    own = _unit(_matrix(column.take(pa.array(there))))
                    cell[there] = np.where(np.abs(own).sum(axis=1) > 0, (own @ found.T).argmax(axis=1), -1)
                yield batch.append_column("cell", pa.array(cell))

        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        dealt = points.mapInArrow(assigned, f"{kind}, cell int").hint("rebalance", F.col("cell"))
        dealt.write.partitionBy("cell").parquet(f"{path}/points")
        about = {"id": id_col, "vector": vector_col, "probes": index.probes, "centroids": found.tolist(), "schema": index.schema.jsonValue()}
        FileSystem(points.sparkSession).replace(f"{path}/about.json", json.dumps(about))
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> CellIndex:
        about = json.loads(FileSystem(spark).read(f"{path}/about.json"))
        return CellIndex(path, about["id"], about["vector"], np.array(about["centroids"]), about["probes"], T.StructType.fromJson(about["schema"]))

    def search(self, queries: DataFrame, k: int, *, qid: str = "qid", probes: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Rows (qid, id, *keep, score, rank): the k points of the highest cosine among the ``probes`` cells nearest to each query; ties by id. The queries, a stated set, go to all executors in parts of about ``MOST_QUERIES``."""
        spark, asked = queries.sparkSession, queries.select(qid, self.vector_col).where(F.col(self.vector_col).isNotNull())
        parts, found = max(1, -(-asked.count() // MOST_QUERIES)), None
        for part in range(parts):
            own = self._scored(spark, asked.where(F.pmod(F.xxhash64(qid), F.lit(parts)) == part), k, qid, min(probes or self.probes, max(1, len(self.centroids))), keep)
            found = own if found is None else found.unionByName(own)
        return ranked(found, k, qid=qid, id_col=self.id_col)

    def _scored(self, spark: SparkSession, asked: DataFrame, k: int, qid: str, probes: int, keep: tuple[str, ...]) -> DataFrame:
        rows = asked.toArrow()
        matrix = _unit(_matrix(rows.column(1).combine_chunks())) if rows.num_rows else np.zeros((0, 1))
        near = np.argpartition(-(matrix @ self.centroids.T), probes - 1, axis=1)[:, :probes] if len(matrix) and len(self.centroids) else np.zeros((len(matrix), 0), int)
        by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((matrix, by_cell))
        points = spark.read.schema(self.schema).parquet(f"{self.path}/points").where(F.col("cell").isin(sorted(by_cell)))  # prunes folders
        names, q_type = rows.column(0).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(0).type), asked.schema[qid].dataType.simpleString()
        extra = "".join(f", `{c}` {points.schema[c].dataType.simpleString()}" for c in keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every, cells = shared.value
            for batch in batches:
                cell = batch.column(1).to_numpy(zero_copy_only=False)
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    own = batch.take(pa.array(at))
                    vectors, n = _unit(_matrix(own.column(2))).T, min(k, len(at))
                    result = pa.RecordBatch.from_arrays([own.column(0), *own.columns[3:]], names=["id", *keep])
                    for start in range(0, len(cells[int(c)]), BLOCK):
                        who = cells[int(c)][start : start + BLOCK]
                        scores = every[who] @ vectors
                        edge = np.partition(scores, len(at) - n, axis=1)[:, len(at) - n]
                        q, p = np.nonzero(scores >= edge[:, None] - 1e-12)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(who[q])), *result.take(pa.array(p)).columns, pa.array(scores[q, p])], names=[qid, "id", *keep, "score"])

        kind = points.schema[self.id_col].dataType.simpleString()
        return points.select(self.id_col, "cell", self.vector_col, *keep).mapInArrow(run, f"{qid} {q_type}, id {kind}{extra}, score double").withColumnRenamed("id", self.id_col)
