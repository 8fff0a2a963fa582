"""Approximate nearest neighbours by counting collisions of query-centred windows over single projections.

Each vector is projected onto some random lines, and each line has its vectors in a sorted array. A query opens a window around its own
projection on every line; windows grow with a radius that is multiplied in rounds (virtual rehashing: a wider window contains the narrower
one, so only the new rings are read). A vector that lies in the windows of enough lines is verified by its exact cosine. A query stops when as many as it
wants are verified within the radius: a vector at that distance or nearer falls into a window with probability ``P(|N(0, 1)| <= width)`` at
least, and the threshold is that binomial's ``missed`` quantile, which bounds the share of neighbours that are missed. A radius beyond the largest distance verifies
all that is left, so a search never ends short.

Scale: equal vectors are one entry with the smallest ids that a result can hold. Entries are dealt into parts and queries into blocks, by hash; a task holds one part's
sorted arrays and one block, both of bounded size, and gives the best of each query. A shuffle moves entries once for each block of queries (one, up to
``block_rows`` different query vectors) and queries once for each part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS, GROWTH = 0.4, 1.25  # of the first window at unit length, and from round to round


def threshold(lines: int, width: float, missed: float) -> int:
    """The most collisions that a vector within the radius falls short of with a probability of ``missed`` at most."""
    p, below = math.erf(width / math.sqrt(2)), 0.0
    for n in range(lines + 1):
        below += math.comb(lines, n) * p**n * (1 - p) ** (lines - n)
        if below > missed:
            return n
    return lines


class Index:
    """One part: a sorted array for each line. ``vectors`` are rows of doubles, without zero vectors."""

    def __init__(self, vectors: np.ndarray, lines: int, width: float, missed: float, seed: int):
        self.lines, self.width, self.least = lines, width, threshold(lines, width, missed)
        self.vectors, self.lengths = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], lines))
        unit = vectors / self.lengths[:, None]
        projected, self.unit = (unit @ self.axes).T, unit.astype(np.float32)
        order = np.argsort(projected, axis=1, kind="stable")
        # the sorted arrays one after the other, each shifted beyond the one before, so that one call finds a query's windows on all lines
        self.reach = float(np.abs(projected).max(initial=0)) + 1
        self.shift = 3 * self.reach * np.arange(lines)
        self.sorted = (np.take_along_axis(projected, order, axis=1) + self.shift[:, None]).ravel()
        self.ranks = np.empty(order.shape, np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, order, np.arange(len(vectors), dtype=self.ranks.dtype)[None, :], axis=1)

    def windows(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The first rank in each line's window, and the number of ranks."""
        ends = [np.searchsorted(self.sorted, np.clip(at + side * self.width * radius, -self.reach, self.reach) + self.shift) for side in (-1, 1)]
        return ends[0] - np.arange(self.lines) * len(self.vectors), ends[1] - ends[0]

    def collisions(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many windows each vector's rank lies: without a sign, ranks before the first are beyond any size."""
        kind = self.ranks.dtype
        inside = (self.ranks - first.astype(kind)[:, None]) < np.minimum(size, np.iinfo(kind).max).astype(kind)[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint16)

    def cosines(self, rows: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        """One formula for all, on the vectors as they are; equal pairs give equal results wherever they meet."""
        return (self.vectors[rows] * query).sum(axis=1) / (self.lengths[rows] * length)

    def search(self, query: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest, nearest first, ties by ``ids``."""
        n, length, radius = len(self.vectors), float(np.sqrt((query * query).sum())), RADIUS
        at = (query / length) @ self.axes
        seen, rows, scores = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0)
        while True:
            whole = radius > 2 or n <= k
            found = np.nonzero(~seen if whole else (self.collisions(*self.windows(at, radius)) >= self.least) & ~seen)[0]
            if len(found):
                seen[found] = True
                # a product of single precision tells which of them can be among the k; those are measured by the formula
                near = self.unit[found] @ (query / length).astype(np.float32)
                least = max(np.partition(near, -k)[-k] if len(near) > k else -2, scores[-1] if len(rows) == k else -2)
                found = found[near >= least - 1e-5]
                rows, scores = np.concatenate([rows, found]), np.concatenate([scores, self.cosines(found, query, length)])
                best = np.lexsort((ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            if whole or len(rows) == k and math.sqrt(max(0.0, 2 - 2 * scores[-1])) <= radius:
                return rows, scores
            radius *= GROWTH


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles, each divided by the power of two of its largest component: exact, and squares neither overflow nor vanish."""
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1))[1][:, None])


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no null, NaN or infinite component, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _sides(rows: int, most: int, cores: int) -> int:
    return max(1, -(-rows // most), min(cores, rows // 2048))


def nearest(points: DataFrame, asked: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", lines: int = 64, width: float = 1.0, missed: float = 0.01, part_rows: int = 16_384, block_rows: int = 65_536, seed: int = 11) -> DataFrame:
    """Rows (query_id, rank, id, score): for each row that ``asked`` selects the k nearest others by cosine, ties by id.

    ``asked`` is a condition on ``points``, which may have any other columns. Rows with a null id, or whose vector isn't ``usable``, take no part, as query or as candidate; vectors meet others of their
    own dimension only. Repeated rows count once, and a query's own id is no candidate. Equal vectors tie and go by id, however many they are. With fewer than k candidates all are given;
    a query without any gives no row, and an empty table an empty result. Memory is bounded by ``part_rows`` and ``block_rows``, not by the table.
    """
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x + F.lit(0).cast("float"))  # -0.0 becomes 0.0
    rows = points.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("key", F.unhex(F.sha2(F.array_join("vector", ",").cast("binary"), 256)))
    n, m = rows.agg(F.count("*"), F.count_if("asked")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts, blocks = _sides(n, part_rows, 4 * cores), max(1, -(-m // block_rows))

    def dealt(df: DataFrame, column: str, n: int, other: str, m: int) -> DataFrame:
        df = df.withColumn("dim", F.size("vector")).withColumn(column, F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    smallest = Window.partitionBy("key").orderBy("id")
    entries = rows.select("key", "vector", "id").withColumn("_n", F.dense_rank().over(smallest)).where(F.col("_n") <= k + 1)
    entries = entries.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("id")).alias("ids"))
    queries = rows.where("asked").groupBy("key").agg(F.first("vector").alias("vector"))
    left = dealt(entries, "part", parts, "block", blocks).groupBy("dim", "part", "block")
    right = dealt(queries, "block", blocks, "part", parts).groupBy("dim", "part", "block")
    kind = points.schema[id_col].dataType.simpleString()

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        ids = own.column("ids").combine_chunks()
        schema = pa.schema([("key", pa.binary()), ("id", ids.type.value_type), ("score", pa.float64())])
        if not own.num_rows or not asking.num_rows:
            return schema.empty_table()
        starts, flat = ids.offsets.to_numpy(), ids.values
        index = Index(_matrix(own.column("vector")), lines, width, missed, seed)
        least = flat.take(pa.array(starts[:-1])).to_pandas()
        least = least.rank(method="dense").to_numpy() if least.dtype == object else least.to_numpy()
        keys, at, scores = [], [], []
        for q, vector in enumerate(_matrix(asking.column("vector"))):
            for row, score in zip(*index.search(vector, least, k + 1)):
                each = range(starts[row], starts[row + 1])
                keys += [q] * len(each)
                at += each
                scores += [score] * len(each)
        return pa.table([asking.column("key").take(pa.array(keys, pa.int64())), flat.take(pa.array(at, pa.int64())), pa.array(scores, pa.float64())], schema=schema)

    found = left.cogroup(right).applyInArrow(search, f"key binary, id {kind}, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    hits = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_n", "id", "score"))).alias("hits"))
    # a vector that many queries share is a hot key here: a sort-merge join, which adaptive execution can split
    each = rows.where("asked").select("key", F.col("id").alias("query_id")).distinct().join(hits.hint("merge"), "key")
    own = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    each = each.select("query_id", F.posexplode(own).alias("rank", "hit"))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("id"), F.col("hit.score").alias("score"))
