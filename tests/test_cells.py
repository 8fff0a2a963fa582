import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cells, retrieve
from tests.conftest import SMALL

AS = {"id_col": "vec_id", "vector_col": "embedding"}


def pairs(found):
    return {(r["qid"], r["vec_id"]): round(r["score"], 9) for r in found.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    vectors = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 16))
    return spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")


def test_recall_and_pruned_scans(spark, clustered, tmp_path):
    index = cells.CellIndex.build(clustered, str(tmp_path / "ix"), **AS, sample_rows=1000)
    queries = clustered.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    wanted, found = pairs(retrieve.dense_topk(clustered, queries, 10, **AS)), pairs(index.search(queries, 10))
    assert len(found.keys() & wanted.keys()) >= 0.9 * len(wanted)
    assert all(found[x] == wanted[x] for x in found.keys() & wanted.keys())
    assert index.probes < len(index.centroids) / 4
    one = index.search(queries.where("qid = 0"), 10, keep=("label",))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    scanned = spark.read.parquet(f"{index.path}/points").where(F.col("cell").isin([int(c) for c in np.argsort(-(index.centroids @ np.array(queries.where("qid = 0").first()["embedding"])))[: index.probes]])).count()
    assert one.count() == 10 and scanned < 2000 and one.columns == ["qid", "vec_id", "label", "score", "rank"]
    assert spark.read.parquet(f"{index.path}/points").count() == 4000  # every row is indexed
    again = cells.CellIndex.open(spark, index.path)
    assert pairs(again.search(queries, 10)) == found


def test_all_cells_are_the_exact_search(spark, tmp_path):
    points = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    queries = points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    index = cells.CellIndex.build(points, str(tmp_path / "ix"), **AS)
    wanted = pairs(retrieve.dense_topk(points, queries, 10, **AS))
    assert pairs(index.search(queries, 10, probes=10_000)) == wanted
    assert len(pairs(index.search(queries, 10)).keys() & wanted.keys()) >= 0.9 * len(wanted)


def test_odd_points(spark, tmp_path):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    queries = points.select(F.col("vec_id").alias("qid"), "embedding")
    index = cells.CellIndex.build(points, str(tmp_path / "ix"), **AS)
    assert [(r["vec_id"], r["rank"]) for r in index.search(queries.where("qid = 1"), 2).orderBy("rank").collect()] == [(1, 1), (4, 2)]
    assert spark.read.parquet(f"{index.path}/points").count() == 5
    empty = cells.CellIndex.build(points.where("false"), str(tmp_path / "none"), **AS)
    assert empty.search(queries.where("qid = 2"), 2).count() == 0
