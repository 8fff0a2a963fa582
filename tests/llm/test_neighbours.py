"""Nearest neighbours against brute force, recall, ties and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import neighbours, queries
from tests.conftest import SMALL


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, asked, k):
    """{query: [(score, id), ...]} over distinct (id, vector)."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    found = {}
    for q, a in rows:
        if asked(q):
            x = np.array(a, float)
            scores = [(-float((x * np.array(b, float)).sum() / (np.sqrt((x * x).sum()) * np.sqrt((np.array(b, float) ** 2).sum()))), i) for i, b in rows if i != q and len(b) == len(a)]
            found[q] = sorted(scores)[:k]
    return found


def test_recall_over_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    wanted = brute(rows, lambda i: i % 50 == 0, 5)
    found = queries.op11_nearest(spark, SMALL)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == wanted.keys() and all(len(x) == 5 and x == sorted(x) for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)


@pytest.mark.parametrize("dims", [8, 96])
def test_recall_of_the_search_itself(dims):
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((30, dims))
    vectors = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.standard_normal((3000, dims))
    index, ids, hits, verified = neighbours.Index(vectors, 64, 1.0, 0.01, 11), np.arange(3000), 0, 0
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosines = index.cosines
    for q in range(0, 3000, 60):
        index.cosines = lambda rows, *more: (seen.append(len(rows)), cosines(rows, *more))[1]
        seen = []
        rows, scores = index.search(vectors[q], ids, 6)
        verified += sum(seen)
        hits += len(set(rows) & set(np.argsort(-(unit @ unit[q]), kind="stable")[:6]))
        assert np.allclose(scores, unit[rows] @ unit[q])
    assert hits >= 0.95 * 6 * 50
    assert verified < 0.5 * 50 * 3000  # collisions leave most vectors unverified


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = {i: [float(np.float32(x)) for x in rng.standard_normal(4)] for i in range(60)}
    rows = list(vectors.items())
    rows += [(100 + i, vectors[0]) for i in range(30)] + [(200, [2.0 * x for x in vectors[0]])]  # copies beyond k, and a scaled one
    rows += [(300, None), (310, []), (320, [0.0] * 4), (330, [1.0, None, 0.0, 0.0]), (340, [float("nan"), 1.0, 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0, 1.0]), (None, vectors[3])]
    rows += [(360, [1.0, 2.0]), (361, [2.0, 1.0]), (370, [1.0, 0.0, 0.0]), (380, [-0.0, 1.0, 0.0, 0.0]), (381, [0.0, 1.0, -0.0, 0.0]), (5, vectors[5])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, key string, part string")
    wanted = brute(rows, lambda i: i % 10 == 0, 5)
    for how in ({}, {"part_rows": 20, "block_rows": 4}):
        found = neighbours.nearest(df, F.col("vec_id") % 10 == 0, **how).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((round(-r["score"], 12), r["id"]))
        assert got == {q: [(round(s, 12), i) for s, i in x] for q, x in wanted.items() if x}
    assert got[0][:3] == [(-1.0, 100), (-1.0, 101), (-1.0, 102)] and got[360] == [(-0.8, 361)] and 370 not in got
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    extreme = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e-200, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["id"], round(r["score"], 9)) for r in neighbours.nearest(extreme, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1.0), (2, round(math.sqrt(0.5), 9))]


def test_threshold_is_a_binomial_quantile():
    p = math.erf(1 / math.sqrt(2))
    least = neighbours.threshold(64, 1.0, 0.01)
    below = [sum(math.comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(n)) for n in (least, least + 1)]
    assert below[0] <= 0.01 < below[1]
