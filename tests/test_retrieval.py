import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import Retrieval
from quarry.functions import columns as C
from quarry.operators import answer, assemble, evaluate, generate, retrieve

HIT = "qid string, chunk_id string, doc_id string, chunk_index int, title string, uri string, page_start int, page_end int, breadcrumb string, text string, score double, rank int"


def hit(rank, doc="d", text="some text", title="T", page=(3, 3), qid="q"):
    return (qid, f"c{rank}", doc, rank, title, f"{doc}.md", *page, "T > A", text, 1 - rank / 10, rank)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 8)).round(1)
    rows = [(f"c{k:03d}", f"d{k % 7}", [float(x) for x in v]) for k, v in enumerate(data)] + [("null", "d0", None), ("zero", "d0", [0.0] * 8), ("c000b", "d1", [float(x) for x in data[0]])]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, vector array<float>").repartition(5), data


def test_topk_equals_brute_force(spark, vectors):
    points, data = vectors
    asked = spark.createDataFrame([(f"q{k}", [float(x) for x in data[k]]) for k in (0, 5)], "qid string, vector array<float>")
    found = retrieve.dense_topk(points, asked, 10)
    unit = np.float32(data).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in (0, 5):
        scores = [(-round(float(s), 9), f"c{k:03d}") for k, s in enumerate(unit @ unit[q])]
        scores += [(scores[0][0], "c000b"), (0.0, "zero")]
        assert [r["chunk_id"] for r in found.where(F.col("qid") == f"q{q}").orderBy("rank").collect()] == [c for _, c in sorted(scores)[:10]]
    assert found.where("qid = 'q0' AND rank = 1").first()["score"] == pytest.approx(1.0)


def test_retrieve_caps_and_cuts(spark, vectors):
    points, data = vectors
    asked = spark.createDataFrame([("q", [float(x) for x in data[3]])], "qid string, vector array<float>")
    found = retrieve.retrieve(points, asked, Retrieval(40, 8, 2))
    per_doc = {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert sum(per_doc.values()) == 8 and max(per_doc.values()) <= 2
    assert retrieve.retrieve(points, asked, top_k=0).count() == 8 and retrieve.retrieve(points, asked, top_k=3).count() == 3
    shorter = [r["chunk_id"] for r in retrieve.retrieve(points, asked, top_k=3).orderBy("rank").collect()]
    assert shorter == [r["chunk_id"] for r in retrieve.retrieve(points, asked, top_k=6).orderBy("rank").collect()][:3]
    assert retrieve.dense_topk(points, asked.where("false"), 3).count() == 0 and retrieve.dense_topk(points.where("false"), asked, 3).count() == 0


def test_cap_keeps_the_order(spark):
    rows = spark.createDataFrame([("q", f"c{k}", d, k) for k, d in enumerate("aababc", 1)], "qid string, chunk_id string, doc_id string, rank int")
    assert [r["chunk_id"] for r in retrieve.cap_per_doc(rows, 2).orderBy("rank").collect()] == ["c1", "c2", "c3", "c5", "c6"]


def test_neighbours_and_lexical(spark):
    points = spark.createDataFrame([(f"c{k}", "d", k, t) for k, t in enumerate(["red fox", "blue fox fox", "green hen", "red hen"])], "chunk_id string, doc_id string, chunk_index int, text string")
    hits = points.where("chunk_id = 'c1'").select(F.lit("q").alias("qid"), "doc_id", "chunk_index", F.lit(1).alias("rank"))
    assert sorted(r["chunk_id"] for r in retrieve.with_neighbours(hits, points).collect()) == ["c0", "c1", "c2"]
    asked = spark.createDataFrame([("q", "fox")], "qid string, text string")
    assert [r["chunk_id"] for r in retrieve.bm25_topk(points, asked, 5).orderBy("rank").collect()] == ["c1", "c0"]


def test_rendering_and_budget(spark):
    hits = spark.createDataFrame([hit(1, title='say "hi"'), hit(2, page=(3, 5)), hit(3, page=(None, None)), hit(4), hit(5)], HIT)
    blocks = [r["block"] for r in assemble.rendered(hits).orderBy("rank").collect()]
    assert blocks[0] == "<document id=\"1\" title='say \"hi\"' uri=\"d.md\" page=\"3\">\nT > A\n\nsome text\n</document>"
    assert 'page="3-5"' in blocks[1] and "page=" not in blocks[2]
    each = len(blocks[3].split())
    found = assemble.assembled(hits, 3 * each + 2).first()
    assert len(found["chunks"]) == 3 and found["dropped"] == 2 and found["context"].count("<document") == 3
    assert len(assemble.assembled(hits, 1).first()["chunks"]) == 1


def drafts(spark, *rows):
    return spark.createDataFrame(rows, "qid string, answer string, citations array<int>, insufficient_context boolean, chunks array<struct<rank:int,chunk_id:string,doc_id:string,title:string,uri:string,page_start:int,text:string,score:double>>")


def test_citations(spark):
    chunks = [(k, f"c{k}", "d", "T", "u", 1, "x" * 300, 0.123456) for k in (1, 2)]
    rows = drafts(spark, ("a", "Leave is 25 days [1]. Also see [7] and [2][1].", [1, 9], False, chunks), ("b", "Not there.", [], True, chunks), ("c", "No marker.", [9], False, chunks), ("d", "x [1]", [], False, None), ("e", "Only listed", [2], None, chunks))
    found = {r["qid"]: r for r in answer.validated(rows).collect()}
    assert found["a"]["answer"] == "Leave is 25 days [1]. Also see and [2][1]." and found["a"]["numbers"] == [1, 2] and not found["a"]["refused"]
    assert found["a"]["cited"][0]["chunk_id"] == "c1" and len(found["a"]["cited"][0]["snippet"]) == 240 and found["a"]["cited"][0]["score"] == 0.1235
    assert found["b"]["answer"] == "Not there." and found["b"]["refused"] and found["b"]["cited"] == []
    assert found["c"]["answer"] == found["d"]["answer"] == answer.REFUSAL and found["c"]["refused"]
    assert found["e"]["numbers"] == [2] and not found["e"]["refused"]


def test_the_model_is_not_called_without_context(spark):
    def fail(question, context):
        raise AssertionError

    rows = spark.createDataFrame([("q", "why?", None)], "qid string, question string, context string").withColumn("chunks", F.lit(None).cast(drafts(spark).schema["chunks"].dataType))
    found = answer.validated(answer.drafted(rows, fail)).first()
    assert found["refused"] and found["answer"] == answer.REFUSAL


def golden(spark, *rows):
    return spark.createDataFrame(rows, evaluate.GOLDEN)


def test_metrics_by_hand(spark):
    items = golden(spark, ("g", "?", None, [("x/d.md", 2, None, None), ("d.md", 9, None, None)], "factual", "manual", None), ("h", "?", None, [("d.md", None, None, "SOME   text")], "factual", "manual", None), ("i", "?", None, [(None, None, "c5", None)], "factual", "manual", None))
    order = [5, 2, 7, 9]
    hits = spark.createDataFrame([(q, f"c{n}", "d", n, "T", "y/d.md", 1, 1, "", "some text", 0.5, k) for q in "gh" for k, n in enumerate(order, 1)], HIT)
    scores = evaluate.retrieval_scores(evaluate.first_ranks(items, hits))
    found = {r["qid"]: r for r in scores.collect()}
    assert (found["g"]["first_hit_rank"], found["g"]["reciprocal_rank"]) == (2, 0.5)
    assert [found["g"][f"recall_{k}"] for k in (1, 3, 5)] == [0.0, 0.5, 1.0] and [found["g"][f"hit_{k}"] for k in (1, 3)] == [0.0, 1.0]
    assert found["h"]["first_hit_rank"] == 1 and found["i"]["first_hit_rank"] is None and found["i"]["reciprocal_rank"] == 0
    summary = {r["metric"]: r["value"] for r in evaluate.retrieval_summary(scores).collect()}
    assert summary["mrr"] == 0.5 and summary["recall@5"] == pytest.approx(2 / 3)
    recalls = [summary[f"recall@{k}"] for k in evaluate.KS]
    assert recalls == sorted(recalls)
    assert [r["id"] for r in evaluate.misses(items, scores).collect()] == ["i"]


def test_answer_scores(spark):
    items = golden(spark, ("a", "?", None, [("d.md", 1, None, None)], "factual", "manual", None), ("b", "?", None, [("d.md", 1, None, None)], "factual", "manual", None), ("c", "?", None, [], "refusal", "manual", None))
    points = spark.createDataFrame([("c1", "d.md", 1, "x"), ("c2", "d.md", 2, "y")], "chunk_id string, uri string, chunk_index int, text string")
    answers = spark.createDataFrame([("a", False, [("c1",), ("c2",)]), ("b", True, []), ("c", True, [])], "qid string, refused boolean, cited array<struct<chunk_id:string>>")
    scores = evaluate.answer_scores(items, answers, points)
    found = {r["qid"]: r for r in scores.collect()}
    assert found["a"]["citation_precision"] == 0.5 and found["a"]["citation_hit"] and found["b"]["citation_precision"] is None and found["c"]["refusal_correct"]
    assert {r["metric"]: r["value"] for r in evaluate.answer_summary(scores).collect()} == {"false_refusal_rate": 0.5, "refusal_accuracy": 1.0, "citation_precision": 0.5, "citation_hit_rate": 0.5}


def test_gate(spark):
    table = lambda **m: spark.createDataFrame(list(m.items()) or [("x", 0.0)], "metric string, value double")
    both = lambda a, b: evaluate.compared(table(**{"recall@8": a, "mrr": 0.5}), table(**{"recall@8": b, "hit@1": 1.0, "judge_z": 0.1}))
    assert [r["metric"] for r in both(0.5, 1.0).collect()] == ["mrr", "recall@8", "hit@1", "judge_z"]
    assert evaluate.regressed(both(0.5, 1.0), 8, 0.05) and not evaluate.regressed(both(0.5, 0.55), 8, 0.0500001) and not evaluate.regressed(both(0.6, 0.5), 8, 0.0)


def test_golden_files(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"id": "a", "question": "q", "expected": [{"uri": "u", "span": "s"}]}\n\n{"id": "b", "question": "r", "kind": "refusal"}\n')
    rows = evaluate.read_golden(spark, str(path))
    assert rows.count() == 2 and rows.where(evaluate.expects_refusal()).first()["id"] == "b"
    assert len(evaluate.golden_digest(spark, str(path))) == 12
    evaluate.save_golden(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"id": "a", "question": "q", "expected": [{"uri": "u", "span": "s"}]}, {"id": "b", "question": "r", "kind": "refusal"}]
    path.write_text('{"id": "a", "question": "q"}\n{"id": "a", "question": "r"}\n')
    with pytest.raises(ValueError, match="a"):
        evaluate.read_golden(spark, str(path))


def test_candidates(spark):
    rows = spark.createDataFrame([(f"c{k}", k, "u.md", "T", "T", f"Sentence number {k} has quite a few words in it. And " * 2) for k in range(6)], "chunk_id string, chunk_index int, uri string, title string, breadcrumb string, text string")

    def propose(title, crumb, text, n):
        return [{"question": "Same?", "answer": "x", "span": text[:20].upper()}, {"question": f"About {text[:18]}?", "answer": "y", "span": "not in the text"}, {"question": "third", "answer": "", "span": ""}]

    made = generate.candidates(rows, propose, most_chunks=4).collect()
    assert [r["id"] for r in made] == ["syn-0001"] and made[0]["expected"][0]["span"]
    assert generate.candidates(rows, generate.first_sentences, most_chunks=4).count() >= 4


def test_judges_and_prompts(spark):
    rows = spark.createDataFrame([("a", "q?", "x", False, [("t1",)]), ("b", "r?", "y", True, []), ("c", "s?", "z", False, [])], "qid string, question string, answer string, refused boolean, chunks array<struct<text:string>>")
    items = golden(spark, *[(k, "?", "ref" if k == "a" else None, [], "factual", "manual", None) for k in "abc"])

    def judge(question, answer_, contexts, reference):
        return {"faith": float(len(contexts))} | ({"recall": 1.0} if reference else {})

    assert {r["metric"]: r["value"] for r in evaluate.judged(rows, items, judge).collect()} == {"judge_faith": 0.5, "judge_recall": 1.0}
    assert rows.select(answer.prompt("question", "answer")).first()[0] == answer.USER.format(context="x", question="q?")


def test_smoke(spark):
    wanted = spark.createDataFrame([("a", "d.md", "25", None), ("b", None, None, True), ("c", "e.md", None, None), ("d", None, "x", False)], "qid string, expect_file string, expect_text string, expect_refusal boolean")
    given = spark.createDataFrame([("a", "It is 25.", False, [("y/d.md",)]), ("b", "no", True, []), ("c", "z", False, [("y/d.md",)])], "qid string, answer string, refused boolean, cited array<struct<uri:string>>")
    assert {r["qid"]: r["passed"] for r in evaluate.smoke(wanted, given).collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_a_byte_pair_counter():
    from quarry.config import Chunking
    from quarry.operators import chunk
    from quarry.operators.htmldoc import block

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not __import__("os").path.exists(path):
        pytest.skip("no vocabulary file here")
    count = chunk.bpe_counter(path)()
    assert count("hello world") == 2
    found = chunk.fold("T", [block("paragraph", "Some words here. " * 100)], Chunking(40, 60, 6, 30), count)
    assert len(found) > 3 and all(count(c["text"]) <= 66 for c in found)


def test_all_scores_equal_the_expression(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "POINTS", 7)
    monkeypatch.setattr(retrieve, "ASKED", 3)
    vectors = [[float(i % 5 - 2), float(i % 3), 1.5] for i in range(40)] + [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], []]
    points = spark.createDataFrame(list(enumerate(vectors)), "chunk_id long, vector array<float>")
    queries = points.where("chunk_id % 4 = 0 or chunk_id > 38").select(F.col("chunk_id").cast("string").alias("qid"), "vector")
    found = retrieve.all_scores(points, queries)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    wanted = points.crossJoin(queries.withColumnRenamed("vector", "q")).select("qid", "chunk_id", C.cosine("vector", "q").alias("score"))
    rows = lambda df: sorted((r["qid"], r["chunk_id"], "null" if r["score"] is None else f"{r['score'] + 0.0:.9f}".replace("-0.000000000", "0.000000000")) for r in df.collect())
    assert rows(found) == rows(wanted)
    assert retrieve.all_scores(points, queries.where("false")).count() == 0 and retrieve.all_scores(points.where("false"), queries).count() == 0


def shuffled(node):
    """Rows that a plan's exchanges have written."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(node.plan())
    below = sum(shuffled(node.children().apply(k)) for k in range(node.children().size()))
    return below + (node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0)


def test_all_scores_shuffle_a_row_once_for_each_block_it_meets(spark):
    vectors = spark.range(3000).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("vector"))
    found = retrieve.all_scores(vectors.where("chunk_id < 600"), vectors.withColumnRenamed("chunk_id", "qid"))
    assert found.toArrow().num_rows == 600 * 3000
    assert shuffled(found._jdf.queryExecution().executedPlan()) == 600 + 3000


def test_all_scores_round_as_the_expression(spark):
    rng = np.random.default_rng(3)
    values = [0.1234565, -0.1234565, 0.0000005, -0.0000005, 4e-7, -4e-7, 1.0, -1.0, 0.0, -0.0, 1.0000005, 0.3333335, float("nan"), float("inf"), *rng.uniform(-1, 1, 2000).tolist(), *(rng.integers(-(10**7), 10**7, 2000) / 1e7).tolist()]
    wanted = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6)).collect()]
    assert list(map(repr, retrieve._rounded(np.array(values), 6).tolist())) == list(map(repr, wanted))
