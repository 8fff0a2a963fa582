"""The pipeline's stages, each against a plain version of itself on its own input."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from quarry.llm import langid, pii, queries
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """{name: (input, output)} of each stage over the small documents and some odd rows."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "", None, None, 0), (-3, "123 456", "en", "src0", 7), (-4, "mail me: a@b.example or +1 (017) 555-7713", "en", None, 40)], documents.schema)
    docs, out = documents.union(odd).union(documents.where("doc_id = 0")), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert after.columns == before.columns + ["copy"] * (name == "mixture")


def test_language_stage(spark, stages):
    before, after = stages["language"]
    model = langid.fit(before, ~queries.held_out("doc_id"))
    all_ = before.collect()
    rejected = langid.predict([r["text"] for r in all_], model)[2]
    assert rows(after) == sorted(repr(tuple(r)) for r, no in zip(all_, rejected, strict=True) if not no)
    assert 0 < sum(rejected) < 0.03 * len(all_) + 4


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    all_ = sorted((r["doc_id"], r["text"]) for r in before.collect())
    group = brute.closed(len(all_), brute.similar(all_))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({all_[g][0] for g in group})


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert rows(after) == sorted(repr(tuple(r)) for r in before.collect() if not brute.contamination(r["text"], items)[1])


def test_personal_data_stage(stages):
    before, after = stages["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert len(texts) == before.count()
    names, rows_ = list(brute.PERSONAL), before.collect()
    keys = brute.disclosing_keys([r["text"] for r in rows_])
    for r in rows_:
        spans = brute.personal(r["text"])
        if secret := brute.secrets(r["text"], keys):
            assert texts[r["doc_id"]].count("[SECRET]") == len(secret)
        elif not spans:
            assert texts[r["doc_id"]] == r["text"]
        else:
            assert not [s for s in brute.personal(texts[r["doc_id"]])] and all(pii.LABELS[names[k]] in texts[r["doc_id"]] for _, k, _ in spans[:1])
    assert all(r["n_chars"] == len(r["text"] or "") for r in after.collect())


def test_mixture_stage(stages):
    before, after = stages["mixture"]
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in before.collect()}
    source = {r["doc_id"]: r["source"] for r in before.collect()}
    totals, taken, copies = defaultdict(int), defaultdict(int), defaultdict(list)
    for k, s in source.items():
        totals[s] += size[k]
    for r in after.collect():
        taken[r["source"]] += size[r["doc_id"]]
        copies[r["doc_id"]].append(r["copy"])
    wanted, largest = brute.targets(totals), max(size.values())
    assert all(abs(taken[s] - wanted[s]) <= largest for s in totals)
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in copies.values())


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and found.count() > 100
    assert found.where(F.col("text").contains("@mail")).isEmpty()
