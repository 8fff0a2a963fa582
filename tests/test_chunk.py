import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import Chunking
from quarry.functions.columns import NAMESPACE
from quarry.operators import chunk
from quarry.operators.htmldoc import block
from quarry.operators.parse import BLOCK_ARRAY
from quarry.operators.tables import to_html, to_markdown

S = Chunking(40, 60, 6, 30)


def para(text, page=None):
    return block("paragraph", text) | {"page": page}


def words(n, start=0):
    return " ".join(f"w{k}." for k in range(start, start + n))


def fold(blocks, title="Doc", s=S):
    return chunk.fold(title, blocks, s, chunk.count_words)


def heading(text, level=1):
    return block("heading", text, level)


def test_sections_follow_headings():
    found = fold([para("p0"), heading("Doc"), para("p1"), heading("A", 2), para("p2"), heading("A.1", 3), para("p3"), heading("Empty", 2), heading("C", 2), para("p4")])
    assert [c["breadcrumb"] for c in found] == ["Doc", "Doc", "Doc > A", "Doc > A > A.1", "Doc > C"]
    assert [c["text"] for c in found] == ["p0", "p1", "p2", "p3", "p4"]
    assert found[2]["embed_text"] == "Doc > A\n\np2" and fold([heading("A"), heading("B")]) == []


def test_packing_with_overlap():
    found = fold([para(words(15, 15 * k)) for k in range(6)])
    assert len(found) >= 3
    for a, b in zip(found, found[1:], strict=False):
        first = b["text"].split("\n\n")[0]
        assert a["text"].endswith(first) and len(first.split()) <= 6


def test_no_overlap():
    found = fold([para(words(15, 15 * k)) for k in range(4)], s=Chunking(40, 60, 0, 30))
    assert [len(c["text"].split()) for c in found] == [30, 30]


def test_long_texts():
    found = fold([para(words(200))], s=Chunking(40, 60, 0, 30))
    assert all(len(c["text"].split()) <= 60 for c in found) and " ".join(c["text"] for c in found).split() == words(200).split()
    giant = fold([para(" ".join(f"x{k}" for k in range(150)))])
    assert " ".join(c["text"] for c in giant).split().count("x149") == 1 and all(len(c["text"].split()) <= 60 for c in giant)


def test_code_and_tables_and_lists():
    code = fold([block("code", "\n".join(f"line {k}" for k in range(100)), language="py")])
    assert len(code) == 1 and code[0]["kind"] == "code" and code[0]["text"].startswith("```py\n")
    rows = [[f"r{k}", "v"] for k in range(20)]
    table = block("table", to_markdown(rows, ["h", "i"]), table_html=to_html(rows, ["h", "i"])) | {"page": 4}
    found = fold([para(words(10)), table, para("after")])
    parts = [c for c in found if c["kind"] == "table"]
    assert all(c["text"].startswith("| h | i |") for c in parts) and [c["table_part"]["part"] for c in parts] == list(range(1, len(parts) + 1))
    assert {c["table_part"]["total"] for c in parts} == {len(parts)} and sum(c["text"].count("| r") for c in parts) == 20 and parts[0]["page_start"] == 4
    assert found[-1]["text"] == "after"
    items = fold([block("list_item", "one", 1), block("list_item", "two", 2)])
    assert items[0]["text"] == "- one\n\n  - two"


def test_pages_and_ids(spark):
    df = spark.createDataFrame([("d", "T", h, [para("a", 2), para("b", 4), heading("A"), para("c"), heading("A"), para("c")]) for h in ("h1", "h2")], f"doc_id string, title string, content_hash string, blocks {BLOCK_ARRAY}")
    found = [r.asDict() for r in chunk.chunk(df, S).orderBy("content_hash", "chunk_index").collect()]
    one, two = found[:3], found[3:]
    assert (one[0]["page_start"], one[0]["page_end"]) == (2, 4)
    assert [c["section_id"] for c in one] == [c["section_id"] for c in two] and len({c["section_id"] for c in one}) == 3
    assert not {c["chunk_id"] for c in one} & {c["chunk_id"] for c in two}
    ns = uuid.UUID(NAMESPACE)
    assert one[1]["chunk_id"] == str(uuid.uuid5(ns, "d:1:h1")) and one[2]["section_id"] == str(uuid.uuid5(ns, "d:section:2:T > A"))


def test_empty_and_null_documents(spark):
    df = spark.createDataFrame([("a", None, "h", None), ("b", "", "h", [])], f"doc_id string, title string, content_hash string, blocks {BLOCK_ARRAY}")
    assert chunk.chunk(df, S).count() == 0


sentence = st.lists(st.text("abc", min_size=1, max_size=3), min_size=1, max_size=30).map(lambda w: " ".join(w) + ".")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(sentence, min_size=1, max_size=12).map(" ".join), min_size=1, max_size=6))
def test_no_word_is_lost_or_moved(texts):
    found = fold([para(t) for t in texts], s=Chunking(40, 60, 0, 30))
    assert " ".join(c["text"] for c in found).split() == " ".join(texts).split()
    assert all(len(c["text"].split()) <= 60 for c in found)


@pytest.mark.parametrize("text", ["", "a b c. " * 30, "word " * 80, "A! B? C. " * 20])
def test_expression_equals_the_fold(spark, text):
    groups = list(chunk._packed(chunk.sentences(text), lambda g: sum(map(chunk.count_words, g)) > 20))
    found = spark.createDataFrame([(text,)], "t string").select(F.explode_outer(chunk.pack_sentences("t", 20)).alias("p")).where("p IS NOT NULL").select("p.piece").collect()
    assert [r["piece"] for r in found] == [" ".join(g).rstrip(" ") if k < len(groups) - 1 else " ".join(g) for k, g in enumerate(groups)]


def test_short_documents_share_batches(spark, monkeypatch):
    block = "struct<type:string,text:string,level:int,page:int,bbox:array<double>,table_html:string,language:string>"
    rows = [(f"d{k}", None if k % 7 == 0 else f"t{k}", "h", None if k % 5 == 0 else [("paragraph", f"a b {k}", None, k, None, None, None)] * (k % 3)) for k in range(1200)]
    docs = spark.createDataFrame(rows, f"doc_id string, title string, content_hash string, blocks array<{block}>")
    real, runs = type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, *a, **b: runs.append(run) or real(df, run, *a, **b))
    found = chunk.chunk(docs)
    batches = list(runs[0](iter(docs.select("doc_id", "title", "content_hash", "blocks").toArrow().to_batches(max_chunksize=700))))
    wanted = [(f"d{k}", "\n\n".join([f"a b {k}"] * (k % 3))) for k in range(1200) if k % 5 and k % 3]
    assert [(x["doc_id"], x["c"]["text"]) for b in batches for x in b.to_pylist()] == wanted and len(batches) == 1
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted(wanted)
