"""Question candidates for a golden set, and an extractive stand-in for a model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluate
from quarry.operators.chunk import sentences

#: (title, breadcrumb, text, n) to up to n of {"question", "answer", "span"}
Propose = Callable[[str, str, str, int], list[dict]]
_WORD = re.compile(r"\w+")


def candidates(chunks: DataFrame, propose: Propose, *, most_chunks: int = 60, per_chunk: int = 2, seed: int = 0, concurrency: int = 4) -> DataFrame:
    """Golden questions from a seeded sample of chunks: verbatim spans only, each question once, numbered in order."""
    picked = evaluate.sampled(chunks, most_chunks, seed).select("chunk_id", "chunk_index", "uri", "title", "breadcrumb", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("question", pa.string()), ("answer", pa.string()), ("span", pa.string())]))
        for batch in batches:
            rows = batch.to_pylist()
            found = [propose(r["title"] or "", r["breadcrumb"] or "", r["text"], per_chunk)[:per_chunk] for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "proposed"])

    made = picked.repartition(concurrency).mapInArrow(run, picked.schema.simpleString()[7:-1].replace(":", " ") + ", proposed array<struct<question:string,answer:string,span:string>>")
    order = evaluate.sample_order("chunk_id", seed)
    each = made.select("*", F.posexplode("proposed").alias("n", "p")).withColumn("arrival", F.struct(order.alias("o"), F.col("chunk_id"), F.col("n")))
    each = each.select("chunk_id", "chunk_index", "uri", "text", "arrival", F.trim("p.question").alias("question"), F.trim("p.answer").alias("answer"), F.trim("p.span").alias("span"))
    kept = evaluate.numbered(evaluate.deduplicated(evaluate.verbatim(each)))
    expected = F.array(F.struct("uri", "chunk_index", "chunk_id", "span"))
    return kept.select("id", "question", "answer", expected.alias("expected"), F.lit("factual").alias("kind"), F.lit("synthetic").alias("origin"), F.lit(None).cast("string").alias("notes"))


def first_sentences(title: str, breadcrumb: str, text: str, n: int) -> list[dict]:
    """A proposal without a model: what does the text say in its first sentences?"""
    return [{"question": f"What does {breadcrumb or title} say about {' '.join(s.split()[:4])}?", "answer": s, "span": s} for s in sentences(text)[:n]]


def extractive(question: str, context: str) -> dict:
    """An answer without a model: the sentence that shares most words with the question, with its document's number."""
    asked = {w.lower() for w in _WORD.findall(question)}
    best, number, said = 0, 0, ""
    for m in re.finditer(r'<document id="(\d+)"[^\n]*>\n(.*?)\n</document>', context, re.DOTALL):
        for s in sentences(m[2].replace("\n", " ")):
            shared = len(asked & {w.lower() for w in _WORD.findall(s)})
            if shared > best:
                best, number, said = shared, int(m[1]), s
    if not best:
        return {"answer": "The documents don't say.", "citations": [], "insufficient_context": True}
    return {"answer": f"{said} [{number}]", "citations": [number], "insufficient_context": False}
