"""Answers: citation markers checked against the context, refusals, traces. The model is injected."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import columns as C

#: Fixed value: what is said when nothing was found.
REFUSAL = "I couldn't find an answer to that in the indexed documents."
SYSTEM = "Answer the question from the numbered documents only. Mark each statement with the number of its document, like [1]. Say so if they don't hold the answer."
USER = "Documents:\n\n{context}\n\nQuestion: {question}"

#: question and context to {"answer", "citations", "insufficient_context", "input_tokens", "output_tokens"}
Generate = Callable[[str, str], dict]


def prompt(question: Column | str, context: Column | str) -> Column:
    """The user's message for a model."""
    before, between, after = USER.partition("{context}")[0], USER.partition("{context}")[2].partition("{question}")[0], USER.partition("{question}")[2]
    one = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(before), one(context), F.lit(between), one(question), F.lit(after))


def valid_numbers(answer: Column | str, listed: Column, size: Column) -> Column:
    """Numbers of documents from the markers, then from the model's list; each once, and only those that exist."""
    return F.array_distinct(F.filter(F.concat(C.citation_numbers(answer), F.coalesce(listed, F.array().cast("array<int>"))), lambda n: (n >= 1) & (n <= size)))


def cleaned(answer: Column | str, numbers: Column) -> Column:
    """The answer without markers of other numbers; then double blanks, and blanks before punctuation, go.

    The text is split behind each marker, so that every piece ends in at most one marker, which stays or goes.
    """
    a = F.col(answer) if isinstance(answer, str) else answer

    def piece(p: Column) -> Column:
        mark = F.regexp_extract(p, r"\[(\d{1,3})\]$", 1)
        return F.when((mark == "") | F.array_contains(numbers, F.when(mark != "", mark.cast("int"))), p).otherwise(F.regexp_replace(p, r"\[\d{1,3}\]$", ""))

    text = F.array_join(F.transform(F.split(a, r"(?<=\[\d{1,3}\])"), piece), "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"[ \t]+([.,;:])", "$1"))


def validated(drafts: DataFrame) -> DataFrame:
    """Drafts (qid, answer, citations, insufficient_context, chunks) to answers with ``numbers``, ``cited`` and ``refused``.

    A draft that lacks context is a refusal in its own words; one without a valid citation, or without any chunk, is the fixed refusal.
    """
    rows = drafts.withColumn("chunks", F.coalesce("chunks", F.array().cast(drafts.schema["chunks"].dataType)))
    rows = rows.withColumn("numbers", valid_numbers("answer", F.col("citations"), F.size("chunks")))
    rows = rows.withColumn("text", cleaned("answer", F.col("numbers")))
    lacks = F.coalesce("insufficient_context", F.lit(False))
    none = F.size("numbers") == 0
    cited = F.transform("numbers", lambda n: _citation(n, F.get("chunks", n - 1)))
    refused = lacks | none
    return rows.select(
        *[c for c in drafts.columns if c not in ("answer", "citations")],
        F.when(lacks, F.col("text")).when(none, F.lit(REFUSAL)).otherwise(F.col("text")).alias("answer"),
        "numbers",
        F.when(refused, F.slice(cited, 1, 0)).otherwise(cited).alias("cited"),
        refused.alias("refused"),
    )


def _citation(number: Column, chunk: Column) -> Column:
    return F.struct(number.alias("number"), chunk["chunk_id"].alias("chunk_id"), chunk["doc_id"].alias("doc_id"), chunk["title"].alias("title"), chunk["uri"].alias("uri"), chunk["page_start"].alias("page"), C.snippet(chunk["text"]).alias("snippet"), F.round(chunk["score"], 4).alias("score"))


def drafted(questions: DataFrame, generate: Generate, concurrency: int = 4) -> DataFrame:
    """Questions (qid, question, context, chunks) with the model's draft, in as many partitions as a shuffle has, each with up to ``concurrency`` calls under way. Without a context the
    model isn't called."""
    asked = questions.where(F.coalesce("context", F.lit("")) != "").select("qid", "question", "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with ThreadPoolExecutor(concurrency) as pool:
                found = list(pool.map(lambda q, c: generate(q or "", c), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            cols = [
                pa.array([f.get("answer", "") for f in found], pa.string()),
                pa.array([list(f.get("citations", ())) for f in found], pa.list_(pa.int32())),
                pa.array([bool(f.get("insufficient_context", False)) for f in found], pa.bool_()),
                pa.array([f.get("input_tokens", 0) for f in found], pa.int32()),
                pa.array([f.get("output_tokens", 0) for f in found], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["qid", "answer", "citations", "insufficient_context", "input_tokens", "output_tokens"])

    kind = questions.schema["qid"].dataType.simpleString()
    made = asked.repartition("qid").mapInArrow(run, f"qid {kind}, answer string, citations array<int>, insufficient_context boolean, input_tokens int, output_tokens int")
    return questions.join(made, "qid", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def traces(answers: DataFrame, *, model: str) -> DataFrame:
    """Rows of the trace table from answers that still have question and chunks."""
    number = lambda c: F.col(c) if c in answers.columns else F.lit(None).cast("int")
    return answers.select(
        C.uuid5(F.concat_ws(":", F.lit("trace"), F.col("qid").cast("string"), F.current_timestamp().cast("string"))).alias("trace_id"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("string").alias("conversation_id"),
        F.col("question").alias("query"),
        F.lit(None).cast("string").alias("rewritten_query"),
        F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["doc_id"].alias("doc_id"), F.round(c["score"], 4).alias("score"))).alias("retrieved"),
        F.transform("cited", lambda c: c["chunk_id"]).alias("cited_chunk_ids"),
        "answer",
        "refused",
        F.lit(None).cast("string").alias("tool_calls"),
        F.lit(model).alias("model"),
        number("input_tokens").alias("input_tokens"),
        number("output_tokens").alias("output_tokens"),
        *[number(c).alias(c) for c in ("retrieval_ms", "llm_ms", "latency_ms")],
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("metadata"),
    )


def save_traces(rows: DataFrame, path: str) -> bool:
    """Append; a failure is logged and doesn't reach the caller."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:
        logging.getLogger(__name__).exception("traces weren't saved")
        return False
    return True
