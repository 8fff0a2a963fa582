"""Evaluation: golden questions matched with hits, metrics as grouped means, and a gate against a baseline."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.plans import numbering
from quarry.schemas import GOLDEN

KS = (1, 3, 5, 8, 10)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from JSON lines, with defaults; empty lines don't count. Raises on repeated ids."""
    rows = spark.read.schema(GOLDEN).json(path).where("id IS NOT NULL OR question IS NOT NULL")
    rows = rows.withColumns({"expected": F.coalesce("expected", F.array().cast(GOLDEN["expected"].dataType)), "kind": F.coalesce("kind", F.lit("factual")), "origin": F.coalesce("origin", F.lit("manual"))})
    repeated = [r["id"] for r in duplicate_ids(rows).orderBy("id").take(20)]
    if repeated:
        raise ValueError(f"repeated ids: {', '.join(map(str, repeated))}")
    return rows


def first_of(spark: SparkSession, golden: DataFrame, path: str, n: int) -> DataFrame:
    """The first ``n`` questions in the file's order. A golden set is a small file, read as one text."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "json")).where(F.trim("json") != "")
    wanted = lines.select(F.get_json_object("json", "$.id").alias("id"), "line").orderBy("line").limit(n)
    return golden.join(wanted.select("id"), "id", "left_semi")


def golden_digest(spark: SparkSession, path: str) -> str:
    """The first 12 digits of the file's SHA-256."""
    data = spark.read.format("binaryFile").load(path).first()["content"]
    return hashlib.sha256(bytes(data)).hexdigest()[:12]


def golden_json(rows: DataFrame) -> DataFrame:
    """What is written: nulls and values that are defaults are left out by a JSON writer that ignores nulls."""
    kept = F.when(F.col("kind") != "factual", F.col("kind")), F.when(F.col("origin") != "manual", F.col("origin"))
    return rows.select("id", "question", F.when(F.col("answer") != "", F.col("answer")).alias("answer"), F.when(F.size("expected") > 0, F.col("expected")).alias("expected"), kept[0].alias("kind"), kept[1].alias("origin"), F.when(F.col("notes") != "", F.col("notes")).alias("notes"))


def save_golden(rows: DataFrame, path: str) -> None:
    golden_json(rows).coalesce(1).sortWithinPartitions("id").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def duplicate_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def expects_refusal() -> Column:
    return (F.col("kind") == "refusal") | (F.size("expected") == 0)


def match(e: Column, chunk_id: Column, uri: Column, chunk_index: Column, text: Column) -> Column:
    """Whether an expected entry is met: its chunk, or its file together with its index or a text that holds its span."""
    same_file = C.file_name(e["uri"]) == C.file_name(uri)
    span = (C.norm(e["span"]) != "") & C.norm(text).contains(C.norm(e["span"]))
    return F.coalesce(e["chunk_id"] == chunk_id, F.lit(False)) | F.coalesce(same_file & (F.coalesce(e["chunk_index"] == chunk_index, F.lit(False)) | F.coalesce(span, F.lit(False))), F.lit(False))


def first_ranks(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per question and expected entry: the smallest rank of a hit that meets it, or null."""
    wanted = golden.select(F.col("id").alias("qid"), F.posexplode("expected").alias("entry", "e"))
    # hits are few a question, and meet its own entries only
    met = wanted.join(hits, "qid").where(match(F.col("e"), F.col("chunk_id"), F.col("uri"), F.col("chunk_index"), F.col("text"))).groupBy("qid", "entry").agg(F.min("rank").alias("rank"))
    return wanted.select("qid", "entry").join(met, ["qid", "entry"], "left")


def retrieval_scores(ranks: DataFrame, ks: Sequence[int] = KS, *, qid: str = "qid") -> DataFrame:
    """One row per question: first_hit_rank, reciprocal_rank, and recall@k and hit@k as ``recall_k`` and ``hit_k``."""
    within = lambda k: F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    first = F.min("rank")
    return ranks.groupBy(qid).agg(
        first.alias("first_hit_rank"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"), *[F.avg(within(k)).alias(f"recall_{k}") for k in ks], *[F.max(within(k)).alias(f"hit_{k}") for k in ks]
    )


def retrieval_summary(scores: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Long rows (metric, value)."""
    names = ["mrr", *(f"{m}@{k}" for k in ks for m in ("recall", "hit"))]
    columns = ["reciprocal_rank", *(f"{m}_{k}" for k in ks for m in ("recall", "hit"))]
    means = scores.agg(*[F.avg(c).alias(n) for c, n in zip(columns, names, strict=True)])
    return flattened(means)


def flattened(one_row: DataFrame) -> DataFrame:
    """A row of metrics as rows (metric, value)."""
    return one_row.unpivot([], [F.col(f"`{c}`") for c in one_row.columns], "metric", "value")


def answer_scores(golden: DataFrame, answers: DataFrame, points: DataFrame) -> DataFrame:
    """One row per question: refused, refusal_correct, citation_precision (null without citations, and for refusals) and citation_hit."""
    judged = answers.select("qid", "refused", "cited").join(golden.select(F.col("id").alias("qid"), "expected", expects_refusal().alias("refusal")), "qid")
    cited = judged.where(~F.col("refusal")).select("qid", "expected", F.explode("cited").alias("c")).select("qid", "expected", "c.chunk_id").join(points.select("chunk_id", "uri", "chunk_index", "text"), "chunk_id")
    met = cited.groupBy("qid").agg(F.avg(F.exists("expected", lambda e: match(e, F.col("chunk_id"), F.col("uri"), F.col("chunk_index"), F.col("text"))).cast("double")).alias("citation_precision"))
    return judged.join(met, "qid", "left").select(
        "qid", "refusal", "refused", (F.col("refused") == F.col("refusal")).alias("refusal_correct"), "citation_precision", (F.coalesce("citation_precision", F.lit(0.0)) > 0).alias("citation_hit")
    )


def answer_summary(scores: DataFrame) -> DataFrame:
    """Long rows (metric, value); means of nothing are null."""
    of = lambda test, value: F.avg(F.when(test, value))
    return flattened(
        scores.agg(
            of(~F.col("refusal"), F.col("refused").cast("double")).alias("false_refusal_rate"),
            of(F.col("refusal"), F.col("refusal_correct").cast("double")).alias("refusal_accuracy"),
            of(~F.col("refusal"), F.col("citation_precision")).alias("citation_precision"),
            of(~F.col("refusal"), F.col("citation_hit").cast("double")).alias("citation_hit_rate"),
        )
    )


def metric_order(name: Column) -> Column:
    """mrr, then recall and hit by k, then other metrics, then the judge's, by name."""
    k = F.regexp_extract(name, r"@(\d+)$", 1)
    group = F.when(name == "mrr", 0).when(name.startswith("recall@"), 1).when(k != "", 2).when(~name.startswith("judge_"), 3).otherwise(4)
    return F.struct(group.alias("g"), F.when(k != "", k.cast("int")).otherwise(0).alias("k"), name.alias("n"))


def compared(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows (metric, baseline, current, delta) over the metrics of both, in display order."""
    both = baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric", "full")
    return both.withColumn("delta", F.col("current") - F.col("baseline")).orderBy(metric_order(F.col("metric")))


def regressed(comparison: DataFrame, k: int, threshold: float) -> bool:
    """Whether recall@k fell by more than the threshold; a metric that one side lacks doesn't count."""
    return not comparison.where((F.col("metric") == f"recall@{k}") & (F.col("baseline") - F.col("current") > threshold)).isEmpty()


def misses(golden: DataFrame, scores: DataFrame) -> DataFrame:
    """Factual questions that no hit met."""
    return golden.where(~expects_refusal()).join(scores.where("first_hit_rank IS NULL").select(F.col("qid").alias("id")), "id", "left_semi")


def sample_order(id_col: str, seed: int) -> Column:
    """A seeded order that doesn't depend on partitions or runs."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def sampled(chunks: DataFrame, n: int, seed: int, *, least_words: int = 12, id_col: str = "chunk_id") -> DataFrame:
    """``n`` chunks of at least ``least_words`` words, the first in a seeded order."""
    return chunks.where(C.token_count("text") >= least_words).orderBy(sample_order(id_col, seed), id_col).limit(n)


def verbatim(candidates: DataFrame) -> DataFrame:
    """Candidates (question, answer, span, text, ...) whose span is in the text, white space and case aside."""
    return candidates.where(C.norm("text").contains(C.norm("span")))


def deduplicated(candidates: DataFrame, *, question: str = "question", order: Sequence[str] = ("arrival",)) -> DataFrame:
    """The first of each normalised question."""
    w = Window.partitionBy("_q").orderBy(*order)
    return candidates.withColumn("_q", C.norm(question)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_q", "_n")


def numbered(candidates: DataFrame, order: str = "arrival") -> DataFrame:
    """Ids ``syn-0001``, ... in order, of any number of candidates."""
    return numbering.numbered(candidates, order, name="_n").withColumn("id", F.format_string("syn-%04d", "_n")).drop("_n")


def smoke(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per smoke question with ``passed``. ``expected`` has qid, expect_file, expect_text and expect_refusal, ``answers`` qid, answer, refused and cited.

    A refusal passes if one is expected; else some citation's file must end in ``expect_file`` and the answer must hold ``expect_text``, where they are given.
    """
    rows = expected.join(answers.select("qid", "answer", "refused", "cited"), "qid", "left")
    file = F.col("expect_file").isNull() | F.exists("cited", lambda c: c["uri"].endswith(F.col("expect_file")))
    text = F.col("expect_text").isNull() | C.norm("answer").contains(C.norm("expect_text"))
    ok = F.when(F.coalesce("expect_refusal", F.lit(False)), F.col("refused")).otherwise(~F.col("refused") & file & text)
    return rows.select("qid", F.coalesce(ok, F.lit(False)).alias("passed"))


def smoke_rate(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"), F.avg(F.col("passed").cast("double")).alias("rate"))


#: question, answer, contexts and a reference answer or None to measures between 0 and 1 by name
Judge = Callable[[str, str, list[str], str | None], dict[str, float]]


def judged(answers: DataFrame, golden: DataFrame, judge: Judge, concurrency: int = 4) -> DataFrame:
    """Long rows (metric, value): the means of what an injected judge says of each answer that isn't a refusal, as ``judge_<name>``. Measures that need a reference
    answer are the judge's to leave out without one."""
    rows = answers.where(~F.col("refused")).join(golden.select(F.col("id").alias("qid"), F.col("answer").alias("reference")), "qid")
    rows = rows.select("question", "answer", F.transform("chunks", lambda c: c["text"]).alias("contexts"), "reference")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [(f"judge_{k}", float(v)) for r in batch.to_pylist() for k, v in judge(r["question"], r["answer"], r["contexts"] or [], r["reference"]).items()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in said], pa.string()), pa.array([v for _, v in said], pa.float64())], names=["metric", "value"])

    return rows.repartition(concurrency).mapInArrow(run, "metric string, value double").groupBy("metric").agg(F.avg("value").alias("value"))
