"""Command line: status, config, ingest, query, eval, reindex and generate-golden."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import subprocess
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Settings, load
from quarry.operators import answer, assemble, evaluate, generate, retrieve
from quarry.operators.embed import HashEmbedder
from quarry.plans import ingest
from quarry.plans.store import IndexConfigMismatchError, Store, count_points
from quarry.sources.files import FileSystem


def session() -> SparkSession:
    builder = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


def ask(spark: SparkSession, store: Store, questions: DataFrame, settings: Settings, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, questions with their context) of rows (qid, question)."""
    embedder = HashEmbedder(settings.embedding.model, settings.embedding.dims)
    rows = [r.asDict() for r in questions.collect()]  # a stated set of questions
    vectors = embedder.embed([r["question"] for r in rows])
    asked = spark.createDataFrame([(r["qid"], [float(x) for x in v]) for r, v in zip(rows, vectors, strict=True)], "qid string, vector array<float>")
    points = store.read("index")
    hits = retrieve.retrieved(retrieve.retrieve(points, asked, settings.retrieval, top_k), points).cache()
    contexts = questions.join(assemble.assembled(hits, settings.retrieval.max_context_tokens), "qid", "left")
    return hits, contexts


def _ingest(spark: SparkSession, args: argparse.Namespace, s: Settings) -> int:
    embedder = HashEmbedder(s.embedding.model, s.embedding.dims)
    report = ingest.ingest(spark, Store(spark, s.store), args.path, embedder, s, force=args.force, prune=not args.no_prune, dry_run=args.dry_run)
    print(json.dumps(report, default=str, indent=1))
    return 1 if report["failed"] else 0


def _reindex(spark: SparkSession, args: argparse.Namespace, s: Settings) -> int:
    if args.recreate and not args.yes and input("Drop the index and make it again? [y/N] ").strip().lower() != "y":
        return 0
    report = ingest.reindex(Store(spark, s.store), HashEmbedder(s.embedding.model, s.embedding.dims), s, recreate=args.recreate)
    print(json.dumps(report, default=str, indent=1))
    return 0


def _query(spark: SparkSession, args: argparse.Namespace, s: Settings) -> int:
    store = Store(spark, s.store)
    _, contexts = ask(spark, store, spark.createDataFrame([("q", args.question)], "qid string, question string"), s, args.top_k)
    answers = answer.validated(answer.drafted(contexts, generate.extractive)).cache()
    answer.save_traces(answer.traces(answers, model="extractive"), f"{s.store}/traces")
    found = answers.first().asDict(recursive=True)
    if args.json:
        print(json.dumps({k: found[k] for k in ("answer", "refused", "cited")}, default=str, indent=1))
        return 0
    print(found["answer"])
    for c in found["cited"]:
        print(f"  [{c['number']}] {c['title']} ({c['uri']}) {c['snippet']}")
    if args.show_context:
        print(found["context"])
    return 0


def _eval(spark: SparkSession, args: argparse.Namespace, s: Settings) -> int:
    if not FileSystem(spark).exists(args.golden):
        print(f"{args.golden} is missing", file=sys.stderr)
        return 2
    store = Store(spark, s.store)
    golden = evaluate.read_golden(spark, args.golden)
    golden = evaluate.first_of(spark, golden, args.golden, args.limit) if args.limit else golden
    depth = max(s.evaluation.k, 10, s.retrieval.top_k)
    questions = golden.select(F.col("id").alias("qid"), "question")
    hits, contexts = ask(spark, store, questions, s, depth)
    factual = golden.where(~evaluate.expects_refusal())
    scores = evaluate.retrieval_scores(evaluate.first_ranks(factual, hits)).cache()
    metrics = evaluate.retrieval_summary(scores)
    if args.answers:
        answers = answer.validated(answer.drafted(contexts, generate.extractive))
        metrics = metrics.union(evaluate.answer_summary(evaluate.answer_scores(golden, answers, store.read("index"))))
    values = {r["metric"]: r["value"] for r in metrics.collect()}
    commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True).stdout.strip()
    run = {"created_at": datetime.now(UTC).isoformat(), "git_commit": commit or None, "golden": {"path": args.golden, "digest": evaluate.golden_digest(spark, args.golden), "n": golden.count()}, "config": {"k": s.evaluation.k} | dataclasses.asdict(s.retrieval), "metrics": values}
    print(json.dumps(run, indent=1))
    for r in evaluate.misses(golden, scores).select("id", "question").collect():
        print(f"missed: {r['id']} {r['question']}")
    if args.out:
        scores.coalesce(1).write.mode("overwrite").json(args.out)
    if args.save_baseline:
        Path(args.save_baseline).write_text(json.dumps(run, indent=1), encoding="utf-8")
    if args.compare:
        base = json.loads(Path(args.compare).read_text(encoding="utf-8"))
        for what, old, new in (("golden set", base.get("golden", {}).get("digest"), run["golden"]["digest"]), ("k", base.get("config", {}).get("k"), s.evaluation.k)):
            if old != new:
                print(f"warning: the baseline's {what} is {old}, this run's {new}", file=sys.stderr)
        rows = evaluate.compared(metrics, spark.createDataFrame(list(base["metrics"].items()), "metric string, value double"))
        for r in rows.collect():
            print(r["metric"], r["baseline"], r["current"], r["delta"])
        return 1 if evaluate.regressed(rows, s.evaluation.k, s.evaluation.threshold) else 0
    return 0


def _generate(spark: SparkSession, args: argparse.Namespace, s: Settings) -> int:
    rows = generate.candidates(Store(spark, s.store).read("index").drop("vector"), generate.first_sentences, most_chunks=args.max_chunks, per_chunk=args.per_chunk, seed=args.seed)
    evaluate.save_golden(rows, args.out)
    return 0


def _status(spark: SparkSession, args: argparse.Namespace, s: Settings) -> int:
    store = Store(spark, s.store)
    manifest = store.manifest()
    print(json.dumps({"spark": spark.version, "store": s.store, "config": manifest["config"], "tables": manifest["tables"]}, indent=1))
    if manifest["config"] is None:
        return 1
    print("points:", count_points(store.read("index")))
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="quarry", description=__doc__)
    top.add_argument("--settings", default="quarry.yaml")
    top.add_argument("--store")
    top.add_argument("-v", "--verbose", action="store_true")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("status")
    verbs.add_parser("config")
    p = verbs.add_parser("ingest")
    p.add_argument("--path", required=True)
    for flag in ("--force", "--no-prune", "--dry-run"):
        p.add_argument(flag, action="store_true")
    p = verbs.add_parser("query")
    p.add_argument("question")
    p.add_argument("--top-k", type=int, default=0)
    p.add_argument("--show-context", action="store_true")
    p.add_argument("--json", action="store_true")
    p = verbs.add_parser("eval")
    p.add_argument("--golden", default="golden.jsonl")
    p.add_argument("--answers", action="store_true")
    for flag in ("--compare", "--save-baseline", "--out"):
        p.add_argument(flag)
    p.add_argument("--limit", type=int, default=0)
    p = verbs.add_parser("reindex")
    p.add_argument("--recreate", action="store_true")
    p.add_argument("--yes", action="store_true")
    p = verbs.add_parser("generate-golden")
    p.add_argument("--max-chunks", type=int, default=60)
    p.add_argument("--per-chunk", type=int, default=2)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--out", required=True)
    args = top.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    settings = load(args.settings, ".env")
    settings = dataclasses.replace(settings, store=args.store) if args.store else settings
    if args.verb == "config":
        print(json.dumps(dataclasses.asdict(settings), indent=1))
        return 0
    run = {"status": _status, "ingest": _ingest, "query": _query, "eval": _eval, "reindex": _reindex, "generate-golden": _generate}[args.verb]
    try:
        return run(session(), args, settings)
    except IndexConfigMismatchError as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
