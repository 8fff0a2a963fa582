"""The engine's registered queries over the star schema, documents, pages, embeddings, benchmark, conversations and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import Chunking, Embedding, Retrieval
from quarry.functions import columns as C
from quarry.operators import answer, assemble, cells, chunk, embed, evaluate, parse, retrieve, sections, spans, tables
from quarry.plans import ingest, store
from quarry.sources.files import scratch
from quarry.streaming import arrivals

TARGET = 60  # words of a piece


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# -- retrieval: labels of vectors stand for documents


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query."""
    return _vectors(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


_AS = {"id_col": "vec_id", "vector_col": "embedding"}


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.dense_topk(_vectors(spark, d), _asked(spark, d), 10, **_AS)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


def indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The search by cells, with as many probes as a recall of 0.95 on the index's sample takes."""
    index = cells.CellIndex.build(_vectors(spark, d), scratch(spark, "cells"), **_AS)
    found = index.search(_asked(spark, d), 10)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.dense_topk(_vectors(spark, d), _asked(spark, d), 10, where=F.col("label") == 1, **_AS)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


def dense_retrieve(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.retrieve(_vectors(spark, d), _asked(spark, d), Retrieval(), doc="label", **_AS)
    return found.select("qid", "vec_id", _long("label").alias("label"), F.round("score", 6).alias("score"), _long("rank").alias("rank"))


def cap_per_doc(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.dense_topk(_vectors(spark, d), _asked(spark, d), 40, keep=("label",), **_AS)
    return retrieve.cap_per_doc(found, 3, doc="label").select("qid", "vec_id", _long("label").alias("label"), _long("rank").alias("rank"))


def cosine_expression(spark: SparkSession, d: str) -> DataFrame:
    """A stated set against all rows: every pair is a row."""
    return retrieve.all_scores(_vectors(spark, d), _asked(spark, d), places=6, **_AS)


def reciprocal_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    first = retrieve.dense_topk(_vectors(spark, d), _asked(spark, d), 20, **_AS)
    second = retrieve.dense_topk(_vectors(spark, d), _asked(spark, d), 20, where=F.col("label") == 1, **_AS)
    found = retrieve.fuse(first, second, 10, id_col="vec_id")
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


_SCORES = """
  SELECT q.vec_id AS qid, p.vec_id, p.label, list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0 {where}"""
_RANKS = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ({scores})"


def _ranked_sql(where: str = "") -> str:
    return _RANKS.format(scores=_SCORES.format(where=where))


# -- identity and text


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def doc_id(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", C.doc_id("source", F.col("doc_id").cast("string")).alias("uuid"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", C.content_hash("text").alias("content_hash"))


def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", C.cache_key("text", F.lit("m"), F.lit(64)).alias("cache_key"))


def token_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _long(C.token_count("text")).alias("tokens"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", C.normalize_text("text").alias("text"))


def norm_span(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", C.norm("text").alias("span"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(C.sentences("text")).alias("i", "sentence")).select("doc_id", _long("i").alias("i"), "sentence")


def snippet(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", C.snippet("text").alias("snippet"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    uri = F.regexp_extract("url", r"^[^?#]*", 0)
    return table(spark, d, "pages").select("page_id", C.file_name(uri).alias("file"), C.suffix(F.concat(uri, F.lit(".HTML"))).alias("suffix"))


def supported_files(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".md", ".HTML", ".txt", ".pdf", "")]), (F.col("doc_id") % 5).cast("int") + 1))
    return _docs(spark, d).select(names.alias("uri")).groupBy(C.suffix("uri").alias("suffix"), parse.supported("uri").alias("supported")).agg(F.count("*").alias("n"))


_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
_TOKENS = r"CASE WHEN trim({x}, ' ' || chr(10) || chr(9)) = '' THEN 0 ELSE len(regexp_split_to_array(trim({x}, ' ' || chr(10) || chr(9)), '\s+')) END"
_NORM = r"lower(trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')))"


def _uuid_sql(x: str) -> str:
    return (
        f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) "
        f"FROM (SELECT sha1(unhex('{C.NAMESPACE.replace('-', '')}') || encode({x})) AS h))"
    )


# -- chunks


def sentence_pack(spark: SparkSession, d: str) -> DataFrame:
    pieces = _docs(spark, d).select("doc_id", F.posexplode(chunk.pack_sentences("text", TARGET)).alias("i", "p"))
    return pieces.select("doc_id", _long("i").alias("i"), "p.piece", _long("p.tokens").alias("tokens"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    pieces = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc"), C.content_hash("text").alias("hash"), F.posexplode(chunk.pack_sentences("text", TARGET)).alias("i", "p"))
    return pieces.select("doc", _long("i").alias("i"), C.chunk_id("doc", "i", "hash").alias("chunk_id"))


def _as_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each text as a document of one paragraph a line."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    blocks = F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("type"), x.alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("level", "int"), ("page", "int"), ("bbox", "array<double>"), ("table_html", "string"), ("language", "string"))]))
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), C.content_hash("text").alias("content_hash"), blocks.alias("blocks"), "source", "lang")


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    found = chunk.chunk(_as_documents(spark, d), CUTS)
    return found.select("doc_id", _long("chunk_index").alias("chunk_index"), "chunk_id", "section_id", "breadcrumb", "text", _long("token_count").alias("token_count"), "kind")


#: Of the chunk queries: target, maximum, overlap and table maximum.
CUTS = Chunking(TARGET, 90, 8, 40)


def _as_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Each text as a document of blocks: lines of up to eight words are headings, of a level by their length, the first line is the title, and other lines are by their number a table
    with a row for each sentence, code, a list item, or a paragraph. Each line is a page."""

    def block(b: Column) -> Column:
        x, line, head, kind = (b[n] for n in ("x", "line", "head", "kind"))
        rows = F.when(kind == "table", tables.html_table(F.transform(C.sentences(x), lambda s: F.array(s)), F.array().cast("array<string>")))
        level = F.when(head, F.char_length(x) % 6 + 1).when(kind == "list_item", line % 3 + 1)
        return F.struct(kind.alias("type"), x.alias("text"), level.cast("int").alias("level"), line.cast("int").alias("page"), F.lit(None).cast("array<double>").alias("bbox"), rows.alias("table_html"), F.lit(None).cast("string").alias("language"))

    def counted(b: Column) -> Column:
        line = b["line"]
        kind = F.when(b["head"], "heading").when(line % 6 == 0, "table").when(line % 6 == 1, "code").when(line % 6 == 2, "list_item").otherwise("paragraph")
        return C.bound(F.struct(b["x"].alias("x"), line.alias("line"), b["head"].alias("head"), kind.alias("kind")), block)

    def typed(x: Column, i: Column) -> Column:
        return C.bound(F.struct(x.alias("x"), (i + 1).alias("line"), (C.token_count(x) <= 8).alias("head")), counted)

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.get(lines, F.lit(0)).alias("title"), C.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), F.transform(lines, typed).alias("blocks"))


def chunk_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = chunk.chunk(_as_outlines(spark, d), CUTS)
    numbers = [_long(c).alias(c) for c in ("chunk_index", "token_count", "page_start", "page_end")]
    return found.select("doc_id", "chunk_id", "section_id", "breadcrumb", "text", "kind", *numbers, _long("table_part.part").alias("part"), _long("table_part.total").alias("parts"))


def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as outlines: lines of up to eight words are headings, of a level by their length, and the first line is the title."""
    line = lambda x: F.struct(F.when(C.token_count(x) <= 8, "heading").otherwise("paragraph").alias("type"), (F.char_length(x) % 6 + 1).alias("level"), x.alias("text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.get(lines, F.lit(0)).alias("title"), F.transform(lines, line).alias("blocks"))
    found = sections.section_rows(docs)
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return found.select("doc_id", _long("section").alias("section"), "section_id", "breadcrumb", _long("occurrence").alias("occurrence"), text.alias("text"))


def min_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(C.token_count("text") >= 12).select("doc_id")


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sampled(_docs(spark, d), 60, 7, id_col="doc_id").select("doc_id")


# -- embedding cache


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return embed.with_keys(_docs(spark, d), "text", "m", 64)


def _known_cache(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).where("doc_id % 3 = 0").select("key").distinct()


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return embed.misses(_keyed(spark, d), _known_cache(spark, d)).select("key")


def embed_stats(spark: SparkSession, d: str) -> DataFrame:
    keyed = _keyed(spark, d)
    found = embed.embed_stats(keyed, embed.misses(keyed, _known_cache(spark, d)), Embedding())
    return found.select("texts", "hits", "embedded", _long("api_calls").alias("api_calls"), "tokens", "usd")


def _listed(vector: Column | str, scale: int) -> Column:
    """A vector's numbers in units of 1 / scale, whole, comma-joined."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * scale).cast("long").cast("string")), ",")


def embed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text's vector, made by the model function and joined back to all documents, as whole numbers of 1/1000."""
    keyed = _keyed(spark, d)
    none = spark.createDataFrame([], "key string")
    vectors = embed.embedded(embed.misses(keyed, none), embed.HashEmbedder())
    return embed.joined(keyed, vectors).select("doc_id", _listed("vector", 1000).alias("vector"))


def hash_vector(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _listed(embed.hash_vector("text"), 100_000_000).alias("vector"))


# -- incremental state: an old state is made from the table


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri"), C.content_hash("text").alias("content_hash"), "doc_id", "text", "source")


def _old_state(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    old = rows.where("doc_id % 7 != 0").select("uri", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.col("doc_id").cast("string").alias("doc_id"))
    foreign = rows.where("doc_id % 11 = 0").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("uri"), "content_hash", F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("doc_id"))
    return old.union(foreign)


def _planned(spark: SparkSession, d: str) -> DataFrame:
    return ingest.plan(_items(spark, d), _old_state(spark, d), F.col("known.content_hash") == F.col("item_hash"))


def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).select("uri", "action")


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(ingest.counts(_planned(spark, d)).items()), "action string, n long").where("n > 0")  # four rows


def prune(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).where("action = 'prune'").select("uri", F.col("known_doc_id").alias("doc_id"))


def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    old = _old_state(spark, d).select("doc_id", "content_hash")
    todo = _planned(spark, d).where("action IN ('new', 'changed')").select("uri")
    new = _items(spark, d).join(todo, "uri").select(F.col("doc_id").cast("string").alias("doc_id"), "content_hash")
    gone = _planned(spark, d).where("action = 'prune'").select(F.col("known_doc_id").alias("doc_id"))
    return store.upserted(old, new, new.select("doc_id").union(gone))


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select("source", "uri", "content_hash")
    return store.list_documents(rows, source="src0", prefix="doc/1").select("source", "uri", "content_hash")


def find_document(spark: SparkSession, d: str) -> DataFrame:
    return store.find_document(_items(spark, d), "src0", "doc/40").select("source", "uri", "content_hash")


def cached_vectors(spark: SparkSession, d: str) -> DataFrame:
    cache = _known_cache(spark, d).withColumn("vector", F.lit(1))
    return store.cached(cache, _keyed(spark, d).select("doc_id", "key")).select("doc_id", F.col("vector").isNotNull().alias("hit"))


_OLD = """old AS (
  SELECT 'doc/' || doc_id AS uri, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS content_hash, CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'gone/' || doc_id, sha256(text), 'g' || doc_id FROM documents WHERE doc_id % 11 = 0
), items AS (SELECT 'doc/' || doc_id AS uri, sha256(text) AS content_hash, CAST(doc_id AS VARCHAR) AS doc_id FROM documents
), planned AS (
  SELECT coalesce(i.uri, o.uri) AS uri, CASE WHEN i.uri IS NULL THEN 'prune' WHEN o.uri IS NULL THEN 'new' WHEN i.content_hash = o.content_hash THEN 'unchanged' ELSE 'changed' END AS action, o.doc_id AS known_doc_id
  FROM items i FULL JOIN old o ON i.uri = o.uri
)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one chunk, with its document's payload."""
    rows = _docs(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    chunks = rows.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "doc_id", (F.col("doc_id").cast("int") % 4).alias("chunk_index"), "text", F.col("text").alias("embed_text"), F.when(F.col("lang") != "en", F.col("lang")).alias("kind"))
    about = rows.select("doc_id", F.col("lang").alias("title"), F.concat(F.lit("0/"), "source").alias("uri"), "source", F.lit("txt").alias("doc_type"), F.lit(None).cast("timestamp").alias("last_modified"), F.lit(1).alias("pipeline_version"), F.array().cast("array<string>").alias("acl"))
    return store.payload(chunks, about)


def payload_project(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("chunk_id", "doc_id", _long("chunk_index").alias("chunk_index"), "text", "kind", "title", "uri", "source", "doc_type", _long("pipeline_version").alias("pipeline_version"))


def exact_count(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d)
    return spark.createDataFrame([("all", store.count_points(rows)), ("src0", store.count_points(rows, F.col("source") == "src0")), ("none", store.count_points(rows, F.col("lang").isNull()))], "what string, n long")


def with_new_cache_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key the cache has stay as they are; of texts that repeat, the one with the smallest id is new."""
    keyed = _keyed(spark, d).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    cache = keyed.where("doc_id % 3 = 0").select("key", F.lit("old").alias("model"))
    return store.with_new_cache_rows(cache, keyed.select("key", F.lit("new").alias("model"))).select("key", "model")


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their payload: ids divisible by seven as hits of their source's question, and some that no point has."""
    hits = _docs(spark, d).where("doc_id % 7 = 0").select(F.col("source").alias("qid"), F.concat(F.when(F.col("doc_id") % 5 == 0, "x").otherwise("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit(0.5).alias("score"), F.col("doc_id").alias("rank"))
    found = retrieve.retrieved(hits, _points(spark, d).withColumn("vector", F.lit(0)))
    return found.select("qid", "chunk_id", "rank", "text", "kind", "uri")


def scroll_doc(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumnsRenamed({"conv_id": "doc_id", "turn": "chunk_index"}).withColumn("vector", F.lit(None).cast("array<float>"))
    return store.scroll_doc(turns, 1).select("doc_id", "chunk_index", "role", "text")


# -- context and citations: labelled documents are a question's hits, in the order of ids


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """All labelled documents as hits: forty ids are a question's, in the order of ids."""
    docs = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("qid", F.floor(F.col("doc_id") / 40))
    order = Window.partitionBy("qid").orderBy("doc_id")
    return docs.withColumn("rank", F.row_number().over(order)).select("qid", "doc_id", "rank", "n_chars", "text", "source", "lang")


def assemble_budget(spark: SparkSession, d: str) -> DataFrame:
    found = assemble.within_budget(_hits(spark, d), 12_000, cost="n_chars")
    return found.select("qid", "doc_id", _long("rank").alias("rank"), _long("so_far").alias("so_far"))


def render_document(spark: SparkSession, d: str) -> DataFrame:
    rows = _hits(spark, d).withColumns({"title": F.concat(F.lit('A "b" & <'), "source", F.lit("'s>")), "uri": F.col("source"), "page_start": F.when(F.col("doc_id") % 3 > 0, F.lit(3)), "page_end": F.when(F.col("doc_id") % 3 == 2, F.lit(5)), "breadcrumb": F.when(F.col("doc_id") % 2 == 0, F.lit("x > y"))})
    return assemble.rendered(rows).select("qid", "doc_id", "block")


def citations_extract(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    draft = F.concat("text", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("] and [7] , so [2][1]."))
    numbers = answer.valid_numbers("draft", F.array(F.lit(1), F.lit(9)), F.lit(3))
    rows = turns.withColumn("draft", draft).withColumn("numbers", numbers).withColumn("answer", answer.cleaned("draft", F.col("numbers")))
    return rows.select("conv_id", "turn", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"), "answer")


# -- evaluation


def golden_match(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items whose text occurs in a document, white space and case aside."""
    return spans.span_matches(_docs(spark, d), table(spark, d, "benchmark"), span="text")


def golden_terms(spark: SparkSession, d: str) -> DataFrame:
    """Short spans, the names of brands, nations and part types and the first words of benchmark items, in documents and pages' texts."""
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), F.array_join(F.slice(F.split(C.norm("text"), " "), F.lit(1), F.pmod("item_id", F.lit(6)).cast("int") + 1), " ").alias("span"))
    nations = table(spark, d, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("item_id"), F.substring("n_name", 1, 2).alias("span"))
    return spans.span_matches(_docs(spark, d), items.unionByName(nations))


def dedupe_numbered(spark: SparkSession, d: str) -> DataFrame:
    """The first of each question in conversations, numbered in their order."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    kept = evaluate.deduplicated(rows, order=("conv_id", "turn")).withColumn("arrival", F.struct("conv_id", "turn"))
    return evaluate.numbered(kept).select("id", "conv_id", "turn")


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """The expected entry of a query is any other vector of its label."""
    hits = retrieve.dense_topk(_vectors(spark, d), _asked(spark, d), 11, keep=("label",), **_AS)
    wanted = _vectors(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted"))
    others = retrieve.cut_to(hits.where("qid != vec_id"), 10)
    met = others.join(wanted, "qid").where("label = wanted").groupBy("qid").agg(F.min("rank").alias("rank"))
    return wanted.select("qid").join(met, "qid", "left")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.retrieval_summary(evaluate.retrieval_scores(_ranks(spark, d)))
    return found.select("metric", F.round("value", 6).alias("value"))


def first_hit_rank(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.retrieval_scores(_ranks(spark, d))
    return found.select("qid", F.coalesce(_long("first_hit_rank"), F.lit(0).cast("long")).alias("first_hit_rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "hit_5")


def _golden(spark: SparkSession, d: str) -> DataFrame:
    """Questions of forty ids: by chunk, by file and place, by file and words, and by a file that isn't there. Every fifth expects a refusal."""
    ids = _docs(spark, d).select(F.floor(F.col("doc_id") / 40).alias("id")).distinct()
    none = lambda **known: F.struct(*[known.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("uri", "string"), ("chunk_index", "int"), ("chunk_id", "string"), ("span", "string"))])
    entries = F.array(none(chunk_id=F.concat(F.lit("c"), (F.col("id") * 40 + 7).cast("string"))), none(uri=F.lit("any/src3"), chunk_index=F.lit(2)), none(uri=F.lit("src5"), span=F.lit(" THE  of ")), none(uri=F.lit("src99"), chunk_index=F.lit(0)))
    return ids.select("id", entries.alias("expected"), F.when(F.col("id") % 5 == 0, "refusal").otherwise("factual").alias("kind"))


def _golden_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _points(spark, d).withColumn("n", F.col("doc_id").cast("long"))
    return rows.select(F.floor(F.col("n") / 40).alias("qid"), (F.col("n") % 40 + 1).alias("rank"), "chunk_id", "uri", "chunk_index", "text")


def first_ranks(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.first_ranks(_golden(spark, d), _golden_hits(spark, d)).select("qid", _long("entry").alias("entry"), _long("rank").alias("rank"))


def _answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each question's answer cites the chunks of ids divisible by three; every fourth is refused."""
    cites = _golden_hits(spark, d).where("rank % 3 = 0").groupBy("qid").agg(F.collect_list(F.struct("chunk_id")).alias("cited"))
    answers = _golden(spark, d).select(F.col("id").alias("qid"), (F.col("id") % 4 == 0).alias("refused")).join(cites, "qid", "left").withColumn("cited", F.when(~F.col("refused"), F.col("cited")))
    return evaluate.answer_scores(_golden(spark, d), answers, _points(spark, d))


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    return _answer_scores(spark, d).select("qid", "refusal", "refused", "refusal_correct", F.round("citation_precision", 6).alias("citation_precision"), "citation_hit")


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.answer_summary(_answer_scores(spark, d)).select("metric", F.round("value", 6).alias("value"))


def trace_rows(spark: SparkSession, d: str) -> DataFrame:
    """Questions' answers as traces: two chunks each, the second one cited."""
    pair = F.array(*[F.struct(F.concat(F.lit("c"), (F.col("id") * 40 + k).cast("string")).alias("chunk_id"), F.col("id").cast("string").alias("doc_id"), (F.col("id") / 3).alias("score")) for k in (0, 1)])
    rows = _golden(spark, d).select(F.col("id").alias("qid"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("question"), pair.alias("chunks"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("answer"), (F.col("id") % 4 == 0).alias("refused"), (F.col("id") % 9).cast("int").alias("latency_ms"))
    found = answer.traces(rows.withColumn("cited", F.slice("chunks", 2, 1)), model="m")
    return found.select("query", "answer", "refused", "model", _long("latency_ms").alias("latency_ms"), F.array_join("cited_chunk_ids", ",").alias("cited"), F.get("retrieved", F.lit(1))["score"].alias("score"))


def baseline_compare(spark: SparkSession, d: str) -> DataFrame:
    current = recall_at_k(spark, d)
    base = current.where("metric != 'hit@10'").select("metric", (F.col("value") + 0.125).alias("value")).union(spark.sql("SELECT 'judge_x', 0.5D"))
    found = evaluate.compared(current, base)
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("baseline", "current", "delta")])


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.duplicate_ids(table(spark, d, "conversations"), "conv_id").select("conv_id", "n")


def dedupe_questions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.deduplicated(table(spark, d, "conversations"), question="text", order=("conv_id", "turn")).select("conv_id", "turn")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return arrivals.event_counts(table(spark, d, "events"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return arrivals.streamed_counts(spark, f"{d}/events.parquet", scratch(spark, "stream"))


def smoke_rate(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as smoke questions: each cites itself, expects a file of its own source, and toxic ones are refused."""
    docs = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    expected = docs.select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("0/"), "source")).alias("expect_file"), F.when(F.col("doc_id") % 2 > 0, F.substring("text", 3, 9)).alias("expect_text"), (F.col("doc_id") % 10 == 0).alias("expect_refusal"))
    given = docs.select(F.col("doc_id").alias("qid"), F.col("text").alias("answer"), (F.col("toxic") == 1).alias("refused"), F.array(F.struct(F.concat((F.col("doc_id") % 20).cast("string"), F.lit("/"), "source").alias("uri"))).alias("cited"))
    found = evaluate.smoke_rate(evaluate.smoke(expected, given))
    return found.select("n", "failed", F.round("rate", 6).alias("rate"))


# -- parsing


def _parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.files import table_as_files

    return parse.parsed(table_as_files(table(spark, d, "pages"), source="pages", uri="page_id", content="html", extension="html"))


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return _parsed_pages(spark, d).select("uri", "title")


def html_h1(spark: SparkSession, d: str) -> DataFrame:
    heads = F.filter("blocks", lambda b: (b["type"] == "heading") & (b["level"] == 1))
    return _parsed_pages(spark, d).select("uri", F.get(heads, F.lit(0))["text"].alias("h1"))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return parse.exploded(_parsed_pages(spark, d)).select("doc_id", _long("block_index").alias("block_index"), "type", "text", F.coalesce(_long("level"), F.lit(0).cast("long")).alias("level"))


def plain_text(spark: SparkSession, d: str) -> DataFrame:
    return _parsed_pages(spark, d).select("uri", parse.plain_text("blocks").alias("text"), parse.page_count("blocks").isNull().alias("no_pages"))


def _parts(spark: SparkSession, d: str, text: Column, extension: str) -> DataFrame:
    """Each part as a file. The table's rows are few bytes each, so its files give few tasks; parsing is dealt over as many as a shuffle has."""
    from quarry.sources.files import table_as_files

    parts = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parse.parsed(table_as_files(parts.withColumn("text", text), source="parts", uri="p_partkey", content="text", extension=extension))


def _blocks(docs: DataFrame) -> DataFrame:
    rows = docs.select("uri", F.posexplode_outer("blocks").alias("i", "b")).where("i IS NOT NULL")  # without outer, a filter on the array's size would have the blocks normalised again
    return rows.select("uri", _long("i").alias("i"), "b.type", "b.text", F.coalesce(_long("b.level"), F.lit(0).cast("long")).alias("level"), F.coalesce("b.table_html", F.lit("")).alias("html"), F.coalesce("b.language", F.lit("")).alias("language"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("# %s\n\nPart **%d** of `%s`,\nin [stock](http://x.y).\n\n## Details\n\n- size %d\n  - type %s\n- end\n\n| brand | size |\n| --- | --- |\n| %s | %d |\n\n```sql\nselect %d\n```\n", *[F.col(f"p_{c}") for c in ("name", "partkey", "brand", "size", "type", "brand", "size", "partkey")])
    return _blocks(_parts(spark, d, text, "md"))


def html_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("<html><body><ul><li>%s <b>x</b><ol><li>%s<li>deep<ul><li>er</ul></ol></li><li>%s</ul><table><thead><tr><th>k<th>v</thead><tr><td>%d<td>a<table><tr><td>in</table></tr><tr></tr><tr><td>one</table><pre><code class=\"language-sql\">select %d</code></pre></body></html>", *[F.col(f"p_{c}") for c in ("name", "brand", "type", "partkey", "partkey")])
    return _blocks(_parts(spark, d, text, "html"))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(rows, lambda r: F.array(r["n_nationkey"].cast("string"), F.concat(r["n_name"], F.lit(" | x")))).alias("rows"))


def md_table(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d).select("n_regionkey", tables.markdown_table(F.col("rows"), F.array(F.lit("key"), F.lit("name"))).alias("md"))


def html_table(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d).select("n_regionkey", tables.html_table(F.col("rows"), F.array(F.lit("key"), F.lit("name & <more>"))).alias("html"))


def pages_without_text(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("text"), F.col("turn").cast("int").alias("page"))).alias("blocks"))
    return turns.select("conv_id", F.array_join(F.transform(F.array_sort(parse.pages_without_text("blocks", F.lit(8))), lambda x: x.cast("string")), ",").alias("pages"))


def bm25(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")
    found = retrieve.bm25_topk(_docs(spark, d), queries, 5, id_col="doc_id")
    return found.select("qid", "doc_id", F.round("score", 5).alias("score"), _long("rank").alias("rank"))


_HITS = f"""hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM ({_ranked_sql()} QUALIFY rank <= 11) WHERE qid <> vec_id),
  wanted AS (SELECT vec_id AS qid, label AS wanted FROM embeddings WHERE vec_id % 20 = 0),
  ranks AS (SELECT w.qid, min(h.place) FILTER (h.place <= 10 AND h.label = w.wanted) AS rank FROM wanted w LEFT JOIN hits h USING (qid) GROUP BY w.qid)"""
_METRICS = ", ".join(f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END) AS r{k}" for k in evaluate.KS)
_SUMMARY = f"""summary AS (SELECT avg(coalesce(1.0 / rank, 0)) AS mrr, {_METRICS} FROM ranks), metrics AS (SELECT 'mrr' AS metric, round(mrr, 6) AS value FROM summary """ + " ".join(
    f"UNION ALL SELECT '{m}@{k}', round(r{k}, 6) FROM summary" for k in evaluate.KS for m in ("recall", "hit")
) + ")"
_LABELLED = "labelled AS (SELECT d.*, d.doc_id // 40 AS qid, row_number() OVER (PARTITION BY d.doc_id // 40 ORDER BY d.doc_id) AS rank FROM documents d JOIN labels USING (doc_id))"
_BM_TERMS = r"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_H1 = r"regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _unescaped(x: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{plain}')"
    return f"regexp_replace({x}, '&amp$', '&')"


#: The blocks of the generated pages: what stands between nav and footer, cut at block tags; headings are marked.
_BLOCKS = rf"""SELECT page_id, starts_with(p, chr(2)) AS head, text, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS i FROM (
  SELECT page_id, p, k, trim(regexp_replace({_unescaped("regexp_replace(replace(p, chr(2), ''), '</?b>', '', 'g')")}, '\s+', ' ', 'g')) AS text FROM (
    SELECT page_id, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM (
      SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)</nav>(.*?)<footer>', 1), '(?s)<!--.*?-->', '', 'g'), '<br>', ' ', 'g'), '<h1>', chr(1) || chr(2), 'g'),
        '</?(?:div|article|p|h1)(?: [^>]*)?>', chr(1), 'g'), chr(1)) AS ps FROM pages))) WHERE text <> ''"""


def _attribute_sql(x: str) -> str:
    e = f"replace(replace(replace({x}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"
    return f"""CASE WHEN NOT contains({x}, '"') THEN '"' || {e} || '"' WHEN NOT contains({x}, '''') THEN '''' || {e} || '''' ELSE '"' || replace({e}, '"', '&quot;') || '"' END"""


_PACK = rf"""WITH RECURSIVE s AS (
  SELECT doc_id, text, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, text, {_SENTENCES} AS ss FROM documents)
), n AS (SELECT *, {_TOKENS.format(x="s")} AS n FROM s
), p AS (
  SELECT doc_id, i, n AS cur, 0 AS piece FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN p.cur > 0 AND p.cur + n.n <= {TARGET} THEN p.cur + n.n ELSE n.n END, CASE WHEN p.cur > 0 AND p.cur + n.n <= {TARGET} THEN p.piece ELSE p.piece + 1 END FROM p JOIN n ON n.doc_id = p.doc_id AND n.i = p.i + 1
), pieces AS (SELECT doc_id, piece AS i, string_agg(s, ' ' ORDER BY n.i) AS piece, CAST(sum(n) AS BIGINT) AS tokens FROM p JOIN n USING (doc_id, i) GROUP BY doc_id, p.piece)"""

_POINTS_SQL = "'c' || doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 4 AS chunk_index, text, '0/' || source AS uri"
_GOLDEN = rf"""points AS (SELECT *, doc_id // 40 AS qid, doc_id % 40 + 1 AS rank, contains({_NORM.format(x="text")}, 'the of') AS words FROM documents),
  entries AS (SELECT qid, rank, unnest([0, 1, 2, 3]) AS entry, unnest([doc_id % 40 = 7, source = 'src3' AND doc_id % 4 = 2, source = 'src5' AND words, false]) AS met FROM points)"""
_SCORED = """cites AS (SELECT qid, rank, bool_or(met) AS met FROM entries WHERE rank % 3 = 0 AND qid % 4 <> 0 AND qid % 5 <> 0 GROUP BY qid, rank),
  scored AS (SELECT q.qid, q.qid % 5 = 0 AS refusal, q.qid % 4 = 0 AS refused, p FROM (SELECT DISTINCT qid FROM points) q LEFT JOIN (SELECT qid, avg(CAST(met AS DOUBLE)) AS p FROM cites GROUP BY qid) USING (qid))"""
def _blocks_sql(extension: str, *blocks: tuple) -> str:
    """The blocks (type, text, level, table_html, language), given as SQL, of a document for each part."""
    rows = ", ".join(f"{{'i': {i}, 'type': '{kind}', 'text': {text}, 'level': {level}, 'html': {html}, 'language': '{language}'}}" for i, (kind, text, level, html, language) in enumerate(blocks))
    return f"SELECT uri, CAST(b.i AS BIGINT) AS i, b.type AS type, b.text AS text, CAST(b.level AS BIGINT) AS level, b.html AS html, b.language AS language FROM (SELECT p_partkey || '.{extension}' AS uri, unnest([{rows}]) AS b FROM part)"


_HASH_VECTOR = """WITH b AS (SELECT doc_id, list_transform(range(0, 32), lambda i: (CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) - 128) / 128) AS v FROM documents), l AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM b)"""

QUERIES = {
    f.__name__: f
    for f in (
        dense_retrieve, dense_topk, indexed_topk, dense_topk_filtered, cap_per_doc, cosine_expression, reciprocal_rank_fusion, doc_id, content_hash, cache_key, token_count, normalize_text, norm_span, sentences, snippet, file_names, supported_files,
        sentence_pack, chunk_ids, chunk_overlap, chunk_blocks, doc_sections, min_words, seeded_sample, cache_misses, embed_stats, embed_vectors, hash_vector, ingest_plan, ingest_report, prune, upsert_snapshot, list_documents, find_document, cached_vectors,
        payload_project, exact_count, scroll_doc, assemble_budget, render_document, citations_extract, golden_match, golden_terms, first_ranks, answer_scores, trace_rows, recall_at_k, first_hit_rank, eval_summary, baseline_compare, duplicate_ids, dedupe_questions, dedupe_numbered, with_new_cache_rows, retrieved,
        event_windows, stream_windows, smoke_rate, html_title, html_h1, html_blocks, markdown_blocks, html_lists, plain_text, md_table, html_table, pages_without_text, bm25,
    )
}

_OUTLINE = rf"""lines AS (
  SELECT doc_id, i, t, ls[1] AS title, {_TOKENS.format(x="t")} <= 8 AS head, length(t) % 6 + 1 AS level
  FROM (SELECT doc_id, ls, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), numbered AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines
), bodies AS (SELECT doc_id, k, any_value(trim(title, ' ')) AS title, string_agg(t, chr(10) ORDER BY i) AS text FROM numbered WHERE NOT head GROUP BY doc_id, k
), above AS (
  SELECT b.doc_id, b.k, h.k AS place, h.t, h.level, min(h.level) OVER (PARTITION BY b.doc_id, b.k ORDER BY h.k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest
  FROM bodies b JOIN numbered h ON h.doc_id = b.doc_id AND h.head AND h.k <= b.k
), chains AS (SELECT doc_id, k, list(t ORDER BY place) AS names FROM above WHERE lowest IS NULL OR level < lowest GROUP BY doc_id, k
), crumbs AS (
  SELECT b.doc_id, b.k, b.text, array_to_string(list_concat([b.title], CASE WHEN names IS NULL THEN [] WHEN names[1] = b.title THEN names[2:] ELSE names END), ' > ') AS breadcrumb FROM bodies b LEFT JOIN chains c ON c.doc_id = b.doc_id AND c.k = b.k
)"""
_SECTIONS = rf"""WITH {_OUTLINE}, found AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS section, breadcrumb, row_number() OVER (PARTITION BY doc_id, breadcrumb ORDER BY k) AS occurrence, text FROM crumbs)
SELECT doc_id, section, {_uuid_sql("doc_id || ':section:' || occurrence || ':' || breadcrumb")} AS section_id, breadcrumb, occurrence, text FROM found"""



def _sentences_sql(x: str) -> str:
    return _SENTENCES.replace("(text,", f"({x},")


#: Greedy packing with overlap over blocks(doc_id, k, i, kind, text, title, page), where k tells sections apart: what is too long is cut, units are packed one by one.
_CHUNKED = rf"""sized AS (SELECT *, {_TOKENS.format(x="text")} AS n FROM blocks
), cut AS (SELECT *, kind = 'table' AS rows, {_sentences_sql("text")} AS ss FROM sized WHERE n > CASE WHEN kind = 'table' THEN {CUTS.table_max_tokens} WHEN kind = 'code' THEN 1e9 ELSE {CUTS.max_tokens} END
), items AS (SELECT doc_id, i, rows, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS j FROM cut
), counted AS (SELECT doc_id, i, j, rows, s, n, n + CASE WHEN rows THEN 2 ELSE 0 END AS w, NOT rows AND n > {CUTS.max_tokens} AS long, CASE WHEN rows THEN {CUTS.table_max_tokens - 5} ELSE {CUTS.target_tokens} END AS room
  FROM (SELECT *, {_TOKENS.format(x="s")} AS n FROM items)
), runs AS (
  SELECT doc_id, i, j, w AS held, long, 1 AS piece FROM counted WHERE j = 1
  UNION ALL SELECT c.doc_id, c.i, c.j, CASE WHEN NOT (r.long OR c.long) AND r.held + c.w <= room THEN r.held + c.w ELSE c.w END, c.long, CASE WHEN NOT (r.long OR c.long) AND r.held + c.w <= room THEN r.piece ELSE r.piece + 1 END
  FROM runs r JOIN counted c ON c.doc_id = r.doc_id AND c.i = r.i AND c.j = r.j + 1
), pieces AS (
  SELECT doc_id, i, piece, bool_or(r.long) AS long, CASE WHEN any_value(rows) THEN '|  |' || chr(10) || '| --- |' || string_agg(chr(10) || '| ' || replace(s, '|', '\|') || ' |', '' ORDER BY j) ELSE string_agg(s, ' ' ORDER BY j) END AS text
  FROM runs r JOIN counted USING (doc_id, i, j) GROUP BY doc_id, i, piece
), slices AS (SELECT doc_id, i, piece, CASE WHEN long THEN list_transform(range(0, len(ws), {CUTS.target_tokens}), lambda a: array_to_string(ws[a + 1:a + {CUTS.target_tokens}], ' ')) ELSE [text] END AS texts FROM (SELECT *, regexp_split_to_array(trim(text), '\s+') AS ws FROM pieces)
), parted AS (
  SELECT doc_id, i, piece, 0 AS slice, text, piece AS part, max(piece) OVER (PARTITION BY doc_id, i) AS parts FROM pieces JOIN (SELECT DISTINCT doc_id, i FROM cut WHERE rows) USING (doc_id, i)
  UNION ALL SELECT doc_id, i, piece, unnest(range(len(texts))), unnest(texts), NULL, NULL FROM slices JOIN (SELECT DISTINCT doc_id, i FROM cut WHERE NOT rows) USING (doc_id, i)
  UNION ALL SELECT doc_id, i, 0, 0, text, NULL, NULL FROM sized ANTI JOIN cut USING (doc_id, i)
), units AS (
  SELECT p.doc_id, k, page, kind, part, parts, p.text, {_TOKENS.format(x="p.text")} AS n, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i, piece, slice) AS no
  FROM parted p JOIN (SELECT doc_id, i, k, page, CASE WHEN kind IN ('table', 'code') THEN kind ELSE 'text' END AS kind FROM blocks) b ON b.doc_id = p.doc_id AND b.i = p.i
), packed AS (
  SELECT doc_id, no, k, 1 AS g, text AS txt, n AS held, 1 AS size, kind = 'text' AS plain, kind, page AS p0, page AS p1, part, parts FROM units WHERE no = 1
  UNION ALL
  SELECT doc_id, no, k, CASE WHEN new THEN g + 1 ELSE g END, CASE WHEN NOT new THEN txt || chr(10) || chr(10) || text WHEN leads THEN lead || chr(10) || chr(10) || text ELSE text END,
    CASE WHEN NOT new THEN held + n WHEN leads THEN m + n ELSE n END, CASE WHEN NOT new THEN size + 1 WHEN leads THEN 2 ELSE 1 END, (new OR plain) AND kind = 'text', kind, CASE WHEN new THEN page ELSE p0 END, page, part, parts
  FROM (SELECT *, coalesce(new AND lead <> '' AND kind = 'text' AND m + n <= {CUTS.max_tokens}, false) AS leads FROM (SELECT *, {_TOKENS.format(x="lead")} AS m FROM (
    SELECT *, CASE WHEN new AND same AND plain AND taken < len(ss) THEN array_to_string(ss[len(ss) - taken + 1:], ' ') END AS lead FROM (
    SELECT *, greatest(1, len(list_filter(range(1, len(ss) + 1), lambda a: list_sum(ns[a:]) <= {CUTS.overlap_tokens}))) AS taken FROM (
    SELECT *, list_transform(ss, lambda s: {_TOKENS.format(x="s")}) AS ns FROM (
    SELECT u.*, g, txt, held, size, plain, p0, u.k = p.k AS same, u.k <> p.k OR held + u.n > {CUTS.target_tokens} OR u.kind = 'table' OR p.kind = 'table' AS new, {_sentences_sql("txt")} AS ss
    FROM packed p JOIN units u ON u.doc_id = p.doc_id AND u.no = p.no + 1))))))
), whole AS (SELECT * FROM packed QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY no DESC) = 1)"""


def _chunks_sql(blocks: str, sections: str, documents: str) -> str:
    """The chunks of blocks, given sections (doc_id, k, breadcrumb, occurrence) and documents (doc_id, hash)."""
    return f"""WITH RECURSIVE {blocks}, {_CHUNKED}, named AS (
      SELECT CAST(doc_id AS VARCHAR) AS doc_id, g - 1 AS chunk_index, hash, occurrence, breadcrumb, txt AS text, CASE WHEN size = 1 THEN kind ELSE 'text' END AS kind, p0, p1, part, parts FROM whole JOIN ({sections}) USING (doc_id, k) JOIN ({documents}) USING (doc_id))
    SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, {_uuid_sql("doc_id || ':' || chunk_index || ':' || hash")} AS chunk_id, {_uuid_sql("doc_id || ':section:' || occurrence || ':' || breadcrumb")} AS section_id, breadcrumb, text,
      CAST({_TOKENS.format(x="breadcrumb || chr(10) || chr(10) || text")} AS BIGINT) AS token_count, kind"""


ORACLES = {
    "dense_topk": f"SELECT qid, vec_id, round(score, 6) AS score, rank FROM ({_ranked_sql()}) WHERE rank <= 10",
    "dense_topk_filtered": f"SELECT qid, vec_id, round(score, 6) AS score, rank FROM ({_ranked_sql('AND p.label = 1')}) WHERE rank <= 10",
    "dense_retrieve": f"""SELECT qid, vec_id, CAST(label AS BIGINT) AS label, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank
      FROM (SELECT * FROM ({_ranked_sql()}) WHERE rank <= 40 QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY rank) <= 3) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 8""",
    "cap_per_doc": f"SELECT qid, vec_id, CAST(label AS BIGINT) AS label, rank FROM ({_ranked_sql()}) WHERE rank <= 40 QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY rank) <= 3",
    "cosine_expression": "SELECT q.vec_id AS qid, p.vec_id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0",
    "reciprocal_rank_fusion": f"""WITH f AS (SELECT qid, vec_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM ({_ranked_sql()}) WHERE rank <= 20 UNION ALL SELECT * FROM ({_ranked_sql('AND p.label = 1')}) WHERE rank <= 20) GROUP BY ALL)
      SELECT qid, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM f QUALIFY rank <= 10""",
    "doc_id": f"SELECT doc_id, {_uuid_sql('''source || ':' || doc_id''')} AS uuid FROM documents",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "cache_key": "SELECT doc_id, sha256(text || chr(0) || 'm' || chr(0) || '64') AS cache_key FROM documents",
    "token_count": f"SELECT doc_id, CAST({_TOKENS.format(x='text')} AS BIGINT) AS tokens FROM documents",
    "normalize_text": r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""",
    "norm_span": f"SELECT item_id, {_NORM.format(x='text')} AS span FROM benchmark",
    "sentences": f"SELECT doc_id, unnest(range(0, len(ss))) AS i, unnest(ss) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS ss FROM documents)",
    "snippet": "SELECT doc_id, replace(CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '…' ELSE text END, chr(10), ' ') AS snippet FROM documents",
    "file_names": r"SELECT page_id, regexp_extract(url, '^[^?#]*?([^/?#]*)(?:[?#].*)?$', 1) AS file, CASE WHEN file = '' THEN '' ELSE 'html' END AS suffix FROM pages",
    "supported_files": """SELECT CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'html' WHEN 2 THEN 'txt' WHEN 3 THEN 'pdf' ELSE '' END AS suffix, doc_id % 5 IN (0, 1, 3) AS supported, count(*) AS n FROM documents GROUP BY ALL""",
    "doc_sections": _SECTIONS,
    "sentence_pack": f"{_PACK} SELECT doc_id, CAST(i AS BIGINT) AS i, piece, tokens FROM pieces",
    "chunk_ids": f"{_PACK} SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(i AS BIGINT) AS i, {_uuid_sql('''doc_id || ':' || i || ':' || hash''')} AS chunk_id FROM (SELECT p.doc_id, p.i, sha256(d.text) AS hash FROM pieces p JOIN documents d USING (doc_id))",
    "chunk_overlap": _chunks_sql(
        "blocks AS (SELECT doc_id, 1 AS k, i, 'paragraph' AS kind, text, i AS page FROM (SELECT doc_id, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(text, ' ') <> '')",
        "SELECT doc_id, 1 AS k, 'Document ' || doc_id AS breadcrumb, 1 AS occurrence FROM documents",
        "SELECT doc_id, sha256(text) AS hash FROM documents",
    )
    + " FROM named",
    "chunk_blocks": _chunks_sql(
        f"""{_OUTLINE}, blocks AS (SELECT doc_id, k, i, CASE i % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'code' WHEN 2 THEN 'list' ELSE 'paragraph' END AS kind,
          CASE i % 6 WHEN 1 THEN '```' || chr(10) || t || chr(10) || '```' WHEN 2 THEN repeat('  ', CAST(i % 3 AS INT)) || '- ' || t ELSE t END AS text, i AS page FROM numbered WHERE NOT head)""",
        "SELECT doc_id, k, breadcrumb, row_number() OVER (PARTITION BY doc_id, breadcrumb ORDER BY k) AS occurrence FROM crumbs",
        "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
    )
    + ", CAST(p0 AS BIGINT) AS page_start, CAST(p1 AS BIGINT) AS page_end, CAST(CASE WHEN kind = 'table' THEN part END AS BIGINT) AS part, CAST(CASE WHEN kind = 'table' THEN parts END AS BIGINT) AS parts FROM named",
    "min_words": f"SELECT doc_id FROM documents WHERE {_TOKENS.format(x='text')} >= 12",
    "seeded_sample": f"SELECT doc_id FROM documents WHERE {_TOKENS.format(x='text')} >= 12 ORDER BY md5(doc_id || ':7'), doc_id LIMIT 60",
    "cache_misses": "SELECT DISTINCT sha256(text || chr(0) || 'm' || chr(0) || '64') AS key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
    "embed_stats": f"""WITH m AS (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)), t AS (SELECT count(*) AS embedded, CAST(sum({_TOKENS.format(x='text')}) AS BIGINT) AS tokens FROM m)
      SELECT (SELECT count(*) FROM documents) AS texts, (SELECT count(*) FROM documents) - embedded AS hits, embedded, CAST(ceil(embedded / 256) AS BIGINT) AS api_calls, tokens, round(tokens / 1e6 * 0.13, 9) AS usd FROM t""",
    "hash_vector": f"{_HASH_VECTOR} SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(round(x / n * 100000000) AS BIGINT)), ',') AS vector FROM l",
    "embed_vectors": f"{_HASH_VECTOR} SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(round(CAST(CAST(x / n AS FLOAT) AS DOUBLE) * 1000) AS BIGINT)), ',') AS vector FROM l",
    "ingest_plan": f"WITH {_OLD} SELECT uri, action FROM planned",
    "ingest_report": f"WITH {_OLD} SELECT action, count(*) AS n FROM planned GROUP BY action",
    "prune": f"WITH {_OLD} SELECT uri, doc_id FROM old ANTI JOIN items USING (uri)",
    "upsert_snapshot": f"""WITH {_OLD}, fresh AS (SELECT doc_id, content_hash FROM items JOIN planned USING (uri) WHERE action IN ('new', 'changed')), touched AS (SELECT doc_id FROM fresh UNION ALL SELECT known_doc_id FROM planned WHERE action = 'prune')
      SELECT doc_id, content_hash FROM old ANTI JOIN touched USING (doc_id) UNION ALL SELECT doc_id, content_hash FROM fresh""",
    "list_documents": "SELECT source, 'doc/' || doc_id AS uri, sha256(text) AS content_hash FROM documents WHERE source = 'src0' AND starts_with('doc/' || doc_id, 'doc/1') ORDER BY uri",
    "find_document": "SELECT source, 'doc/' || doc_id AS uri, sha256(text) AS content_hash FROM documents WHERE source = 'src0' AND doc_id = 40",
    "cached_vectors": "SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents",
    "payload_project": f"SELECT {_POINTS_SQL}, lang AS title, source, 'txt' AS doc_type, CAST(1 AS BIGINT) AS pipeline_version, CASE WHEN lang <> 'en' THEN lang END AS kind FROM documents",
    "exact_count": "SELECT 'all' AS what, count(*) AS n FROM documents UNION ALL SELECT 'src0', count(*) FILTER (source = 'src0') FROM documents UNION ALL SELECT 'none', count(*) FILTER (lang IS NULL) FROM documents",
    "with_new_cache_rows": "SELECT sha256(text || chr(0) || 'm' || chr(0) || '64') AS key, CASE WHEN min(doc_id) % 3 = 0 THEN 'old' ELSE 'new' END AS model FROM documents GROUP BY text",
    "retrieved": "SELECT source AS qid, 'c' || doc_id AS chunk_id, doc_id AS rank, text, CASE WHEN lang <> 'en' THEN lang ELSE 'text' END AS kind, '0/' || source AS uri FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0",
    "scroll_doc": "SELECT conv_id AS doc_id, turn AS chunk_index, role, text FROM conversations WHERE conv_id = 1 ORDER BY turn",
    "assemble_budget": f"WITH {_LABELLED} SELECT qid, doc_id, rank, CAST(sum(n_chars) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS so_far FROM labelled QUALIFY so_far <= 12000 OR rank = 1",
    "render_document": f"""WITH {_LABELLED}, x AS (SELECT *, 'A "b" & <' || source || '''s>' AS title FROM labelled)
      SELECT qid, doc_id, '<document id="' || rank || '" title=' || {_attribute_sql('title')} || ' uri=' || {_attribute_sql('source')} || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' page="3"' ELSE ' page="3-5"' END || '>' || chr(10)
        || CASE WHEN doc_id % 2 = 0 THEN 'x > y' || chr(10) || chr(10) ELSE '' END || text || chr(10) || '</document>' AS block FROM x""",
    "citations_extract": r"""SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN '2,1' WHEN 1 THEN '1,2' WHEN 3 THEN '3,2,1' ELSE '2,1' END AS numbers,
      trim(regexp_replace(regexp_replace(text || ' ' || CASE WHEN turn % 4 = 0 THEN '' ELSE '[' || turn % 4 || ']' END || ' and  , so [2][1].', '[ \t]{2,}', ' ', 'g'), '[ \t]+([.,;:])', '\1', 'g')) AS answer FROM conversations""",
    "golden_match": f"WITH d AS (SELECT doc_id, {_NORM.format(x='text')} AS t FROM documents), i AS (SELECT item_id, {_NORM.format(x='text')} AS s FROM benchmark) SELECT item_id, doc_id FROM i JOIN d ON contains(t, s) WHERE s <> ''",
    "recall_at_k": f"WITH {_HITS}, {_SUMMARY} SELECT * FROM metrics",
    "first_hit_rank": f"WITH {_HITS} SELECT qid, coalesce(rank, 0) AS first_hit_rank, round(coalesce(1.0 / rank, 0), 6) AS reciprocal_rank, CAST(coalesce(rank <= 5, false) AS DOUBLE) AS hit_5 FROM ranks",
    "first_ranks": f"WITH {_GOLDEN} SELECT qid, entry, CAST(min(rank) FILTER (met) AS BIGINT) AS rank FROM entries GROUP BY qid, entry",
    "answer_scores": f"WITH {_GOLDEN}, {_SCORED} SELECT qid, refusal, refused, refused = refusal AS refusal_correct, round(p, 6) AS citation_precision, coalesce(p, 0) > 0 AS citation_hit FROM scored",
    "eval_summary": f"""WITH {_GOLDEN}, {_SCORED}
      SELECT 'false_refusal_rate' AS metric, round(avg(CAST(refused AS DOUBLE)) FILTER (NOT refusal), 6) AS value FROM scored UNION ALL SELECT 'refusal_accuracy', round(avg(CAST(refused AS DOUBLE)) FILTER (refusal), 6) FROM scored
      UNION ALL SELECT 'citation_precision', round(avg(p) FILTER (NOT refusal), 6) FROM scored UNION ALL SELECT 'citation_hit_rate', round(avg(CASE WHEN coalesce(p, 0) > 0 THEN 1.0 ELSE 0.0 END) FILTER (NOT refusal), 6) FROM scored""",
    "trace_rows": "SELECT 'q' || id AS query, 'a' || id AS answer, id % 4 = 0 AS refused, 'm' AS model, id % 9 AS latency_ms, 'c' || (id * 40 + 1) AS cited, round(id / 3, 4) AS score FROM (SELECT DISTINCT doc_id // 40 AS id FROM documents)",
    "baseline_compare": f"""WITH {_HITS}, {_SUMMARY}, base AS (SELECT metric, value + 0.125 AS value FROM metrics WHERE metric <> 'hit@10' UNION ALL SELECT 'judge_x', 0.5)
      SELECT coalesce(b.metric, c.metric) AS metric, round(b.value, 6) AS baseline, c.value AS current, round(c.value - b.value, 6) AS delta FROM base b FULL JOIN metrics c ON b.metric = c.metric""",
    "duplicate_ids": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "dedupe_numbered": f"SELECT printf('syn-%04d', row_number() OVER (ORDER BY conv_id, turn)) AS id, conv_id, turn FROM (SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY {_NORM.format(x='text')} ORDER BY conv_id, turn) = 1)",
    "golden_terms": f"WITH d AS (SELECT doc_id, {_NORM.format(x='text')} AS t FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, array_to_string(string_split({_NORM.format(x='text')}, ' ')[1 : item_id % 6 + 1], ' ') AS s FROM benchmark UNION ALL SELECT 'nation ' || n_nationkey, lower(substr(n_name, 1, 2)) FROM nation) SELECT item_id, doc_id FROM i JOIN d ON contains(t, s) WHERE s <> ''",
    "dedupe_questions": f"SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY {_NORM.format(x='text')} ORDER BY conv_id, turn) = 1",
    "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "smoke_rate": f"""WITH x AS (SELECT doc_id, toxic = 1 AS refused, doc_id % 3 = 0 OR doc_id % 10 = 0 AS file, doc_id % 2 = 0 OR contains({_NORM.format(x='text')}, {_NORM.format(x='substr(text, 3, 9)')}) AS held FROM documents JOIN labels USING (doc_id)),
      y AS (SELECT CASE WHEN doc_id % 10 = 0 THEN refused ELSE NOT refused AND file AND held END AS passed FROM x) SELECT count(*) AS n, count(*) FILTER (NOT passed) AS failed, round(avg(CAST(passed AS DOUBLE)), 6) AS rate FROM y""",
    "html_title": f"SELECT page_id || '.html' AS uri, trim(regexp_replace({_unescaped(_TITLE)}, '\\s+', ' ', 'g')) AS title FROM pages",
    "html_h1": f"SELECT page_id || '.html' AS uri, trim(regexp_replace({_unescaped(_H1)}, '\\s+', ' ', 'g')) AS h1 FROM pages",
    "html_blocks": f"SELECT {_uuid_sql(chr(39) + 'pages:' + chr(39) + ' || page_id || ' + chr(39) + '.html' + chr(39))} AS doc_id, i AS block_index, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS type, text, CAST(CASE WHEN head THEN 1 ELSE 0 END AS BIGINT) AS level FROM ({_BLOCKS})",
    "plain_text": f"SELECT page_id || '.html' AS uri, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, true AS no_pages FROM ({_BLOCKS}) GROUP BY page_id",
    "markdown_blocks": _blocks_sql(
        "md",
        ("heading", "p_name", 1, "''", ""),
        ("paragraph", "'Part ' || p_partkey || ' of ' || p_brand || ', in stock.'", 0, "''", ""),
        ("heading", "'Details'", 2, "''", ""),
        ("list_item", "'size ' || p_size", 1, "''", ""),
        ("list_item", "'type ' || p_type", 2, "''", ""),
        ("list_item", "'end'", 1, "''", ""),
        ("table", "'| brand | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' | ' || p_size || ' |'", 0, "'<table><thead><tr><th>brand</th><th>size</th></tr></thead><tbody><tr><td>' || p_brand || '</td><td>' || p_size || '</td></tr></tbody></table>'", ""),
        ("code", "'select ' || p_partkey", 0, "''", "sql"),
    ),
    "html_lists": _blocks_sql(
        "html",
        ("list_item", "p_name || ' x'", 1, "''", ""),
        ("list_item", "p_brand", 2, "''", ""),
        ("list_item", "'deep'", 2, "''", ""),
        ("list_item", "'er'", 3, "''", ""),
        ("list_item", "p_type", 1, "''", ""),
        ("table", "'| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | ain |' || chr(10) || '| one |  |'", 0, "'<table><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>' || p_partkey || '</td><td>ain</td></tr><tr><td>one</td></tr></tbody></table>'", ""),
        ("code", "'select ' || p_partkey", 0, "''", "sql"),
    ),
    "md_table": """SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' \\| x |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""",
    "html_table": """SELECT n_regionkey, '<table><thead><tr><th>key</th><th>name &amp; &lt;more&gt;</th></tr></thead><tbody>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || ' | x</td></tr>', '' ORDER BY n_nationkey) || '</tbody></table>' AS html FROM nation GROUP BY n_regionkey""",
    "pages_without_text": """SELECT conv_id, coalesce(array_to_string(list_filter(range(1, 9), lambda x: NOT list_contains(list(turn) FILTER (trim(coalesce(text, '')) <> ''), x)), ','), '') AS pages FROM conversations GROUP BY conv_id""",
    "bm25": f"""WITH t AS (SELECT doc_id, {_BM_TERMS.format(x='text')} AS ts FROM documents), st AS (SELECT count(*) AS total, avg(len(ts)) AS mean FROM t), e AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM t),
      c AS (SELECT doc_id, n, term, count(*) AS tf FROM e GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), q AS (SELECT DISTINCT item_id AS qid, unnest({_BM_TERMS.format(x='text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
      s AS (SELECT qid, doc_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM c JOIN f USING (term) JOIN q USING (term), st GROUP BY ALL)
      SELECT qid, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""",
}
