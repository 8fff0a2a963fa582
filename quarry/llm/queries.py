"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontam, divergence, htmltext, langid, licenses, mixing, neighbours, pii, quality, simhash, stamps, urlfilter
from quarry.llm.common import table

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licences(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.size("sentences").cast("long").alias("n_sentences"), F.array_join("licences", ",").alias("licences"), F.array_join("kinds", ",").alias("kinds"), F.array_join("sentences", ",").alias("sentences"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "rate", "copies")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def held_out(doc_id) -> F.Column:
    """Rows that language identification doesn't learn from; a null id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out("doc_id"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), *[F.col(f"_langid.{c}").alias(name) for c, name in (("lang", "lang_pred"), ("score", "score"), ("rejected", "rejected"))])


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t (conv_id, turn, role, text)")
    return chat.read_back(chat.format_conversations(rows.unionByName(trap)), sort=False)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return found.withColumnRenamed("id", "page_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    found = found.select("id", "spans", pii.listed(F.col("base")).alias("base_listed"), *counts)
    found = found.withColumn("base_sha256", F.sha2(F.col("base_listed").cast("binary"), 256)).withColumn("spans", pii.listed(F.col("spans")))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.BASE], "base_sha256", "spans", "n_term", "n_secret")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("id").cast("long").alias("vec_id"), "score")


def op12_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stamps.normalise(table(spark, sf_dir, "stamps"))
    return found.select("stamp_id", "_utc.*")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=30, k=50)


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_langid": op7_langid,
    "op8_chat_format": op8_chat_format,
    "op9_personal_data": op9_personal_data,
    "op10_url_filter": op10_url_filter,
    "op11_nearest": op11_nearest,
    "op12_stamps": op12_stamps,
    "op13_divergence": op13_divergence,
}
