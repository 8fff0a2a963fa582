"""Which documents hold which spans, white space and case aside, without comparing all texts with all spans.

A span that occurs in a text has its inner words there as whole words; only its outer ones may be parts of words. Long spans and documents meet by a hash of eight inner words in a row,
shorter ones by their rarest inner word. Spans of one or two words have none: their longer word is part of some word of the document, and the words that hold it are found among the different
words of all documents by its rarest gram of up to three characters. Texts are compared where they met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.sources.files import scratch

RUN = 8  # words in a row that are hashed
GRAM = 3  # characters


def _grams(word: Column, q: int) -> Column:
    """The different runs of q characters of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word) - (q - 1)), lambda i: F.substring(word, i, F.lit(q))))


def _rarest(wanted: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Of each span's keys that which ``counts`` (key, n) has least often: rows (span, key)."""
    return wanted.join(counts, key, "left").groupBy("span").agg(F.min_by(key, F.struct(F.coalesce("n", F.lit(0)), key)).alias(key))


def _stored(df: DataFrame) -> DataFrame:
    """A table in the run's own folder, so that what is used several times is made once, and its size is known before it's joined."""
    path = scratch(df.sparkSession, "spans")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def span_matches(docs: DataFrame, spans: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", span: str = "span") -> DataFrame:
    """Distinct rows (item, doc) of non-empty spans and the documents whose text holds them. Null and empty spans match nothing.

    Texts are split into words at most twice: once for the words' counts, and once to meet the spans by the words found for them. Both, and the words found, are tables on disk; runs of words take one more pass.
    """
    asked = spans.select(F.col(item).alias("item"), C.norm(span).alias("span")).where("span != ''").withColumn("words", F.split("span", " "))
    texts = docs.select(F.col(doc).alias("doc"), C.norm(text).alias("norm"))
    kinds = asked.select("span", "words").distinct().withColumn("n", F.size("words"))
    words = F.split("norm", " ")

    runs = kinds.where(F.col("n") >= RUN + 2).select("span", F.get(C.run_hashes(F.slice("words", 2, RUN), RUN), F.lit(0)).alias("key"))
    held = texts.select("doc", F.explode_outer(F.array_distinct(C.run_hashes(words, RUN))).alias("key")).where("key IS NOT NULL")
    met = held.join(runs.select("key").distinct(), "key", "left_semi").join(runs, "key").select("doc", "span", F.lit(False).alias("sure"))

    short = kinds.where(F.col("n") < RUN + 2)
    if not short.isEmpty():
        every = texts.select("doc", F.explode_outer(F.array_distinct(words)).alias("word"))
        vocabulary = _stored(every.groupBy("word").agg(F.count("*").alias("n")))
        inner = short.where("n > 2").select("span", F.explode(F.slice("words", F.lit(2), F.col("n") - 2)).alias("word")).distinct()
        keys = _rarest(inner, vocabulary, "word").select("span", "word", F.lit(False).alias("sure"))

        longer = F.get(F.array_sort(F.transform("words", lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
        needles = short.where("n <= 2").select("span", longer.alias("needle"), (F.col("n") == 1).alias("sure"))
        for q in range(1, GRAM + 1):
            own = needles.where(F.char_length("needle") == q if q < GRAM else F.char_length("needle") >= q)
            grams = own.select("span", F.explode(_grams(F.col("needle"), q)).alias("gram"))
            there = vocabulary.where(F.char_length("word") >= q).select("word", F.explode(_grams(F.col("word"), q)).alias("gram")).join(grams.select("gram").distinct(), "gram", "left_semi")
            rare = _rarest(grams, there.groupBy("gram").agg(F.count("*").alias("n")), "gram")
            keys = keys.unionByName(rare.join(there, "gram").join(own, "span").where(F.col("word").contains(F.col("needle"))).select("span", "word", "sure"))
        met = met.unionByName(every.join(_stored(keys), "word").select("doc", "span", "sure"))

    # a word that holds a span of one word is all there is to it; other texts are compared
    found = met.distinct().join(texts, "doc").where(F.col("sure") | F.col("norm").contains(F.col("span"))).select("doc", "span")
    return found.join(asked.select("item", "span"), "span").select(F.col("item").alias(item), F.col("doc").alias(doc)).distinct()
