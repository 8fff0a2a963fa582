import hashlib
import uuid
from xml.sax.saxutils import quoteattr

import pytest
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import embed


def one(spark, column, **values):
    names = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], names).select(column.alias("y")).first()["y"]


def test_ids_equal_python(spark):
    ns = uuid.UUID(C.NAMESPACE)
    for name in ("local:a.md", "é:ü/😀", ":"):
        assert one(spark, C.uuid5("x"), x=name) == str(uuid.uuid5(ns, name))
    assert one(spark, C.chunk_id("d", "i", "h"), d="D", i=3, h="H") == str(uuid.uuid5(ns, "D:3:H"))
    assert one(spark, C.section_id("d", "i", "b"), d="D", i=2, b="T > S") == str(uuid.uuid5(ns, "D:section:2:T > S"))
    assert one(spark, C.cache_key("x", F.lit("m"), F.lit(64)), x="té") == hashlib.sha256("té\0m\00064".encode()).hexdigest()


def test_normalising(spark):
    assert one(spark, C.normalize_text("x"), x="a \t b\r\n\n\n\n c\u00a0d  ") == "a b\n\nc d"
    assert one(spark, C.normalize_text("x"), x="a\u2028b\x0cc\rd") == "a\nb\nc\nd"
    assert one(spark, C.norm("x"), x="  A   b\nC ") == "a b c"
    assert one(spark, C.norm("x"), x=None) == ""


def test_counting_and_sentences(spark):
    assert [one(spark, C.token_count("x"), x=x) for x in ("", "  ", "a", " a  b\nc ")] == [0, 0, 1, 3]
    assert one(spark, C.sentences("x"), x="One. Two!  Three? four.5 end") == ["One.", "Two!", "Three?", "four.5 end"]


def test_names_and_snippets(spark):
    assert one(spark, C.file_name("x"), x="a/b/c.tar.gz") == "c.tar.gz"
    assert one(spark, C.suffix("x"), x="a/b/c.MD") == "md" and one(spark, C.suffix("x"), x="a/.md") == ""
    assert one(spark, C.stem("x"), x="a/b/c.md") == "c" and one(spark, C.stem("x"), x="a/b/c") == "c"
    long = one(spark, C.snippet("x"), x="x" * 1000)
    assert len(long) == 240 and long.endswith("…")
    assert one(spark, C.snippet("x"), x="a\nb") == "a b"


@pytest.mark.parametrize("text", ["plain", 'two "quotes"', "it's", "both \" and '", "<a & b>", "a\nb\tc"])
def test_attributes_are_quoted(spark, text):
    assert one(spark, C.quoted_attribute("x"), x=text) == quoteattr(text)


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in rows.select(C.cosine("a", "b")).collect()] == [0.707107, 0.0]


def test_hash_vector_hashes_a_text_once(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "text string")
    found = rows.select(embed.hash_vector("text").alias("v"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert [[round(x, 9) for x in r["v"]] for r in found.collect()] == [*([round(x, 9) for x in v] for v in embed.HashEmbedder().embed(["a", ""])), [0.0] * 32]
    assert spark.createDataFrame([([3.0, 4.0],), ([0.0],), (None,)], "v array<double>").select(C.unit("v").alias("u")).collect() == [([0.6, 0.8],), ([0.0],), (None,)]
