"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _parts(text: str) -> list[str]:
    """Split at commas that aren't between angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _kind(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_kind(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _kind(k)) for n, k in (x.split(":", 1) for x in _parts(text[7:-1]))])
    return _SIMPLE[text]


def _schema(text: str) -> T.StructType:
    """A schema from its DDL; Spark's own parser needs a session."""
    return T.StructType([T.StructField(n, _kind(k)) for n, k in (x.split(" ", 1) for x in _parts(text))])


BLOCK = _schema("type string, text string, level int, page int, bbox array<double>, table_html string, language string")
DOCUMENT = _schema("doc_id string, source string, uri string, title string, doc_type string, content_hash string, last_modified timestamp, parser string, parser_version string, acl array<string>, metadata string").add("blocks", T.ArrayType(BLOCK))
CHUNK = _schema(
    "chunk_id string, doc_id string, chunk_index int, section_id string, breadcrumb string, text string, embed_text string, token_count int, kind string, page_start int, page_end int, content_hash string, table_part struct<part:int,total:int>"
)
POINT = _schema(
    "chunk_id string, doc_id string, chunk_index int, section_id string, breadcrumb string, text string, token_count int, kind string, page_start int, page_end int, content_hash string, table_part struct<part:int,total:int>, "
    "title string, uri string, source string, doc_type string, last_modified timestamp, pipeline_version int, acl array<string>, vector array<float>"
)
STATE = _schema(
    "doc_id string, source string, uri string, title string, doc_type string, content_hash string, last_modified timestamp, parser string, parser_version string, pipeline_version int, embedding_model string, embedding_dims int, "
    "chunk_count int, status string, error string, parsed_path string, metadata string, acl array<string>, indexed_at timestamp, created_at timestamp, updated_at timestamp"
)
CACHE = _schema("key string, model string, dims int, vector array<float>, created_at timestamp")
TRACE = _schema(
    "trace_id string, created_at timestamp, conversation_id string, query string, rewritten_query string, retrieved array<struct<chunk_id:string,doc_id:string,score:double>>, cited_chunk_ids array<string>, answer string, refused boolean, tool_calls string, "
    "model string, input_tokens int, output_tokens int, retrieval_ms int, llm_ms int, latency_ms int, error string, metadata string"
)
EXPECTED = _schema("uri string, chunk_index int, chunk_id string, span string")
GOLDEN = _schema("id string, question string, answer string").add("expected", T.ArrayType(EXPECTED)).add("kind", "string").add("origin", "string").add("notes", "string")
