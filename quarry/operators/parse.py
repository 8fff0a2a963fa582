"""Files to documents: routing by extension, parsers as an Arrow function, and normalisation as expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import htmldoc, markdown, office
from quarry.schemas import BLOCK

#: A parser takes bytes and returns (title, blocks, metadata).
Parser = Callable[[bytes], tuple[str | None, list[dict], dict]]


def _markdown(data: bytes):
    title, blocks, front = markdown.parse(data.decode("utf-8", "replace"))
    return title, blocks, {"front_matter": front}


def _html(data: bytes):
    return *htmldoc.parse(data.decode("utf-8", "replace")), {}


def _plain(data: bytes):
    paragraphs = data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n\n")
    return None, [htmldoc.block("paragraph", p) for p in paragraphs if p.strip()], {}


def _office(read) -> Parser:
    return lambda data: (*read(data), {})


AT_ONCE = 100  # files whose blocks a task holds as Python objects

#: extension: (kind of document, parser, version)
PARSERS: dict[str, tuple[str, Parser, str]] = {
    **{x: ("markdown", _markdown, "1") for x in ("md", "markdown", "mdx")},
    **{x: ("html", _html, "1") for x in ("html", "htm", "xhtml")},
    "docx": ("docx", _office(office.docx), "1"),
    "pptx": ("pptx", _office(office.pptx), "1"),
    "xlsx": ("xlsx", _office(office.xlsx), "1"),
    "pdf": ("pdf", _office(office.pdf), "1"),
}
SUPPORTED = tuple(PARSERS)


def supported(uri: Column | str) -> Column:
    return C.suffix(uri).isin(*SUPPORTED)


def parse_bytes(extension: str, data: bytes) -> dict:
    """What a parser makes of a file; errors come back as a value, so that one file never fails a job."""
    kind, parser, version = PARSERS.get(extension.lower(), (None, None, None))
    out = {"title": None, "doc_type": kind, "parser": kind, "parser_version": version, "blocks": None, "metadata": None, "error": None}
    try:
        if parser is None:
            raise office.UnsupportedError(f"no parser for .{extension}")
        title, blocks, metadata = parser(bytes(data))
    except Exception as error:
        return out | {"error": f"{type(error).__name__}: {error}"}
    return out | {"title": title, "blocks": blocks, "metadata": json.dumps(metadata, default=str)}


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (source, uri, content, last_modified, size_bytes) as normalised documents with a column ``error``; a failed file has no blocks."""
    about = ["source", "uri", "content_hash", "last_modified", "size_bytes"]
    rows = files.select(*about, C.suffix("uri").alias("extension"), "content")
    made = ["title", "doc_type", "parser", "parser_version", "metadata", "error"]
    kind = pa.list_(
        pa.struct([("type", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("page", pa.int32()), ("bbox", pa.list_(pa.float64())), ("table_html", pa.string()), ("language", pa.string())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            *kept, extensions, contents = batch.columns
            found = [parse_bytes(x.as_py(), d.as_py() or b"") for x, d in zip(extensions, contents, strict=True)]
            cols = [pa.array([f[n] for f in found], pa.string()) for n in made]
            yield pa.RecordBatch.from_arrays([*kept, *cols, pa.array([f["blocks"] for f in found], kind)], names=[*about, *made, "blocks"])

    schema = "source string, uri string, content_hash string, last_modified timestamp, size_bytes long, " + "".join(f"{n} string, " for n in made)
    joined = rows.mapInArrow(run, f"{schema}blocks {BLOCK_ARRAY}")
    named = joined.withColumn("title", F.coalesce(F.when(F.trim("title") != "", F.col("title")), C.stem("uri")))
    named = named.withColumn("metadata", F.to_json(F.struct(C.file_name("uri").alias("filename"), F.col("size_bytes"), F.col("metadata").alias("parser"))))
    return normalised(named.withColumn("doc_id", C.doc_id("source", "uri")).withColumn("acl", F.array().cast("array<string>")))


BLOCK_ARRAY = f"array<{BLOCK.simpleString()}>"


def normalised(docs: DataFrame) -> DataFrame:
    """Texts of blocks trimmed and collapsed, but of code only the outer newlines go, and tables are trimmed; empty blocks go. The title is normalised."""

    def one(b: Column) -> Column:
        text = F.when(b["type"] == "code", F.regexp_replace(b["text"], r"^\n+|\n+$", "")).when(b["type"] == "table", F.trim(b["text"])).otherwise(C.normalize_text(b["text"]))
        return b.withField("text", F.coalesce(text, F.lit("")))

    kept = F.filter(F.transform("blocks", one), lambda b: (b["text"] != "") | b["table_html"].isNotNull())
    return docs.withColumns({"blocks": kept, "title": C.normalize_text("title")})


def plain_text(blocks: Column | str) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")


def page_count(blocks: Column | str) -> Column:
    return F.array_max(F.transform(blocks, lambda b: b["page"]))


def pages_without_text(blocks: Column | str, pages: Column) -> Column:
    """The numbers from 1 to ``pages`` that no block with a text has."""
    texts = F.filter(blocks, lambda b: F.trim(b["text"]) != "")
    return F.array_except(F.sequence(F.lit(1), pages), F.transform(texts, lambda b: b["page"]))


def exploded(docs: DataFrame) -> DataFrame:
    """One row per block, in order."""
    rows = docs.select("doc_id", F.posexplode_outer("blocks").alias("block_index", "b")).where("block_index IS NOT NULL")  # without outer, a filter on the array's size would have the blocks normalised again
    return rows.select("doc_id", "block_index", "b.*")
