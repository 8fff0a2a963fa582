"""Documents to chunks: sections by headings, units by block, greedy packing with overlap.

The rules need state that runs through a document, so documents are folded one by one in Arrow batches; each is folded in linear time and no
document meets another. Identifiers and counts that don't are expressions. ``pack_sentences`` is the packing of plain texts as an expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import Chunking
from quarry.functions import columns as C
from quarry.operators.tables import from_html, to_markdown
from quarry.schemas import CHUNK

Counter = Callable[[str], int]
CRUMBS = " > "
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def count_words(text: str) -> int:
    return len(text.split())


def bpe_counter(path: str) -> Callable[[], Counter]:
    """A counter of byte-level BPE tokens from a file of ranks, made once in each worker."""

    def make() -> Counter:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return make


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def _packed(items: Iterable, over: Callable[[list], bool]) -> Iterator[list]:
    """Greedy groups: an item that would make a group ``over`` begins the next one."""
    group: list = []
    for x in items:
        if group and over([*group, x]):
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def _filled(items: Iterable[str], count: Counter, room: int) -> Iterator[list[str]]:
    """Greedy groups of texts whose counts add up to ``room`` at most, or of one text."""
    group, held = [], 0
    for x in items:
        n = count(x)
        if group and held + n > room:
            yield group
            group, held = [], 0
        group.append(x)
        held += n
    if group:
        yield group


def sections(title: str, blocks: Iterable[dict]) -> Iterator[tuple[list[str], list[dict]]]:
    """(breadcrumb, blocks) of each heading that has blocks of its own. A heading is under the last ones of lower levels; a first
    heading that repeats the title isn't repeated."""
    title = title.strip()
    above: list[tuple[int, str]] = []
    crumbs, body = [title], []
    for b in blocks:
        if b["type"] != "heading":
            body.append(b)
            continue
        if body:
            yield crumbs, body
        level = b["level"] or 1
        above = [h for h in above if h[0] < level] + [(level, b["text"])]
        names = [name for _, name in above]
        crumbs, body = [title, *(names[1:] if names[0] == title else names)], []
    if body:
        yield crumbs, body


def _unit(text: str, kind: str, count: Counter, page: int | None, part: tuple[int, int] | None = None) -> dict:
    return {"text": text, "kind": kind, "tokens": count(text), "page": page, "part": part}


def long_text(text: str, s: Chunking, count: Counter) -> Iterator[str]:
    """Pieces of a text that is too long: sentences up to the target, and words of sentences that are too long themselves."""
    run: list[str] = []

    def close() -> Iterator[str]:
        for group in _filled(run, count, s.target_tokens):
            yield " ".join(group)
        run.clear()

    for sentence in sentences(text):
        if count(sentence) <= s.max_tokens:
            run.append(sentence)
            continue
        yield from close()
        for group in _packed(sentence.split(), lambda g: count(" ".join(g)) > s.target_tokens):
            yield " ".join(group)
    yield from close()


def units(blocks: Iterable[dict], s: Chunking, count: Counter) -> Iterator[dict]:
    for b in blocks:
        kind, text, page = b["type"], b["text"], b["page"]
        if kind == "table":
            rows, header = from_html(b["table_html"] or "") if count(text) > s.table_max_tokens else ([], None)
            parts = list(_packed(rows, lambda g, header=header: count(to_markdown(g, header)) > s.table_max_tokens))
            for k, part in enumerate(parts, 1):
                yield _unit(to_markdown(part, header), "table", count, page, (k, len(parts)))
            if not parts:
                yield _unit(text, "table", count, page)
        elif kind == "code":
            yield _unit(f"```{b['language'] or ''}\n{text}\n```", "code", count, page)
        else:
            if kind == "list_item":
                text = "  " * max((b["level"] or 1) - 1, 0) + "- " + text
            for piece in [text] if count(text) <= s.max_tokens else long_text(text, s, count):
                yield _unit(piece, "text", count, page)


def overlap(group: list[dict], s: Chunking, count: Counter) -> str | None:
    """The last sentences of a group of texts, at least one and else up to the overlap, but never all of them."""
    if s.overlap_tokens <= 0 or any(u["kind"] != "text" for u in group):
        return None
    all_ = sentences("\n\n".join(u["text"] for u in group))
    taken = next(_filled(reversed(all_), count, s.overlap_tokens), [])
    return " ".join(reversed(taken)).strip() or None if len(taken) < len(all_) else None


def packed_units(all_: Iterable[dict], s: Chunking, count: Counter) -> Iterator[list[dict]]:
    """Groups of units that make a chunk each. Tables stand alone; others fill up to the target; a group of texts hands its last
    sentences on to a text that begins the next one, if both fit into the maximum."""
    group: list[dict] = []
    held = 0  # tokens of the group
    tail: str | None = None
    for u in all_:
        if group and (held + u["tokens"] > s.target_tokens or u["kind"] == "table"):
            yield group
            tail, group, held = overlap(group, s, count), [], 0
        if u["kind"] == "table":
            yield [u]
            tail = None
            continue
        if not group and tail and u["kind"] == "text":
            lead = _unit(tail, "text", count, u["page"])
            if lead["tokens"] + u["tokens"] <= s.max_tokens:
                group.append(lead)
                held += lead["tokens"]
        group.append(u)
        held += u["tokens"]
    if group:
        yield group


def fold(title: str, blocks: list[dict], s: Chunking, count: Counter) -> list[dict]:
    """The chunks of a document, without identifiers."""
    out: list[dict] = []
    seen: dict[str, int] = {}
    for crumbs, body in sections(title, blocks):
        crumb = CRUMBS.join(crumbs)
        seen[crumb] = seen.get(crumb, 0) + 1
        for group in packed_units(units(body, s, count), s, count):
            text = "\n\n".join(u["text"] for u in group)
            pages = [u["page"] for u in group if u["page"] is not None]
            alone = group[0] if len(group) == 1 else None
            part = alone["part"] if alone else None
            out.append(
                {
                    "chunk_index": len(out),
                    "occurrence": seen[crumb],
                    "breadcrumb": crumb,
                    "text": text,
                    "embed_text": f"{crumb}\n\n{text}",
                    "token_count": count(f"{crumb}\n\n{text}"),
                    "kind": alone["kind"] if alone else "text",
                    "page_start": min(pages, default=None),
                    "page_end": max(pages, default=None),
                    "table_part": {"part": part[0], "total": part[1]} if part else None,
                }
            )
    return out


AT_ONCE = 500  # documents whose blocks are Python objects at a time


def _blocks(column: pa.ListArray) -> Iterator[list[dict]]:
    """Each document's blocks; none for null. Fields are read as columns, which is faster than row by row."""
    flat = column.flatten()
    names = [f.name for f in flat.type if f.name != "bbox"]
    all_ = (dict(zip(names, x, strict=True)) for x in zip(*(flat.field(n).to_pylist() for n in names), strict=True))
    for n in column.value_lengths().to_pylist():
        yield list(islice(all_, n or 0))


def chunk(docs: DataFrame, settings: Chunking = Chunking(), make_counter: Callable[[], Counter] | None = None) -> DataFrame:
    """Documents (doc_id, title, content_hash, blocks) to rows of the schema ``CHUNK``. Null blocks give no chunks; a null title is empty."""
    folded = pa.struct(
        [("chunk_index", pa.int32()), ("occurrence", pa.int32()), ("breadcrumb", pa.string()), ("text", pa.string()), ("embed_text", pa.string()), ("token_count", pa.int32()), ("kind", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32())]
        + [("table_part", pa.struct([("part", pa.int32()), ("total", pa.int32())]))]
    )

    def emitted(held: list[tuple[str, str, dict]]) -> pa.RecordBatch:
        cells = [pa.array([x[k] for x in held], pa.string()) for k in (0, 1)]
        fields = [pa.array([x[2][f.name] for x in held], f.type) for f in folded]
        return pa.RecordBatch.from_arrays([*cells, pa.StructArray.from_arrays(fields, fields=list(folded))], names=["doc_id", "content_hash", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held = make_counter() if make_counter else count_words, []
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            for doc_id, title, content_hash, blocks in zip(*(batch.column(k).to_pylist() for k in range(3)), _blocks(batch.column(3)), strict=True):
                for x in fold(title or "", blocks, settings, count):
                    held.append((doc_id, content_hash, x))
                    if len(held) == 1000:
                        yield emitted(held)
                        held = []
        if held:
            yield emitted(held)

    rows = docs.select("doc_id", "title", "content_hash", "blocks")
    made = rows.mapInArrow(run, "doc_id string, content_hash string, c struct<chunk_index:int,occurrence:int,breadcrumb:string,text:string,embed_text:string,token_count:int,kind:string,page_start:int,page_end:int,table_part:struct<part:int,total:int>>")
    flat = made.select("doc_id", "content_hash", "c.*")
    flat = flat.withColumn("chunk_id", C.chunk_id("doc_id", "chunk_index", "content_hash")).withColumn("section_id", C.section_id("doc_id", "occurrence", "breadcrumb"))
    return flat.select(*CHUNK.fieldNames())


def pack_sentences(text: Column | str, target: int) -> Column:
    """Plain text to pieces: sentences greedily up to ``target`` words, as an array of structs (piece, tokens).

    A running count of the piece's words, which begins anew where a piece does, tells where pieces begin; their sentences are then slices. What is used more than once is bound to a
    name first, so that it is computed once.
    """

    def cut(x: Column) -> Column:
        n = F.size(x["s"])
        before = lambda i: F.coalesce(F.get(x["held"], i - 1), F.lit(0))
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (before(i) == 0) | (before(i) + F.get(x["n"], i) > target))
        spans = lambda at: F.zip_with(at["at"], F.concat(F.slice(at["at"], 2, n), F.array(n)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        piece = lambda p: F.struct(F.array_join(F.slice(x["s"], p["a"] + 1, p["b"] - p["a"]), " ").alias("piece"), F.get(x["held"], p["b"] - 1).alias("tokens"))
        return F.transform(C.bound(F.struct(first.alias("at")), spans), piece)

    def counted(x: Column) -> Column:
        held = C.running(x["n"], F.lit(0), lambda s, v: F.when((s == 0) | (s + v > target), v).otherwise(s + v))
        return C.bound(F.struct(x["s"].alias("s"), x["n"].alias("n"), held.alias("held")), cut)

    sized = lambda x: C.bound(F.struct(x["s"].alias("s"), F.transform(x["s"], C.token_count).alias("n")), counted)
    nothing = F.array().cast("array<struct<piece:string,tokens:int>>")
    return C.bound(F.struct(C.sentences(text).alias("s")), lambda x: F.when(F.size(x["s"]) > 0, sized(x)).otherwise(nothing))
