"""Chat formatting: conversations through a compiled template, with the spans that a model is trained on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.template import Template

#: What marks turns. ``escape`` sees to it that none of these occurs in an escaped text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = """\
{%- for message in messages -%}
<s>[INST] {{ message.role|escape }} [/INST]
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text|escape }}{% endgeneration %}
{%- else -%}
{{ message.text|escape }}
{%- endif -%}
</s>
{%- endfor -%}
"""
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
PIECE = 1 << 18  # characters from which a conversation's output goes on in another row


def escape(value: str | None) -> str:
    """Double each backslash, then put one behind the first character of each control string. ``unescape`` reverses it."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], (value or "").replace("\\", "\\\\"))


def unescape(value: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", value)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(id, messages) of sorted rows; the messages are read as they are asked for."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)

    def messages(own: object) -> Iterator[dict]:
        nonlocal row
        while row is not None and row[0] == own:
            yield {"role": row[2] or "", "text": row[3] or ""}
            row = next(rows, None)

    while row is not None:
        turns = messages(own := row[0])
        yield own, turns
        for _ in turns:  # what a template leaves unread
            pass


def format_conversations(turns: DataFrame, *, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, part, at, formatted, spans): the formatted conversation and where a model is trained.

    A conversation of up to ``PIECE`` characters is one row; a longer one goes on in further parts, in order, cut between pieces of the
    template, so that no row or task holds a whole conversation. ``at`` is where the part begins and ``spans`` are [start, end) pairs
    in the whole conversation, all in code points. A span never crosses parts.

    Rows are taken by turn, then role and text (nulls first), so ties have one order and repeated rows count as often as they occur. A null
    role or text is empty; rows with a null conversation id form a conversation. An empty table gives an empty result. Other
    columns aren't read. The rows of a conversation meet in one task, which streams through them.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, id_type = Template(template, {"escape": escape}), None
        held: list[tuple] = []

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        def batch() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            types = [id_type, pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "part", "at", "formatted", "spans"])

        for conv, messages in _conversations(typed(batches)):
            part, begin, at, out, spans, size = 0, 0, 0, [], [], 0
            for text, generated in compiled.render({"messages": messages}):
                out.append(text)
                if generated and text:
                    spans += [at, at + len(text)]
                at += len(text)
                if at - begin >= PIECE:
                    held.append((conv, part, begin, "".join(out), spans))
                    yield batch()
                    part, begin, out, spans = part + 1, at, [], []
            if out or not part:
                held.append((conv, part, begin, "".join(out), spans))
            size = sum(len(h[3]) for h in held[-64:])
            if len(held) >= 1000 or size >= PIECE:
                yield batch()
        if held:
            yield batch()

    return rows.mapInArrow(run, f"conv_id {kind}, part int, at long, formatted string, spans array<bigint>")


def read_back(formatted: DataFrame, *, sort: bool = True) -> DataFrame:
    """Parse formatted conversations again: per conversation the turns, what a model is trained on, and the length.

    Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars); the first hash is over role, newline, text, newline of each
    turn, the second over all text within the spans, unescaped. ``sort=False`` takes the rows as ``format_conversations`` returns them. Null and empty texts are empty; an empty table
    gives an empty one; very long conversations stream; other columns aren't read.
    """
    rows = formatted.select("conv_id", "part", "at", "formatted", "spans")
    if sort:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _read(batches):
            yield batch

    return rows.mapInArrow(run, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    open_: dict | None = None
    id_type = None

    def batch() -> pa.RecordBatch:
        cols, types = list(zip(*done, strict=True)), [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def close() -> None:
        if open_["rest"]:
            raise ValueError(f"conversation {open_['id']!r} ends within a turn")
        done.append((open_["id"], open_["n"], open_["turns"].hexdigest(), open_["chars"], open_["loss"].hexdigest(), open_["size"]))

    for rows in batches:
        id_type = rows.schema.field(0).type
        for conv, part, at, text, spans in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if part == 0:
                if open_ is not None:
                    close()
                open_ = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "rest": ""}
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                plain = unescape(text[a - at : b - at])
                open_["chars"] += len(plain)
                open_["loss"].update(plain.encode("utf-8", "surrogatepass"))
            open_["size"] += len(text)
            whole, end = open_["rest"] + text, 0
            for turn in _TURN.finditer(whole):
                if turn.start() != end:
                    raise ValueError(f"conversation {open_['id']!r} has text between turns")
                end = turn.end()
                open_["n"] += 1
                open_["turns"].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode("utf-8", "surrogatepass"))
            open_["rest"] = whole[end:]
        if len(done) >= 1000:
            yield batch()
    if open_ is not None:
        close()
    if done:
        yield batch()
