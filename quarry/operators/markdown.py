"""Markdown documents to blocks: a line-based block scanner and an inline flattener, for the constructs of GitHub's dialect."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from quarry.operators.htmldoc import block, plain
from quarry.operators.tables import to_html, to_markdown

_FRONT = re.compile(r"\A---[ \t]*\n(.*?)\n---[ \t]*\n", re.DOTALL)
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)(.*)$")
_QUOTE = re.compile(r" {0,3}> ?")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:!--|[?!]|(?:/?(?:address|article|aside|base|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s/>]|$)))", re.IGNORECASE)
_INLINE = re.compile(
    r"""(?P<escape>\\[!-/:-@\[-`{-~])|(?P<code>(?P<ticks>`+)(?P<span>.+?)(?<!`)(?P=ticks)(?!`))|(?P<auto><(?:https?://|mailto:)[^\s<>]*>)|(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)
    |(?P<image>!\[[^\]]*\](?:\([^()\s]*(?:[ ]+"[^"]*")?\)|\[[^\]]*\]))|(?P<link>\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\((?:[^()\s]|\([^()]*\))*(?:[ ]+["'(][^"')]*["')])?\))""",
    re.VERBOSE | re.DOTALL,
)


def front_matter(text: str) -> tuple[dict, str]:
    """The mapping between two ``---`` lines at the top, and the text after it. Without both lines or with bad YAML, the text is as it was."""
    found = _FRONT.match(text)
    if not found:
        return {}, text
    import yaml

    try:
        data = yaml.safe_load(found[1])
    except yaml.YAMLError:
        return {}, text
    return (data if isinstance(data, dict) else {}), text[found.end() :]


def inline(text: str) -> str:
    """What a reader sees: text of code, links and emphasis; images and inline HTML go, line breaks are spaces."""
    kept: list[str] = []  # finished parts, put back once emphasis is gone

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    def replace(m: re.Match) -> str:
        if m["escape"]:
            return keep(m[0][1])
        if m["code"]:
            span = m["span"].replace("\n", " ")
            return keep(span[1:-1] if len(span) > 2 and span[0] == span[-1] == " " and span.strip() else span)
        if m["auto"]:
            return keep(m[0][1:-1])
        if m["link"]:
            return keep(inline(m["label"]))
        return keep("")

    text = "\n".join(line.strip() for line in text.split("\n"))
    text = _INLINE.sub(replace, text.replace("\x00", "�"))
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", text, flags=re.DOTALL)
    for mark in ("___", "__", "_"):
        text = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", text, flags=re.DOTALL)
    text = re.sub(r"(?:\\|  +)?\n", " ", html.unescape(text))
    while "\x00" in text:
        text = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)
    return text


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [inline(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line)]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _interrupts(line: str) -> bool:
    """Whether a line ends a paragraph."""
    item = _ITEM.match(line)
    return bool(not line.strip() or _HEADING.match(line) or _RULE.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _HTML.match(line) or item and item[4] and (not item[2][0].isdigit() or int(item[2][:-1]) == 1))


def _blocks(lines: list[str], depth: int) -> Iterator[dict]:
    """Blocks of lines in a list ``depth`` deep."""
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            j = i
            while j < n and (_indent(lines[j]) >= 4 or not lines[j].strip()):
                j += 1
            code = "\n".join(x[4:] for x in lines[i:j]).rstrip("\n")
            yield block("code", code + "\n")
            i = j
        elif found := _HEADING.match(line):
            yield block("heading", inline(found[2] or ""), len(found[1]))
            i += 1
        elif _RULE.match(line):
            i += 1
        elif found := _FENCE.match(line):
            close = re.compile(rf" {{0,3}}{re.escape(found[2][0])}{{{len(found[2])},}}[ \t]*$")
            j = next((j for j in range(i + 1, n) if close.match(lines[j])), n)
            body = [x[min(_indent(x), len(found[1])) :] for x in lines[i + 1 : j]]
            info = found[3].split()
            yield block("code", "".join(f"{x}\n" for x in body), language=info[0] if info else None)
            i = j + 1
        elif _QUOTE.match(line):
            j, inner = i, []
            while j < n and lines[j].strip() and (_QUOTE.match(lines[j]) or not _interrupts(lines[j])):
                inner.append(_QUOTE.sub("", lines[j], count=1) if _QUOTE.match(lines[j]) else lines[j])
                j += 1
            yield from _blocks(inner, depth)
            i = j
        elif found := _ITEM.match(line):
            i, items = _list(lines, i)
            for item in items:
                yield from _blocks(item, depth + 1)
        elif _HTML.match(line):
            j = i
            while j < n and lines[j].strip():
                j += 1
            if text := plain("\n".join(lines[i:j])):
                yield block("paragraph", text)
            i = j
        elif i + 1 < n and "|" in line and _DELIMITERS.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            header, j = _cells(line), i + 2
            while j < n and lines[j].strip() and not (_interrupts(lines[j]) and "|" not in lines[j]):
                j += 1
            rows = [(_cells(x) + [""] * len(header))[: len(header)] for x in lines[i + 2 : j]]
            yield block("table", to_markdown(rows, header), table_html=to_html(rows, header))
            i = j
        else:
            j = i + 1
            while j < n and not _interrupts(lines[j]) and not _UNDERLINE.match(lines[j]):
                j += 1
            text = inline("\n".join(lines[i:j]))
            if j < n and (found := _UNDERLINE.match(lines[j])):
                yield block("heading", text, 1 if found[1][0] == "=" else 2)
                j += 1
            elif depth:
                yield block("list_item", text, min(depth, 6))
            else:
                yield block("paragraph", text)
            i = j


def _list(lines: list[str], i: int) -> tuple[int, list[list[str]]]:
    """Items of the list that begins at line i, each as its own lines, and the line after the list."""
    items: list[list[str]] = []
    first = _ITEM.match(lines[i])
    kind = first[2][-1]
    while i < len(lines):
        found = _ITEM.match(lines[i])
        if not found or _RULE.match(lines[i]) or found[2][-1] != kind:
            break
        pad = len(found[3]) if 0 < len(found[3]) <= 4 and found[4] else 1
        width = len(found[1]) + len(found[2]) + pad
        own = [(" " * (len(found[3]) - pad) if found[4] else "") + found[4]]
        i += 1
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                after = next((x for x in lines[i:] if x.strip()), None)
                if after is None or _indent(after) < width and not ((m := _ITEM.match(after)) and m[2][-1] == kind):
                    return i, [*items, own]
                own.append("")
            elif _indent(line) >= width:
                own.append(line[width:])
            elif own[-1].strip() and not _interrupts(line) and not _ITEM.match(line):  # a paragraph goes on
                own.append(line.strip())
            else:
                break
            i += 1
        items.append(own)
    return i, items


def blocks(text: str) -> list[dict]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    return list(_blocks(lines, 0))


def parse(text: str) -> tuple[str | None, list[dict], dict]:
    """(title, blocks, front matter). The title is the front matter's, else the first heading."""
    front, body = front_matter(text.replace("\r\n", "\n"))
    found = blocks(body)
    title = str(front["title"]) if front.get("title") else next((b["text"] for b in found if b["type"] == "heading"), None)
    return title, found, front
