"""Office documents to blocks, read from their zipped XML with the standard library.

Word files give headings, list items, paragraphs and tables; slides and sheets are pages, in the order of the file's index. Of PDF files the text layer is read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from quarry.operators.htmldoc import block, collapsed
from quarry.operators.pdf import read as pdf_text
from quarry.operators.tables import to_html, to_markdown

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class UnsupportedError(ValueError):
    pass


def _table(rows: list[list[str]], header_first: bool, page: int | None = None) -> dict:
    header, rest = (rows[0], rows[1:]) if header_first and rows else (None, rows)
    return block("table", to_markdown(rest, header), table_html=to_html(rest, header)) | {"page": page}


def _word_text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            out.append(" ")
    return "".join(out)


def docx(data: bytes) -> tuple[str | None, list[dict]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId", "")] = (name.get(f"{W}val", "") if name is not None else "").lower()
    out, titled = [], False
    for node in [] if body is None else body:
        if node.tag == f"{W}tbl":
            rows = [[" ".join(t for p in c.iter(f"{W}p") if (t := collapsed(_word_text(p)))) for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")]
            out.append(_table(rows, True))
        elif node.tag == f"{W}p":
            text, style, level = collapsed(_word_text(node)), node.find(f"{W}pPr/{W}pStyle"), node.find(f"{W}pPr/{W}numPr/{W}ilvl")
            name = styles.get(style.get(f"{W}val", ""), style.get(f"{W}val", "").lower()) if style is not None else ""
            if not text:
                continue
            if name == "title":
                out.append(block("heading", text, 1))
                titled = True
            elif found := re.fullmatch(r"heading ?(\d)", name):
                out.append(block("heading", text, max(1, min(6, int(found[1]) + titled))))
            elif level is not None or name.startswith("list"):
                deep = int(level.get(f"{W}val", "0")) + 1 if level is not None else int((re.search(r"\d", name) or ["1"])[0])
                out.append(block("list_item", text, max(1, min(6, deep))))
            elif name == "caption":
                out.append(block("caption", text))
            else:
                out.append(block("paragraph", text))
    return next((b["text"] for b in out if b["type"] == "heading"), None), out


def _in_order(z: zipfile.ZipFile, index: str, tag: str, pattern: str) -> list[tuple[str, str]]:
    """(name, part) of what a file's index lists, in its order, by the ids of its relationships; without them, the parts by number."""
    folder, _, name = index.rpartition("/")
    relations = f"{folder}/_rels/{name}.rels"
    if index in z.namelist() and relations in z.namelist():
        parts = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read(relations))}
        listed = [(x.get("name", ""), parts.get(x.get(f"{R}id"), "")) for x in ET.fromstring(z.read(index)).iter(tag)]
        paths = [(title, target.lstrip("/") if target.startswith("/") else f"{folder}/{target}") for title, target in listed]
        if paths and all(path in z.namelist() for _, path in paths):
            return paths
    found = (re.fullmatch(pattern, n) for n in z.namelist())
    return [("", n) for _, n in sorted((int(m[1]), m[0]) for m in found if m)]


def pptx(data: bytes) -> tuple[str | None, list[dict]]:
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for page, (_, name) in enumerate(_in_order(z, "ppt/presentation.xml", f"{P}sldId", r"ppt/slides/slide(\d+)\.xml"), 1):
            for shape in ET.fromstring(z.read(name)).iter():
                if shape.tag == f"{P}sp":
                    kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                    place = kind.get("type", "body") if kind is not None else ""
                    if place in ("ftr", "sldNum", "dt"):
                        continue
                    for p in shape.iter(f"{A}p"):
                        text = collapsed("".join(t.text or "" for t in p.iter(f"{A}t")))
                        if not text:
                            continue
                        if place in ("title", "ctrTitle"):
                            made = block("heading", text, 1 if place == "ctrTitle" or page == 1 else 2)
                        elif place == "body":
                            props = p.find(f"{A}pPr")
                            made = block("list_item", text, min(6, 1 + int(props.get("lvl", "0") if props is not None else 0)))
                        else:
                            made = block("paragraph", text)
                        out.append(made | {"page": page})
                elif shape.tag == f"{A}tbl":
                    rows = [[collapsed(" ".join(t.text or "" for t in c.iter(f"{A}t"))) for c in r.findall(f"{A}tc")] for r in shape.findall(f"{A}tr")]
                    out.append(_table(rows, True, page))
    return next((b["text"] for b in out if b["type"] == "heading"), None), out


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return max(n, 1)


def xlsx(data: bytes) -> tuple[str | None, list[dict]]:
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        names = [s.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]
        for page, (title, name) in enumerate(_in_order(z, "xl/workbook.xml", f"{S}sheet", r"xl/worksheets/sheet(\d+)\.xml"), 1):
            rows = []
            for r in ET.fromstring(z.read(name)).iter(f"{S}row"):
                cells: dict[int, str] = {}
                for c in r.findall(f"{S}c"):
                    value = c.find(f"{S}v")
                    raw = value.text or "" if value is not None else "".join(t.text or "" for t in c.iter(f"{S}t"))
                    cells[_column(c.get("r", ""))] = shared[int(raw)] if c.get("t") == "s" and raw else raw
                rows.append([cells.get(k, "") for k in range(1, max(cells, default=0) + 1)])
            out.append(block("heading", title or (names[page - 1] if page <= len(names) else f"Sheet {page}"), 1) | {"page": page})
            if any(rows):
                out.append(_table([r for r in rows if r], True, page))
    return next((b["text"] for b in out), None), out


def pdf(data: bytes) -> tuple[str | None, list[dict]]:
    """The text layer's paragraphs with their pages; the first one is the title."""
    out = [block("paragraph", text) | {"page": page} for page, text in pdf_text(data)]
    return next((b["text"] for b in out), None), out
