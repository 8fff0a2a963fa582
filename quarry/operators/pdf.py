"""The text layer of PDF files, on the standard library: objects, pages in order, and what their content streams show.

Lines follow the text's own moves; a wide gap between lines begins a paragraph. Codes become characters by the font's ToUnicode map, else by its encoding read as Latin text. Files
that are encrypted, or that have no text layer, give an error or no blocks; nothing is recognised from images.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+|\(", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """Not a PDF file that can be read."""


class Ref(int):
    """The number of another object."""


class Name(str):
    """A name, without its slash."""


class Word(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that begins at ``at``, and its end. Brackets nest."""
    out, depth, at = bytearray(), 1, at + 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            after = data[at + 1 : at + 2]
            if octal := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                out.append(int(octal[0], 8) & 255)
                at += 1 + len(octal[0])
                continue
            if after not in (b"\n", b"\r"):
                out += _ESCAPES.get(after, after)
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at + 1
        out += c
        at += 1
    return bytes(out), at


def _values(data: bytes) -> Iterator:
    """The values in a stretch of syntax: dicts, lists, numbers, names, strings (bytes), references and words."""
    stack: list[list] = [[]]
    at = 0
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        top = stack[-1]
        if token[:1] == b"%":
            continue
        if token in (b"<<", b"["):
            stack.append([])
            continue
        if token in (b">>", b"]"):
            if len(stack) == 1:
                continue
            items = stack.pop()
            value = items if token == b"]" else dict(zip(items[::2], items[1::2], strict=False))
        elif token[:1] == b"(":
            value, at = _string(data, m.start())
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token[1:]).decode("latin-1"))
        elif token == b"R" and len(top) >= 2 and all(isinstance(x, int) for x in top[-2:]):
            top.pop()
            value = Ref(top.pop())
        else:
            try:
                value = float(token) if b"." in token else int(token)
            except ValueError:
                value = Word(token.decode("latin-1"))
        stack[-1].append(value)
        if len(stack) == 1 and not isinstance(value, (int, float)):
            yield from stack[0]
            stack[0].clear()
    yield from stack[0]


class File:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("not a PDF file")
        self.objects: dict[int, tuple[object, bytes]] = {}
        packed = []
        starts = list(_OBJECT.finditer(data))
        if not starts:
            raise PdfError("the PDF file has no objects")
        for m, after in zip(starts, [*starts[1:], None], strict=True):
            body = data[m.end() : after.start() if after else len(data)]
            head, marker, rest = body.partition(b"stream")
            value = next(iter(_values(head.split(b"endobj")[0])), None)
            stream = b""
            if marker and isinstance(value, dict):
                stream = re.sub(rb"^\r?\n", b"", rest).rpartition(b"endstream")[0]
            self.objects[int(m[1])] = value, stream  # of several versions the last one counts
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                packed.append(int(m[1]))
        self.trailer = {}
        for m in re.finditer(rb"\btrailer\b", data):
            self.trailer |= next((v for v in _values(data[m.end() : m.end() + 4096].split(b"startxref")[0]) if isinstance(v, dict)), {})
        for value, _ in self.objects.values():
            if isinstance(value, dict) and value.get("Type") == "XRef":
                self.trailer |= value
        if "Encrypt" in self.trailer:
            raise PdfError("the file is encrypted")
        for number in packed:
            value, _ = self.objects[number]
            data_, first = self.stream(Ref(number)), int(self.get(value.get("First", 0)))
            table = [int(x) for x in data_[:first].split()]
            ends = [*table[3::2], len(data_) - first]
            for own, start, end in zip(table[::2], table[1::2], ends, strict=False):
                self.objects.setdefault(own, (next(iter(_values(data_[first + start : first + end])), None), b""))

    def get(self, value):
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value), (None, b""))[0]
        return value

    def stream(self, ref) -> bytes:
        value, data = self.objects.get(int(ref), (None, b"")) if isinstance(ref, Ref) else (None, b"")
        if not isinstance(value, dict):
            return b""
        filters = self.get(value.get("Filter")) or []
        for kind in filters if isinstance(filters, list) else [filters]:
            if kind not in ("FlateDecode", "Fl"):
                raise PdfError(f"streams by {kind} can't be read")
            data = zlib.decompressobj().decompress(data)
            parms = self.get(value.get("DecodeParms")) or {}
            if isinstance(parms, dict) and self.get(parms.get("Predictor", 1)) >= 10:
                data = _unpredicted(data, int(self.get(parms.get("Columns", 1))))
        return data

    def pages(self) -> Iterator[dict]:
        """Pages in order, each with what it has of its parents."""
        root = self.get(self.trailer.get("Root")) or next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        todo, seen = [(root.get("Pages"), {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and int(ref) in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            own = above | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                todo += [(kid, own) for kid in reversed(self.get(node["Kids"]) or [])]
            else:
                yield own | node


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Undo the row filters of PNG, for samples of a byte."""
    out, before = bytearray(), bytearray(columns)
    for at in range(0, len(data) - columns, columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            left, up, corner = (row[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            if kind == 4:
                near = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
            else:
                near = {0: 0, 1: left, 2: up, 3: (left + up) // 2}.get(kind, 0)
            row[i] = (row[i] + near) & 255
        out += row
        before = row
    return bytes(out)


class Font:
    """From codes to characters."""

    def __init__(self, file: File, font: dict):
        self.map: dict[int, str] = {}
        self.width = 2 if font.get("Subtype") == "Type0" else 1
        if isinstance(font.get("ToUnicode"), Ref):
            self._read(file.stream(font["ToUnicode"]))

    def _read(self, data: bytes) -> None:
        text = lambda x: x.decode("utf-16-be", "replace")
        number = lambda x: int.from_bytes(x, "big")
        for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end(?:bfchar|bfrange)", data, re.DOTALL):
            values = list(_values(body))
            if kind == b"bfchar":
                for code, to in zip(values[::2], values[1::2], strict=False):
                    self.map[number(code)] = text(to)
                continue
            for low, high, to in zip(values[::3], values[1::3], values[2::3], strict=False):
                for k in range(number(low), min(number(high), number(low) + 65535) + 1):
                    if isinstance(to, list):
                        if k - number(low) < len(to):
                            self.map[k] = text(to[k - number(low)])
                    else:
                        self.map[k] = text(to[:-2]) + chr(number(to[-2:]) + k - number(low))

    def text(self, codes: bytes) -> str:
        if not self.map and self.width == 1:
            return codes.decode("cp1252", "replace")
        return "".join(self.map.get(int.from_bytes(codes[k : k + self.width], "big"), "" if self.width == 2 else chr(codes[k])) for k in range(0, len(codes), self.width))


def page_lines(file: File, page: dict) -> list[tuple[float, float, str]]:
    """(height on the page, size, text) of the lines that a page shows, in the order of its content."""
    contents = file.get(page.get("Contents"))
    refs = contents if isinstance(contents, list) else [page.get("Contents")]
    data = b"\n".join(file.stream(r) for r in refs if isinstance(r, Ref))
    resources = file.get(page.get("Resources")) or {}
    fonts = {name: Font(file, file.get(ref) or {}) for name, ref in (file.get(resources.get("Font")) or {}).items()}
    plain = Font(file, {})
    lines: list[tuple[float, float, str]] = []
    font, size, leading, scale = plain, 1.0, 0.0, 1.0
    y = line_y = 0.0
    run: list[str] = []
    args: list = []

    def close() -> None:
        if text := " ".join("".join(run).split()):
            lines.append((line_y, abs(size * scale), text))
        run.clear()

    def move(to: float, space: bool) -> None:
        nonlocal y, line_y
        if abs(to - line_y) > 0.1:
            close()
        elif space:
            run.append(" ")
        y = line_y = to

    for value in _values(data):
        if not isinstance(value, Word):
            args.append(value)
            continue
        numbers = [x for x in args if isinstance(x, (int, float))]
        if value == "BT":
            scale = 1.0
            move(0.0, True)
        elif value == "Tf" and args:
            font, size = fonts.get(args[0], plain), float(numbers[-1]) if numbers else size
        elif value == "TL" and numbers:
            leading = float(numbers[-1])
        elif value in ("Td", "TD") and len(numbers) >= 2:
            leading = -float(numbers[1]) if value == "TD" else leading
            move(y + float(numbers[1]) * scale, True)
        elif value == "Tm" and len(numbers) >= 6:
            scale = abs(float(numbers[3])) or 1.0
            move(float(numbers[5]), True)
        elif value in ("T*", "'", '"'):
            move(y - leading * scale, True)
        if value in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            run.append(font.text(args[-1]))
        elif value == "TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    run.append(font.text(x))
                elif isinstance(x, (int, float)) and x < -200:
                    run.append(" ")
        args = []
    close()
    return lines


def paragraphs(lines: list[tuple[float, float, str]]) -> Iterator[str]:
    """Lines joined where the next one follows at most one and a half sizes below in the same size."""
    held: list[str] = []
    last = (0.0, 0.0)
    for y, size, text in lines:
        near = held and abs(size - last[1]) < 0.5 and 0 < last[0] - y <= 1.5 * max(size, 1.0)
        if held and not near:
            yield " ".join(held)
            held = []
        held.append(text)
        last = y, size
    if held:
        yield " ".join(held)


def read(data: bytes) -> list[tuple[int, str]]:
    """(page, paragraph), pages from 1."""
    file = File(data)
    return [(number, text) for number, page in enumerate(file.pages(), 1) for text in paragraphs(page_lines(file, page))]
