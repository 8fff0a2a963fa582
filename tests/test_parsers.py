import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import htmldoc, markdown, office, parse, tables
from quarry.sources.files import table_as_files

MARKDOWN = """---
title: The Guide
---
# Intro #

Some *soft* text with a [link](http://x.y/z "t") and `a * b`
on two lines ![pic](x.png).

- one
- two
  goes on
  1. deep

     second paragraph
- three

Setext
------

| a | b |
|:--|--:|
| 1 | `x\\|y` |
| 2 |

~~~sh -x
run | it

done
~~~

    indented

> quoted
> text

<div>raw <b>html</b></div>

***
last \\*line\\* &amp; snake_case_name
"""


def kinds(blocks):
    return [(b["type"], b["level"], b["text"]) for b in blocks]


def test_markdown_blocks():
    title, blocks, front = markdown.parse(MARKDOWN)
    assert title == "The Guide" and front == {"title": "The Guide"}
    assert kinds(blocks) == [
        ("heading", 1, "Intro"),
        ("paragraph", None, "Some soft text with a link and a * b on two lines ."),
        ("list_item", 1, "one"),
        ("list_item", 1, "two goes on"),
        ("list_item", 2, "deep"),
        ("list_item", 2, "second paragraph"),
        ("list_item", 1, "three"),
        ("heading", 2, "Setext"),
        ("table", None, "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n| 2 |  |"),
        ("code", None, "run | it\n\ndone\n"),
        ("code", None, "indented\n"),
        ("paragraph", None, "quoted text"),
        ("paragraph", None, "raw html"),
        ("paragraph", None, "last *line* & snake_case_name"),
    ]
    assert [b["language"] for b in blocks if b["type"] == "code"] == ["sh", None]


@pytest.mark.parametrize("text", ["---\nno end\n", "---\na: [\n---\nx\n", "text\n---\na: 1\n---\n"])
def test_front_matter_that_is_none(text):
    assert markdown.front_matter(text) == ({}, text)


def test_markdown_of_nothing_and_deep_lists():
    assert markdown.blocks("") == [] and markdown.blocks("\n\n***\n") == []
    deep = "\n".join("  " * k + f"- item{k}" for k in range(8))
    assert [b["level"] for b in markdown.blocks(deep)] == [1, 2, 3, 4, 5, 6, 6, 6]


HTML = """<html><head><title> The  page </title><style>x</style></head><body><nav>menu</nav><!-- note -->
<h1>Top<br>line</h1><p>Hello <em>you</em>!<p>Second
<div>loose <b>text</b><span>apart</span></div>
<ul><li>one<ul><li>two</li></ul></li><li><p>three</p></li><li>code<pre>x
 y</pre></li></ul>
<table><tr><th>k</th><th>v</th></tr><tr><td>a<table><tr><td>in</td></tr></table></td><td>b &amp; c</td></tr></table>
<table><tr><td>no</td></tr></table>
<pre><code class="hl language-py">a  b
</code></pre><figure><figcaption>Fig</figcaption></figure><footer>end</footer></body></html>"""


def test_html_blocks():
    title, blocks = htmldoc.parse(HTML)
    assert title == "The  page"
    assert kinds(blocks) == [
        ("heading", 1, "Top line"),
        ("paragraph", None, "Hello you!"),
        ("paragraph", None, "Second"),
        ("paragraph", None, "loose text"),
        ("paragraph", None, "apart"),
        ("list_item", 1, "one"),
        ("list_item", 2, "two"),
        ("list_item", 1, "three"),
        ("list_item", 1, "code"),
        ("code", None, "x\n y"),
        ("table", None, "| k | v |\n| --- | --- |\n| ain | b & c |"),
        ("table", None, "|  |\n| --- |\n| no |"),
        ("code", None, "a  b\n"),
        ("caption", None, "Fig"),
    ]
    assert [b["language"] for b in blocks if b["type"] == "code"] == [None, "py"]
    assert htmldoc.parse("")[1] == [] and htmldoc.parse("just text")[1][0]["text"] == "just text"


def test_tables_round_trip(spark):
    rows, header = [["a|b", "line\nbreak"], ["<x>", ""]], ["h1", "h2"]
    assert tables.from_html(tables.to_html(rows, header)) == ([["a|b", "line break"], ["<x>", ""]], header)
    assert tables.to_markdown([["1"]], None) == "|  |\n| --- |\n| 1 |" and tables.to_markdown([], None) == ""
    df = spark.createDataFrame([(rows, header)], "rows array<array<string>>, header array<string>")
    found = df.select(tables.markdown_table(F.col("rows"), F.col("header")), tables.html_table(F.col("rows"), F.col("header"))).first()
    assert found[0] == tables.to_markdown(rows, header) and found[1] == tables.to_html(rows, header)


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_office_documents():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    par = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{par(t)}</w:tc>"
    body = par("Policy", "Title") + par("Scope", "Heading1") + par("All staff.") + par("item", "ListBullet2") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    title, blocks = office.docx(_zip(word__document=f"<w:document {w}><w:body>{body}</w:body></w:document>"))
    assert title == "Policy" and [(b["type"], b["level"]) for b in blocks] == [("heading", 1), ("heading", 2), ("paragraph", None), ("list_item", 2), ("table", None)]
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slides = {f"ppt__slides__slide{k}": f"<p:sld {ns}>{shape('title', f'S{k}')}{shape('body', 'point')}{shape('sldNum', '1')}</p:sld>" for k in (1, 2, 10)}
    title, blocks = office.pptx(_zip(**slides))
    assert title == "S1" and [(b["text"], b["page"]) for b in blocks] == [("S1", 1), ("point", 1), ("S2", 2), ("point", 2), ("S10", 3), ("point", 3)]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'
    title, blocks = office.xlsx(_zip(xl__workbook=f'<workbook {s}><sheets><sheet name="Data"/></sheets></workbook>', xl__sharedStrings=f"<sst {s}><si><t>key</t></si></sst>", xl__worksheets__sheet1=sheet))
    assert title == "Data" and blocks[1]["text"].startswith("| key |  | 5 |")


def test_errors_are_values():
    assert "PDF" in parse.parse_bytes("pdf", b"x")["error"]
    assert parse.parse_bytes("docx", b"not a zip")["error"].startswith("BadZipFile")
    assert "no parser" in parse.parse_bytes("zip", b"")["error"]


def test_parsed_files_are_normalised(spark):
    files = table_as_files(spark.createDataFrame([("a", "# T\n\nx   y\n"), ("b", "no heading")], "n string, t string"), source="s", uri="n", content="t", extension="md")
    rows = {r["uri"]: r for r in parse.parsed(files).collect()}
    assert rows["a.md"]["title"] == "T" and rows["b.md"]["title"] == "b"
    assert [b["text"] for b in rows["a.md"]["blocks"]] == ["T", "x y"]
    df = spark.createDataFrame([("  t ", [("paragraph", "  ", None, None, None, None, None), ("code", "\n  x\n", None, None, None, None, None), ("table", "", None, None, None, "<table></table>", None)])], f"title string, blocks {parse.BLOCK_ARRAY}")
    found = parse.normalised(df).first()
    assert found["title"] == "t" and [b["text"] for b in found["blocks"]] == ["  x", ""]


def pdf_file(streams, *, packed=False, fonts=b"<< /F1 5 0 R >>"):
    """A file of pages with these content streams; page objects may be packed in an object stream."""
    import zlib

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"}
    cmap = b"1 beginbfchar <0041> <00E9> endbfchar 1 beginbfrange <0061> <007A> <0061> endbfrange"
    pages = {10 + k: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (30 + k) for k in range(len(streams))}
    objects[2] = b"<< /Type /Pages /Kids [%s] /Resources << /Font %s >> >>" % (b" ".join(b"%d 0 R" % k for k in pages), fonts)
    out = b"%PDF-1.7\n"
    if packed:
        table, body = b"", b""
        for k, v in pages.items():
            table += b"%d %d " % (k, len(body))
            body += v + b" "
        data = zlib.compress(table + body)
        out += b"9 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(pages), len(table), len(data), data)
    else:
        objects |= pages
    for k, text in {6: cmap, **{30 + k: x for k, x in enumerate(streams)}}.items():
        data = zlib.compress(text)
        out += b"%d 0 obj << /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (k, len(data), data)
    for k, v in objects.items():
        out += b"%d 0 obj %s endobj\n" % (k, v)
    return out + b"trailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF"


def test_pdf_text():
    plain = b"BT /F2 12 Tf 72 700 Td (A title) Tj ET BT /F2 10 Tf 72 650 Td (First \\(one\\) line) Tj 0 -12 Td [(sec) -20 (ond) -300 (line)] TJ 0 -40 Td (Next \\351) Tj ET"
    mapped = b"BT /F1 10 Tf 1 0 0 1 72 700 Tm <00410061> Tj T* ET"
    for packed in (False, True):
        found = parse.parse_bytes("pdf", pdf_file([plain, mapped, b""], packed=packed))
        assert found["error"] is None and found["title"] == "A title"
        assert [(b["page"], b["text"]) for b in found["blocks"]] == [(1, "A title"), (1, "First (one) line second line"), (1, "Next é"), (2, "éa")]
    assert "encrypted" in parse.parse_bytes("pdf", pdf_file([plain]).replace(b"/Root", b"/Encrypt 1 0 R /Root"))["error"]
    for broken in (b"", b"%PDF-1.4", pdf_file([plain])[:400], b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj"):
        assert parse.parse_bytes("pdf", broken)["blocks"] in (None, [])


def test_sheets_are_named_by_their_relationships():
    import io
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Second file" r:id="r2"/><sheet name="First file" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for k in (1, 2):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1"><v>{k}</v></c></row></sheetData></worksheet>')
    blocks = parse.parse_bytes("xlsx", data.getvalue())["blocks"]
    assert [(b["type"], b["text"].splitlines()[0], b["page"]) for b in blocks] == [("heading", "Second file", 1), ("table", "| 2 |", 1), ("heading", "First file", 2), ("table", "| 1 |", 2)]


def test_blocks_are_normalised_once_and_parsed_in_parts(spark, monkeypatch):
    from quarry import queries
    from quarry.operators import parse
    from tests.conftest import SMALL

    for name in ("html_lists", "markdown_blocks", "html_blocks"):
        assert queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("(size(filter(") == 0, name
    tasks = queries._parts(spark, SMALL, F.col("p_name"), "md").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.createDataFrame([("s", f"{k}.md", f"# t{k}" if k % 3 else "", "h", None, 1) for k in range(250)], "source string, uri string, content string, content_hash string, last_modified timestamp, size_bytes long").coalesce(1)
    found = parse.parsed(files.withColumn("content", F.col("content").cast("binary")))
    assert {r["uri"]: [b["text"] for b in r["blocks"]] for r in found.collect()} == {f"{k}.md": [f"t{k}"] if k % 3 else [] for k in range(250)}
    assert parse.exploded(found).count() == 166
