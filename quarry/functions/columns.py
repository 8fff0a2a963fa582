"""Column functions: ids, hashes, text, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of all ids.
NAMESPACE = "6f7a0d5c-2b0e-4b6f-9a1f-3a2c8e5d1b47"
SPACE = r"(?U)\s+"  # Unicode white space
SNIPPET = 240


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uuid5(name: Column | str) -> Column:
    """Name-based UUID (version 5) in the engine's namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.replace("-", ""))), _c(name).cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.instr(F.lit("0123456789abcdef"), F.substring(digest, 17, 1)) - 1) % 4 + 1, F.lit(1))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def doc_id(source: Column | str, uri: Column | str) -> Column:
    return uuid5(F.concat(_c(source), F.lit(":"), _c(uri)))


def chunk_id(doc: Column | str, index: Column | str, content: Column | str) -> Column:
    return uuid5(F.concat_ws(":", _c(doc), _c(index).cast("string"), _c(content)))


def section_id(doc: Column | str, occurrence: Column | str, breadcrumb: Column | str) -> Column:
    return uuid5(F.concat_ws(":", _c(doc), F.lit("section"), _c(occurrence).cast("string"), _c(breadcrumb)))


def content_hash(data: Column | str) -> Column:
    return F.sha2(_c(data).cast("binary"), 256)


def cache_key(text: Column | str, model: Column, dims: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(_c(text), nul, model, nul, dims.cast("string")).cast("binary"), 256)


def norm(text: Column | str) -> Column:
    """White space collapsed and trimmed, lower case; null is empty. For matching spans and questions."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), SPACE, " ")))


def normalize_text(text: Column | str) -> Column:
    """No-break spaces are spaces; blanks in a line are one and its ends trimmed; no two empty lines in a row."""
    plain = F.regexp_replace(F.regexp_replace(_c(text), r"\x{a0}", " "), r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", "\n")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def token_count(text: Column | str) -> Column:
    """The default counter: words between white space."""
    return F.size(F.array_remove(F.split(_c(text), SPACE), ""))


def sentences(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), r"(?U)(?<=[.!?])\s+(?=\S)"), lambda x: F.trim(x) != "")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, accumulated in doubles; 0 for a vector without length."""
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), add)
    square = lambda v: F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    length = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(length > 0, dot / length).otherwise(F.lit(0.0))


def unit(v: Column | str) -> Column:
    """The vector scaled to length 1, in doubles."""
    measured = lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("length"))
    scaled = lambda m: F.transform(m["v"], lambda x: F.when(m["length"] > 0, x / m["length"]).otherwise(F.lit(0.0)))
    return bound(_c(v), lambda v: bound(measured(v), scaled))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def file_name(uri: Column | str) -> Column:
    return F.element_at(F.split(_c(uri), "/"), -1)


def suffix(uri: Column | str) -> Column:
    """The extension in lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(uri), r"^.+[.]([^.]+)$", 1))


def stem(uri: Column | str) -> Column:
    return F.regexp_replace(file_name(uri), r"^(.+)[.][^.]*$", "$1")


def snippet(text: Column | str) -> Column:
    t = _c(text)
    cut = F.when(F.char_length(t) > SNIPPET, F.concat(F.substring(t, 1, SNIPPET - 1), F.lit("…"))).otherwise(t)
    return F.translate(cut, "\n", " ")


def xml_escape(text: Column | str) -> Column:
    out = _c(text)
    for plain, entity in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def quoted_attribute(text: Column | str) -> Column:
    """An XML attribute's value with its quotes: double ones, single ones around text with double ones, entities if it has both."""
    out = xml_escape(text)
    for plain, entity in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    double, single = F.lit('"'), F.lit("'")
    return (
        F.when(~out.contains('"'), F.concat(double, out, double)).when(~out.contains("'"), F.concat(single, out, single)).otherwise(F.concat(double, F.replace(out, double, F.lit("&quot;")), double))
    )


def html_escape(text: Column | str) -> Column:
    return F.replace(F.replace(xml_escape(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def citation_numbers(answer: Column | str) -> Column:
    """The numbers of ``[n]`` markers of one to three digits, in order, with repeats."""
    return F.transform(F.regexp_extract_all(_c(answer), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))


def bound(value: Column, use) -> Column:
    """``use`` of a value that it names several times, or in a lambda, computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, first: Column, step) -> Column:
    """The running results of ``step`` over an array, from ``first`` on. Results are gathered in blocks, so that a long array isn't copied for each element."""
    none = F.array_remove(F.array(first), first)
    start = F.struct(first.alias("last"), none.alias("block"), F.array_remove(F.array(none), none).alias("blocks"))

    def add(s: Column, x: Column) -> Column:
        full, now = F.size(s["block"]) >= 256, F.array(step(s["last"], x))
        return F.struct(
            step(s["last"], x).alias("last"),
            F.when(full, now).otherwise(F.concat(s["block"], now)).alias("block"),
            F.when(full, F.concat(s["blocks"], F.array(s["block"]))).otherwise(s["blocks"]).alias("blocks"),
        )

    return F.aggregate(values, start, add, lambda s: F.flatten(F.concat(s["blocks"], F.array(s["block"]))))


def run_hashes(words: Column, size: int) -> Column:
    """A hash of each run of ``size`` (a power of two) words: those of runs of 2n are made from those of n."""
    joined = lambda by: lambda g: F.zip_with(g, F.slice(g, by + 1, F.greatest(F.size(g), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    runs, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < size:
        runs, width = bound(runs, joined(width)), 2 * width
    return bound(runs, lambda g: F.slice(g, F.lit(1), F.greatest(F.size(g) - (size - 1), F.lit(0))))
