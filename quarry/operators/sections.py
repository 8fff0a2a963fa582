"""Sections of a document as an expression: which headings stand above each run of blocks, and its breadcrumb.

A heading is under the last ones of lower levels, so what counts at a block is, for each level, the last heading that no heading of the same or a lower level followed. One running array keeps
the places of those; nothing leaves the row, so no shuffle is needed, and a breadcrumb is read off by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import columns as C

CRUMBS = " > "
LEVELS = 9  # deeper headings count as this one


def sections(title: Column | str, blocks: Column | str) -> Column:
    """An array of structs (breadcrumb, occurrence, start, length): each run of blocks between headings, by its place in ``blocks`` (from 0). Occurrences of a breadcrumb in the document are numbered from 1.

    ``blocks`` are structs with ``type``, ``level`` and ``text``. Null blocks have no sections, a null title is empty, a heading without a level has level 1; a first heading that repeats the title isn't repeated.
    """
    title, blocks = F.trim(F.coalesce(C._c(title), F.lit(""))), F.coalesce(C._c(blocks), F.array().cast("array<struct<type:string,level:int,text:string>>")) if isinstance(blocks, Column) else F.coalesce(F.col(blocks), F.array())

    def chained(x: Column) -> Column:
        """Places of the headings that stand at each block, by level; -1 where there is none."""
        level = lambda b: F.when(b["type"] == "heading", F.least(F.greatest(F.coalesce(F.nullif(b["level"], F.lit(0)), F.lit(1)), F.lit(1)), F.lit(LEVELS)))
        marks = F.transform(x["b"], lambda b, i: F.struct(i.alias("i"), level(b).alias("level")))
        none = F.array_repeat(F.lit(-1), LEVELS)
        step = lambda s, m: F.when(m["level"].isNull(), s).otherwise(F.transform(s, lambda p, k: F.when(k + 1 < m["level"], p).when(k + 1 == m["level"], m["i"]).otherwise(-1)))
        return C.bound(F.struct(x["b"].alias("b"), marks.alias("m"), C.running(marks, none, step).alias("above")), runs)

    def runs(x: Column) -> Column:
        """Sections without the number of their occurrence."""
        n, is_body = F.size(x["m"]), lambda i: F.get(x["m"], i)["level"].isNull()
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: is_body(i) & ((i == 0) | ~F.coalesce(is_body(i - 1), F.lit(True))))
        # a section ends where the next heading is: those are the blocks before the starts that come after it, or the end
        heads = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) & is_body(i - 1) | (i < n) & ~is_body(i) & is_body(i - 1))
        spans = lambda at: F.zip_with(at["starts"], at["ends"], lambda a, b: F.struct(a.alias("start"), (b - a).alias("length"), crumb(a).alias("breadcrumb")))

        def crumb(at: Column) -> Column:
            names = F.transform(F.filter(F.get(x["above"], at), lambda p: p >= 0), lambda p: F.coalesce(F.get(x["b"], p)["text"], F.lit("")))
            own = C.bound(names, lambda n: F.when(F.get(n, F.lit(0)) == title, F.slice(n, F.lit(2), F.greatest(F.size(n), F.lit(1)))).otherwise(n))
            return F.array_join(F.concat(F.array(title), own), CRUMBS)

        return C.bound(C.bound(F.struct(starts.alias("starts"), heads.alias("ends")), spans), numbered)

    def numbered(found: Column) -> Column:
        order = F.array_sort(F.transform(found, lambda s: F.struct(s["breadcrumb"].alias("breadcrumb"), s["start"].alias("start"), s["length"].alias("length"))))
        counts = C.running(order, F.struct(F.lit(None).cast("string").alias("b"), F.lit(0).alias("k")), lambda s, x: F.struct(x["breadcrumb"].alias("b"), F.when(s["b"] == x["breadcrumb"], s["k"] + 1).otherwise(1).alias("k")))
        again = F.zip_with(order, counts, lambda x, c: F.struct(x["start"].alias("start"), x["breadcrumb"].alias("breadcrumb"), c["k"].alias("occurrence"), x["length"].alias("length")))
        return F.transform(F.array_sort(again), lambda x: F.struct(x["breadcrumb"], x["occurrence"], x["start"], x["length"]))

    nothing = F.array().cast("array<struct<breadcrumb:string,occurrence:int,start:int,length:int>>")
    return C.bound(F.struct(blocks.alias("b")), lambda x: F.when(F.size(x["b"]) > 0, chained(x)).otherwise(nothing))


def section_rows(docs: DataFrame) -> DataFrame:
    """A row for each section of documents (doc_id, title, blocks): doc_id, section (from 1), section_id, breadcrumb, occurrence, and its ``blocks``."""
    found = docs.select("doc_id", "blocks", F.posexplode(sections("title", "blocks")).alias("section", "s"))
    own = F.slice("blocks", F.col("s.start") + 1, F.col("s.length"))
    return found.select("doc_id", (F.col("section") + 1).alias("section"), C.section_id("doc_id", "s.occurrence", "s.breadcrumb").alias("section_id"), "s.breadcrumb", "s.occurrence", own.alias("blocks"))
