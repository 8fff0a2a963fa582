"""How sources of a language diverge in the terms they use: the terms that mark a source, and a distance for each pair of sources.

Terms are counted by source while texts are read, and an inverted index holds for each kept term its postings, the sources that use it. A source's most marking terms come from a search by upper bounds:
its terms are in buckets of similar counts, a bucket's largest count and its terms' smallest probability in the language bound what any of them can reach, and
buckets are evaluated best first until no unseen bound reaches the k-th value. Distances of pairs are sums over all kept terms; only postings that two sources
share are met, the rest follows from sums over one source's terms.

Scale: texts are read once and give counts by (language, source, term), added up before the shuffle in bounded memory; everything after works on those. Postings of a term
are as many as sources at most, and meet within a task, where pairs add up. Results of pairs are asked for, so a language's sources squared are written; nothing else grows so.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

SCALE, PRIOR = 1_000_000_000, 5  # fixed values of the probabilities
BUCKETS = 4  # of counts, in each doubling
HELD, PIECE = 400_000, 1 << 20  # counts in a task's memory, bytes of a text that are parted at once
GROUP = ["lang", "source"]

#: ASCII bytes that aren't letters part terms, capitals become small, and bytes of other characters stay.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; a piece ends between terms."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_LETTERS)
        if at + PIECE < len(text):
            ends = piece.rfind(b" ") + 1
            piece = piece[:ends] if ends else text[at:].translate(_LETTERS)
        at += len(piece)
        yield piece.split()


def counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Rows (lang, source, term, n, docs), several of one term possible, and one row with a null term for each task and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()

        def flushed() -> pa.RecordBatch:
            rows = [(*g, t, c, docs[g][t]) for g, of in n.items() for t, c in of.items()]
            n.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                group, own = row[:2], Counter()
                groups.add(group)
                for piece in terms(row[2]):
                    own.update(piece)
                n[group].update(own)
                docs[group].update(own.keys())
            if sum(map(len, n.values())) > HELD:
                yield flushed()
        yield flushed()
        if groups:
            a, b = zip(*groups)
            yield pa.RecordBatch.from_arrays([pa.array(a, kinds[0]), pa.array(b, kinds[1]), pa.nulls(len(a), kinds[2]), *[pa.array([0] * len(a), pa.int64())] * 2], names=names)

    kinds, names = [pa.binary()] * 3 + [pa.int64()] * 2, [*GROUP, "term", "n", "docs"]
    given = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary").alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    found = docs.select(*given).mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    return found.select(*[F.col(c).cast("string").alias(c) for c in (*GROUP, "term")], "n", "docs")


def _probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), exact for counts of any size. Where nothing is kept it isn't used."""
    wide = "decimal(20,0)"
    above, below = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast(wide), F.greatest(total + PRIOR * kept, F.lit(1)).cast(wide)
    return F.lit(1) + F.call_function("div", above, below)


def _index(docs: DataFrame, text: str, lang: str, source: str, least_docs: int) -> DataFrame:
    """Rows (lang, source, term, n, lang_n, first): the postings of kept terms, ``first`` for one posting of each term, and a row with a null term for each group."""
    by_term = Window.partitionBy("lang", "term")
    # dealt by term at once: what follows needs no other shuffle
    found = counted(docs, text, lang, source).repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = found.select(*GROUP, "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"))
    found = found.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).drop("lang_docs")
    return stored(found.withColumn("first", F.col("first") & F.col("term").isNotNull()))


def _groups(index: DataFrame) -> DataFrame:
    """Rows (lang, source, total, lang_total, kept, number): a group's and its language's sizes in kept terms, the number of kept terms, and a number of the source within the language."""
    own = index.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("total"), F.count_if("first").alias("firsts"))
    by_lang = Window.partitionBy("lang")
    sizes = [F.sum("total").over(by_lang).alias("lang_total"), F.sum("firsts").over(by_lang).alias("kept"), F.row_number().over(by_lang.orderBy("source")).alias("number")]
    return stored(own.select(*GROUP, "total", *sizes))


def marking_terms(index: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, item, value, rank): the k terms with the largest p - q above zero."""
    index = index.where("term IS NOT NULL").withColumn("bucket", F.floor(F.log2("n") * BUCKETS).cast("int"))
    bounds = index.groupBy(*GROUP, "bucket").agg(F.max("n").alias("most_n"), F.min("lang_n").alias("least_lang_n"), F.count("*").alias("terms")).join(groups, GROUP)
    bounds = bounds.withColumn("bound", _probability(F.col("most_n"), F.col("total"), F.col("kept")) - _probability(F.col("least_lang_n"), F.col("lang_total"), F.col("kept"))).where("bound > 0")
    best_first = Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = stored(bounds.withColumn("before", F.coalesce(F.sum("terms").over(best_first), F.lit(0))))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")

    def evaluated(buckets: DataFrame) -> DataFrame:
        found = index.join(buckets.select(*GROUP, "bucket", "total", "lang_total", "kept"), [*GROUP, "bucket"])
        value = _probability(F.col("n"), F.col("total"), F.col("kept")) - _probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        return found.select(*GROUP, F.col("term").alias("item"), value.alias("value")).where("value > 0")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # the first buckets that hold k terms; what they reach decides which others are seen at all
    first = stored(ranked(evaluated(bounds.where(F.col("before") < k))))
    reached = first.where(F.col("rank") == k).select(*GROUP, F.col("value").alias("kth"))
    unseen = bounds.where(F.col("before") >= k).join(reached, GROUP, "left").where(F.col("bound") >= F.coalesce("kth", F.lit(1)))
    return ranked(first.drop("rank").unionByName(evaluated(unseen)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, a, b, part) of postings: what terms that sources a < b both use add to the sum of their differences, beyond what each does alone."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    names, size = ["lang", "a", "b", "part"], 0

    def added(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, values = (np.concatenate(x) for x in zip(*held[lang]))
        unique, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(unique), np.int64)
        np.add.at(sums, at, values)
        return unique, sums

    def given() -> Iterator[pa.RecordBatch]:
        for lang in held:
            keys, sums = added(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(sums)], names=names)
        held.clear()

    for batch in batches:
        postings, langs = batch.column(1), batch.column(0).to_pylist()
        starts, flat = postings.offsets.to_numpy(), postings.values
        number, p, zero = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("number", "p", "zero"))
        for lang, lo, hi in zip(langs, starts, starts[1:]):
            step = max(1, 1_000_000 // (hi - lo))
            for at in range(lo, hi, step):
                i, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(hi, at + step)), np.arange(lo, hi), indexing="ij"))
                i, j = i[number[i] < number[j]], j[number[i] < number[j]]
                part = np.abs(p[i] - p[j]) - np.abs(p[i] - zero[j]) - np.abs(zero[i] - p[j]) + np.abs(zero[i] - zero[j])
                held[lang].append((number[i] << 32 | number[j], part))
                size += len(i)
                if size > 4_000_000:
                    for each in held:
                        held[each] = [added(each)]
                    size = sum(len(x[0][0]) for x in held.values())
                    if size > 2_000_000:
                        yield from given()
                        size = 0
    yield from given()


def pair_distances(index: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value, rank): every other source of the language by the sum over kept terms of the difference of p and q."""
    groups = groups.withColumn("zero", _probability(F.lit(0), F.col("total"), F.col("kept")))
    rows = index.where("term IS NOT NULL").join(groups, GROUP).withColumn("p", _probability(F.col("n"), F.col("total"), F.col("kept")))
    postings = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p", "zero")).alias("postings")).where(F.size("postings") > 1)
    shared = postings.select("lang", "postings").mapInArrow(_shared, "lang string, a long, b long, part long")

    # one source's terms against what the other gives a term it doesn't have: a running sum over probabilities, in which the others' are sought
    pairs = groups.select("lang", F.col("number").alias("a"), F.col("zero").alias("zero_a"), "kept").join(groups.select("lang", F.col("number").alias("b"), F.col("zero").alias("x")), "lang").where("a <> b")
    own = rows.groupBy("lang", F.col("number").alias("a"), F.col("p").alias("x")).agg(F.count("*").alias("terms"))
    both = own.select("lang", "a", "x", "terms", *[F.lit(None).cast(t).alias(c) for c, t in (("b", "int"), ("zero_a", "long"), ("kept", "long"))])
    both = both.unionByName(pairs.select("lang", "a", "x", F.lit(0).cast("long").alias("terms"), "b", "zero_a", "kept"))
    one = Window.partitionBy("lang", "a")
    upto, mass = one.orderBy("x").rowsBetween(Window.unboundedPreceding, 0), F.col("terms") * F.col("x")
    sums = [f(c).over(w).alias(name) for name, c, w, f in (("n", F.col("terms"), upto, F.sum), ("s", mass, upto, F.sum), ("all_n", F.col("terms"), one, F.sum), ("all_s", mass, one, F.sum))]
    both = both.select("lang", "a", "b", "x", "zero_a", "kept", *sums).where("b IS NOT NULL")
    between = F.abs(F.col("zero_a") - F.col("x"))
    alone = F.col("x") * (2 * F.col("n") - F.col("all_n")) + F.col("all_s") - 2 * F.col("s") - F.col("all_n") * between
    alone = both.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (alone + F.when(F.col("a") < F.col("b"), F.col("kept") * between).otherwise(0)).alias("part"))
    value = alone.unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    value = value.select("lang", F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("to")), F.struct(F.col("b").alias("of"), F.col("a").alias("to")))).alias("pair"), "value").select("lang", "pair.*", "value")
    for number, name in (("of", "source"), ("to", "item")):
        value = value.join(groups.select("lang", F.col("number").alias(number), F.col("source").alias(name)), ["lang", number])
    return value.select(*GROUP, "item", "value", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")).alias("rank"))


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, k: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` has every other source of a language, part ``term`` the k terms that mark the source within its language.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; a language keeps those of ``least_docs`` of its documents. Nulls in any of the columns are empty strings, and an empty language or source is
    one. Empty texts, and groups without a kept term, count as groups: their distances are between probabilities of unseen terms. Repeated rows count each; texts of any length are read whole, in pieces; equal values go by item in UTF-8 order; an empty
    table gives an empty result; further columns may have any names. All arithmetic is on integers and decimals, the same in any order.
    """
    index = _index(docs, text, lang, source, least_docs)
    groups = _groups(index)
    columns = [*GROUP, F.col("part"), "item", "value", "rank"]
    return marking_terms(index, groups, k).withColumn("part", F.lit("term")).select(*columns).unionByName(pair_distances(index, groups).withColumn("part", F.lit("pair")).select(*columns))
