"""Benchmark decontamination by winnowing.

A text is a sequence of words, and a k-gram's fingerprint a hash of k words. Of every ``window - k + 1`` neighbouring k-grams, winnowing
keeps the smallest fingerprint. Two texts that share ``window`` words in a row share all k-grams of that span, and so its smallest: joining what
documents and items keep finds every shared span of that length. Hits are then extended: each run of ``window`` words that contains the k-gram
is compared with the items' runs, word by word. Items shorter than ``window`` are one run; for the lengths that occur, documents keep all fingerprints
of that many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, cut, fits, text_key, united

GRAM = 4
SALTS = 16
#: What parts words: all ASCII but letters and digits.
PARTERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def item_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and all that isn't ASCII; none for null."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + PARTERS, LOWER + " " * len(PARTERS))
    return F.array_remove(F.split(plain, " "), "")


def _shifted(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array), F.lit(1)))


def _joined(array: str, other: str, by: int, how) -> Column:
    """``how`` of each element and the one of ``other`` that stands ``by`` places after it."""
    return F.zip_with(array, _shifted(other, by), how)


def with_fingerprints(rows: DataFrame, *, window: int, short: tuple[int, ...]) -> DataFrame:
    """Add ``marks``: structs (fp, size) of what is kept of ``words``, see ``_mark``. ``short`` are the lengths of short items.

    Hashes of runs are made from those of shorter runs, minima of runs of k-grams from minima of shorter ones, each in a projection of its
    own, so that none is computed twice.
    """
    kept = rows.columns
    fuse = lambda a, b: F.xxhash64(a, b)
    rows = rows.select("*", F.transform("words", lambda x: F.xxhash64(x)).alias("_g1"))
    rows = rows.select("*", _joined("_g1", "_g1", 1, fuse).alias("_g2"))
    rows = rows.select("*", _joined("_g2", "_g2", 2, fuse).alias("_g4"))
    made = {1: "_g1", 2: "_g2", 4: "_g4"}
    parts: dict[int, tuple[int, int]] = {}  # each further length: a power of two and the rest
    todo = list(short)
    while todo:
        n = todo.pop()
        if n not in made and n not in parts:
            head = 1 << ((n - 1).bit_length() - 1)
            parts[n] = head, n - head
            todo += parts[n]
    for n, (head, rest) in sorted(parts.items()):
        rows = rows.select("*", _joined(made[head], made[rest], head, fuse).alias(f"_g{n}"))
        made[n] = f"_g{n}"
    # the smallest of window - GRAM + 1 k-grams with its place; where equal, the later one
    span = window - GRAM + 1
    grams = F.greatest(F.size("words") - (GRAM - 1), F.lit(0))
    rows = rows.select("*", F.slice("_g4", F.lit(1), grams).alias("_m1"))
    least = lambda a, b: F.least(a, b)
    width = 1
    while 2 * width <= span:
        rows = rows.select("*", _joined(f"_m{width}", f"_m{width}", width, least).alias(f"_m{2 * width}"))
        width *= 2
    last = _joined(f"_m{width}", f"_m{width}", span - width, least) if span > width else F.col(f"_m{width}")
    rows = rows.select("*", F.slice(last, F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(0))).alias("_least"))
    rows = rows.select("*", F.array_distinct("_least").alias("_own"))
    marks = F.transform("_own", _mark(GRAM))
    for n in short:
        whole = F.slice(made[n], F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0)))
        marks = F.concat(marks, F.transform(F.array_distinct(whole), _mark(-n)))
    return rows.select(*kept, marks.alias("marks"))


def _runs(words: Column, starts: Column, size: Column | int) -> Column:
    """Structs (at, size, run) for the runs of ``size`` words at ``starts``."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(starts, lambda i: F.struct(i.alias("at"), size.alias("size"), F.array_join(F.slice(words, i + 1, size), " ").alias("run")))


def _all_starts(words: Column, size: Column | int) -> Column:
    last = F.size(words) - size
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _mark(size: int):
    """A fingerprint of a k-gram that winnowing keeps, or, with a negative size, of a whole run of so many words."""
    return lambda x: F.struct(x.alias("fp"), F.lit(size).alias("size"))


def _each(rows: DataFrame, array: str | Column, name: str, *keep: str) -> DataFrame:
    """Explode an array. ``explode`` itself would have a test of the array's size pushed below all projections that make it, and
    those inlined there; ``explode_outer`` hasn't, and its rows for empty arrays go here."""
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str, small: bool, salt: str) -> DataFrame:
    """Join with a table that is broadcast if its size, which was checked, allows; else dealt out with salts against hot keys."""
    if small:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def hits(docs: DataFrame, items: DataFrame, *, window: int = 10, most_broadcast: int = 200_000, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document text that an item's run occurs in: ``id``, ``key`` (hash of the text), ``spans`` (arrays [start, end) of hit words, united,
    in order), ``n_hit`` (words in them) and ``items`` (ids of the items with occurring runs, as sorted strings).

    Texts that differ in id or content are apart; repeated rows are one. Null and empty texts have no words and are never hit; a null item id
    counts as an item but isn't listed. Of equal fingerprints in a window the later one is kept, which any of them would do. Very long texts are read whole. Empty tables give an
    empty result. Other columns aren't read, so their names can't clash.
    """
    if not 2 * GRAM <= window + 1 <= 64:
        raise ValueError(f"a window of {window} words can't be winnowed by {GRAM}-grams")
    bench = items.select(F.col(item_id).alias("item"), item_words(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    bench = cut(bench.withColumn("run_size", F.least(F.size("words"), F.lit(window))))
    short = tuple(sorted(r[0] for r in bench.where(F.col("run_size") < window).select("run_size").distinct().collect()))  # below window numbers
    known = with_fingerprints(bench, window=window, short=short)
    # of a short item its one run; of others what winnowing keeps
    known = _each(known, "marks", "m", "run_size").where(F.when(F.col("run_size") < window, F.col("m.size") == -F.col("run_size")).otherwise(F.col("m.size") > 0))
    known = cut(known.select("m.fp", "m.size").distinct())
    runs = _each(bench, _runs(F.col("words"), _all_starts(F.col("words"), F.col("run_size")), F.col("run_size")), "r", "item")
    runs = cut(runs.select("item", "r.size", "r.run").distinct())
    small = fits(known, most_broadcast) and fits(runs, most_broadcast, "run", "item")

    rows = docs.select(F.col(doc_id).alias("id"), text_key(F.col(doc_text)).alias("key"), item_words(F.col(doc_text)).alias("words"))
    marks = _each(with_fingerprints(rows, window=window, short=short), "marks", "m", "id", "key").select("id", "key", "m.fp", "m.size")
    met = cut(_join(marks, known, ["fp", "size"], "left_semi", small, "id").groupBy("id", "key").agg(F.collect_set(F.struct("fp", "size")).alias("met")))
    # extension: again the words, of the texts that met a fingerprint only, and all runs that contain a k-gram which was met
    own = met.withColumnsRenamed({"id": "i", "key": "k"})
    texts = docs.select(F.col(doc_id).alias("id"), text_key(F.col(doc_text)).alias("key"), F.col(doc_text).alias("text"))
    texts = texts.join(F.broadcast(own) if fits(met, most_broadcast, "id", "met") else own, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))).drop("i", "k")
    found = texts.dropDuplicates(["id", "key"]).select("id", "key", "met", item_words(F.col("text")).alias("words"))
    found = _each(_with_starts(found, window, short), "runs", "r", "id", "key").select("id", "key", "r.at", "r.size", "r.run")
    # a text holds a run at many places; which runs are the items' is asked once for each
    placed = found.groupBy("id", "key", "size", "run").agg(F.collect_list("at").alias("at"))
    theirs = runs.select("size", "run").distinct()
    hit = cut(_join(placed, theirs, ["size", "run"], "left_semi", small, "id"))
    spans = hit.select("id", "key", "size", F.explode("at").alias("at")).groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")))).alias("s"))
    spans = cut(spans).select("id", "key", united(F.col("s"), lambda end, start: start > end).alias("spans"))
    spans = spans.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]))
    listed = _join(hit.select("id", "key", "size", "run"), runs, ["size", "run"], "inner", small, "id").groupBy("id", "key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    same = (spans["key"] == listed["key"]) & spans["id"].eqNullSafe(listed["id"])
    return spans.join(listed, same).select(spans["id"], spans["key"], "spans", "n_hit", "items")


def _with_starts(rows: DataFrame, window: int, short: tuple[int, ...]) -> DataFrame:
    """Add ``runs``: those of ``window`` words with a k-gram that was met, and those of shorter items' lengths that were met."""
    rows = rows.select("*", F.transform("words", lambda x: F.xxhash64(x)).alias("_g1"))
    rows = rows.select("*", _joined("_g1", "_g1", 1, lambda a, b: F.xxhash64(a, b)).alias("_g2"))
    rows = rows.select("*", _joined("_g2", "_g2", 2, lambda a, b: F.xxhash64(a, b)).alias("_g4"))
    wanted = F.transform(F.filter("met", lambda m: m["size"] > 0), lambda m: m["fp"])
    rows = rows.select("*", F.map_from_arrays(wanted, F.transform(wanted, lambda x: F.lit(True))).alias("_wanted"))
    places = F.filter(F.transform("_g4", lambda g, i: F.when(F.try_element_at("_wanted", g), i)), lambda i: i.isNotNull())
    last = F.size("words") - window
    starts = F.flatten(F.transform(places, lambda p: F.when(last >= F.greatest(p - (window - GRAM), F.lit(0)), F.sequence(F.greatest(p - (window - GRAM), F.lit(0)), F.greatest(F.least(p, last), F.greatest(p - (window - GRAM), F.lit(0))))).otherwise(F.array().cast("array<int>"))))
    rows = rows.select("*", F.array_distinct(starts).alias("_starts"))
    runs = _runs(F.col("words"), F.col("_starts"), window)
    for n in short:
        asked = F.array_contains(F.transform("met", lambda m: m["size"]), -n)
        runs = F.concat(runs, F.when(asked, _runs(F.col("words"), _all_starts(F.col("words"), n), n)).otherwise(F.slice(runs, 1, 0)))
    return rows.select("id", "key", runs.alias("runs"))


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, doc_id: str = "doc_id", doc_text: str = "text", **how) -> DataFrame:
    """One row per document: ``id``, ``key``, ``n_words``, ``n_hit``, ``items`` (empty if none), ``spans`` and ``contaminated``.

    Null and empty texts, repeated rows, null item ids and empty tables are as in ``hits``; each repeated row has its result. Very long texts are read whole. Other columns aren't
    read, so their names can't clash.
    """
    found = hits(docs, items, window=window, doc_id=doc_id, doc_text=doc_text, **how).withColumnsRenamed({"id": "i", "key": "k"})
    rows = docs.select(F.col(doc_id).alias("id"), text_key(F.col(doc_text)).alias("key"), F.size(item_words(F.col(doc_text))).cast("long").alias("n_words"))
    joined = rows.join(found, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left")
    return joined.select(
        "id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, window: int = 10, most_broadcast: int = 200_000, doc_id: str = "doc_id", doc_text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, that no item's run occurs in.

    Null and empty texts stay, as do all rows if there are no items; repeated rows go or stay alike; very long texts are read whole; an empty table gives an empty one. Rows
    travel as one struct, so that columns may have any names.
    """
    found = hits(docs, items, window=window, doc_id=doc_id, doc_text=doc_text, most_broadcast=most_broadcast, **how)
    found = cut(found.select(F.col("id").alias("_q_id"), F.col("key").alias("_q_key")))
    found = F.broadcast(found) if fits(found, most_broadcast, "_q_id") else found
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), text_key(F.col(doc_text)).alias("key"))
    return rows.join(found, (F.col("key") == F.col("_q_key")) & F.col("id").eqNullSafe(F.col("_q_id")), "left_anti").select("row.*")
