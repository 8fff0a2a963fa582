"""Mixing sources to target weights by entropy balancing.

Document rates between 0 and ``most`` copies are as close as they can be (in the relative entropy of a bounded rate) to one copy each, under
the constraint that each source's words, at these rates, meet its target. The solution tilts the odds of a rate exponentially with the document's size:
rate = most / (1 + (most - 1) exp(-lambda x)), x being the size over the source's mean size, with one multiplier lambda a source. The multipliers minimise a
convex dual, whose gradient is the words at these rates less the target; Newton steps, kept within a bracket, find its root.

Rates depend on source and size alone, so the sums run over a table of (source, size, documents) made by one aggregation. Rates are rounded
to whole copies: a document's margin is a hash of it less the fraction of its rate, and of the lowest margins so many documents get the next whole number as the
target leaves room for. That takes passes over a histogram of margins: each fills the room up to the first document that is too large for what is left, the
next one goes on with the documents that aren't, and a last one is let in if that comes nearer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, fits, free_name, stored, words

MARGINS = 1 << 13  # bins of the rounding's margins, which lie between -1 and 1
WIDEST = 700.0  # of an exponent


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Targets of sources: ``sizes`` has a row (source, total) a source; the result adds ``target``.

    Sources are ordered by code point, null last, and take the weights in turn, repeating. They share the sum of all totals; a source's target stops at
    ``most`` times its total, and the excess is shared by weight until none is above. Filling closes the sources in the order of total
    by weight, so one pass over the sorted sources finds how far it goes. There is one row a source here, however many documents.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1))
    weighed = weighed.withColumn("cap", most * F.col("total"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.withColumns(
        {
            "left": F.sum("total").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # the level: words for each unit of weight, from the first source that isn't capped when its turn comes; later ones have less left
    filled = filled.withColumn("level", F.when(F.col("cap") / F.col("weight") >= F.col("left") / F.col("left_weight"), F.col("left") / F.col("left_weight")))
    filled = filled.withColumn("level", F.max("level").over(everything))
    return filled.select("source", "total", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _rate(multiplier: Column, x: Column, most: float) -> Column:
    tilt = F.greatest(F.least(multiplier * x, F.lit(WIDEST)), F.lit(-WIDEST))
    return most / (1 + (most - 1) * F.exp(-tilt))


def multipliers(sizes: DataFrame, goals: DataFrame, *, most: float, rounds: int = 200, tolerance: float = 1e-7, most_broadcast: int = 50_000) -> DataFrame:
    """One row (source, total, mean, target, multiplier) a source; the multiplier is null where all rates are ``most``.

    ``sizes`` has rows (source, size, n). Each round is one aggregation of it. A round steps by Newton's rule where that stays in the bracket of
    the root, else to the bracket's middle, or twice as far while there is no bracket; halving alone reaches any tolerance of doubles in less than ``rounds`` steps.
    """
    means = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(means, goals["source"].eqNullSafe(means["source"])).select(goals["source"], "total", "mean", "target")
    open_ = (F.col("target") < most * F.col("total")) & (F.col("total") > 0)
    state = state.withColumns({"multiplier": F.when(open_, F.lit(0.0)), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "gap": F.lit(None).cast("double")})
    state = stored(state.coalesce(1))
    small = fits(state, most_broadcast, "source")
    for left in range(rounds, -1, -1):
        if not left:
            raise RuntimeError(f"the multipliers did not reach a gap of {tolerance} in {rounds} rounds")
        now = state.where("multiplier IS NOT NULL").select(F.col("source").alias("s"), "multiplier", "mean")
        rows = sizes.join(F.broadcast(now) if small else now, sizes["source"].eqNullSafe(F.col("s")))
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), x, most)
        reached, slope = rate * F.col("size") * F.col("n"), rate * (1 - rate / most) * x * F.col("size") * F.col("n")
        # decimals add up to the same in any order, so the multipliers don't depend on the partitioning
        grams = rows.groupBy("s").agg(*[F.sum(v.cast("decimal(34,8)")).cast("double").alias(name) for v, name in ((reached, "reached"), (slope, "slope"))])
        met = state.join(F.broadcast(grams) if small else grams, state["source"].eqNullSafe(grams["s"]), "left")
        gap = F.col("reached") - F.col("target")
        met = met.withColumns({"low": F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high")), "gap": F.abs(gap) / F.col("total")})
        step = F.col("multiplier") - F.try_divide(gap, F.col("slope"))
        middle = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).when(F.col("low").isNull(), 2 * F.col("high") - 8).otherwise(2 * F.col("low") + 8)
        inside = step.isNotNull() & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high"))) & (F.abs(step - F.col("multiplier")) < 64)
        met = met.withColumn("multiplier", F.when(F.col("gap") <= tolerance, F.col("multiplier")).when(F.col("multiplier").isNotNull(), F.when(inside, step).otherwise(middle)))
        state = stored(met.select(*state.columns).coalesce(1))
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("source", "total", "mean", "target", "multiplier")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What decisions depend on: ``_id``, ``_key`` (hash of the text), ``_source`` and ``_size``."""
    size = F.size(words(F.col(text_col).cast("string"))).cast("long")
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(source_col).cast("string").alias("_source"), size.alias("_size")]


def _rated(rows: DataFrame, solved: DataFrame, most: int, small: bool) -> DataFrame:
    """Add the source's solution, ``rate``, ``whole`` (copies that are sure) and ``bin`` (of the margin; null if no copy can come on top)."""
    joined = rows.join(F.broadcast(solved) if small else solved, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    tilted = _rate(F.col("multiplier"), F.col("_size") / F.col("mean"), float(most))
    rate = F.when(F.col("_size") == 0, F.lit(1.0)).when(F.col("multiplier").isNull(), F.lit(float(most))).otherwise(tilted)
    joined = joined.withColumn("rate", rate).withColumn("whole", F.least(F.floor("rate"), F.lit(most)))
    luck = F.shiftrightunsigned(F.xxhash64("_id", "_key"), 11) / F.lit(float(1 << 53))
    margin = luck - (F.col("rate") - F.col("whole"))
    return joined.withColumn("bin", F.when((F.col("whole") < most) & (F.col("_size") > 0), F.floor((margin + 1) * (MARGINS // 2))))


def _extra() -> Column:
    """Whether a document gets the next whole number: one of the source's steps takes its margin and its size."""
    return F.coalesce(F.exists("steps", lambda s: (F.col("bin") <= s["last"]) & (F.col("_size") <= s["most"])), F.lit(False))


def _copies() -> Column:
    return (F.col("whole") + F.when(_extra(), 1).otherwise(0)).cast("long")


def solve(sized: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: int = 3, share: float = 1.0, near: float = 1e-4, most_broadcast: int = 50_000) -> tuple[DataFrame, bool]:
    """One row (source, total, mean, target, multiplier, steps) a source, and whether that is small enough to broadcast. Steps are made until all sources are as ``near`` to
    their targets as that share, or no document is left that fits."""
    sizes = cut(sized.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.count("*").alias("n")))
    sizes = sizes.coalesce(1 + sizes.count() // 100_000)
    totals = cut(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("total")).coalesce(1))
    shared = targets(totals.withColumn("total", F.col("total") * share), weights, most / share)
    goals = stored(shared.select("source", (F.col("total") / share).alias("total"), "target"))
    solved = multipliers(sizes, goals, most=float(most), most_broadcast=most_broadcast)
    small = fits(solved, most_broadcast, "source")
    sure = _rated(sized, solved, most, small).groupBy(F.col("_source").alias("s")).agg(F.sum(F.col("whole") * F.col("_size")).alias("sure"))
    state = solved.join(F.broadcast(sure) if small else sure, F.col("source").eqNullSafe(F.col("s"))).withColumn("room", F.col("target") - F.col("sure")).drop("s", "sure")
    state = stored(state.withColumn("steps", F.array().cast("array<struct<last:bigint,most:double>>")).coalesce(1))
    while True:
        open_ = _rated(sized, state, most, small).where(F.col("bin").isNotNull() & (F.col("_size") <= F.col("room")) & ~_extra())
        bins = open_.groupBy(F.col("_source").alias("source"), "bin").agg(F.sum("_size").alias("words"), F.max("room").alias("room"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        full = bins.withColumn("upto", upto).where(F.col("upto") <= F.col("room")).groupBy(F.col("source").alias("s")).agg(F.max("bin").alias("last"), F.max("upto").alias("got"))
        met = state.join(F.broadcast(full) if small else full, F.col("source").eqNullSafe(F.col("s")), "left")
        step = F.struct(F.coalesce("last", F.lit(-1).cast("long")).alias("last"), F.col("room").alias("most"))
        met = met.withColumns({"steps": F.when(F.col("got") > 0, F.concat("steps", F.array(step))).otherwise(F.col("steps")), "room": F.col("room") - F.coalesce("got", F.lit(0))})
        before, state = state, stored(met.select(*state.columns).coalesce(1))
        after = state.agg(F.max(F.try_divide(F.col("room"), F.col("target"))).alias("far"), F.sum(F.size("steps")).alias("steps")).first()
        if (after["far"] or 0.0) <= near or after["steps"] == before.agg(F.sum(F.size("steps"))).first()[0]:
            break
    # what is left is too large for the room; the smallest of it goes in if that comes nearer to the target
    rest = _rated(sized, state, most, small).where(F.col("bin").isNotNull() & ~_extra() & (F.col("_size") < 2 * F.col("room")))
    rest = rest.groupBy(F.col("_source").alias("s"), "_size", "bin").agg(F.sum("_size").alias("words")).groupBy("s").agg(F.min(F.struct("_size", "bin", "words")).alias("one"))
    met = state.join(F.broadcast(rest) if small else rest, F.col("source").eqNullSafe(F.col("s")), "left")
    step = F.struct(F.col("one.bin").alias("last"), F.col("one._size").cast("double").alias("most"))
    met = met.withColumn("steps", F.when(F.col("one.words") < 2 * F.col("room"), F.concat("steps", F.array(step))).otherwise(F.col("steps")))
    return stored(met.select(*state.columns).drop("room").coalesce(1)), small


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``id``, ``source``, ``size`` (words), ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    Sources share ``share`` of all words. ``copies`` are whole and at most ``most``; ``taken`` is copies times size. A null text has size 0;
    documents of size 0 take nothing and get one copy. A null source is a source. Repeated rows are decided alike, and each counts. Very long texts are read whole. The hash that
    orders documents is of id and text, and sums don't depend on the order of rows, so reruns agree; documents of equal margins are decided alike. An empty table gives an empty
    result; other columns aren't read, so their names can't clash.
    """
    sized = cut(docs.select(*_sized(docs, id_col, text_col, source_col)))
    solved, small = solve(sized, weights=weights, most=most, share=share)
    rated = _rated(sized, solved, most, small)
    copies = _copies()
    return rated.select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("total").cast("long").alias("source_size"), "target", "rate", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows and columns of ``docs``, each as often as ``mix`` has copies of it, with a last column ``copy``: 1, 2, ... It has underscores after its name while ``docs`` has such a
    column.

    Nulls, empty and very long texts, ties, repeated rows and empty tables are as in ``mix``. Rows travel as one struct, so that columns may have any names. Texts aren't
    shuffled: decisions depend on a row and its source's solution only.
    """
    solved, small = solve(cut(docs.select(*_sized(docs, id_col, text_col, source_col))), weights=weights, most=most, share=share)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_sized(docs, id_col, text_col, source_col))
    rated = _rated(rows, solved, most, small)
    rated = rated.select("_row", _copies().alias("_n")).where("_n > 0")
    return rated.select("_row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias(free_name(docs, "copy")))
