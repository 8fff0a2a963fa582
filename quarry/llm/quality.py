"""Quality rules: a threshold table compiled into one projection of ratios, evaluated without user functions or a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, settled, words

SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the languages that the documents are in.
STOP_WORDS = (
    "the of and to in is that it for on with as by this be are was at from or an not have "  # English
    "der die das und in den von zu mit ist im für auf nicht ein eine dem des sich auch "  # German
    "le la les de des et en un une du que qui dans pour par sur est pas avec au "  # French
    "el los las del que y en un una por con para es se no al lo su como más"  # Spanish
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low`` <= ``numerator`` / ``denominator`` <= ``high``; a denominator of 0 passes.

    Numerator and denominator name measures of ``measure``; ``at_least`` words are needed for the rule to apply.
    """

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None
    at_least: int = 0


#: The production thresholds.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_line_chars", "dup_line_chars", "n_chars", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("words_with_letters", "n_alpha_words", "n_words", 0.6, None),
    Rule("upper_case", "n_upper", "n_chars", None, 0.4),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None, at_least=50),
)
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30


def with_windows(rows: DataFrame, hashes: str, out: str, window: int = WINDOW) -> DataFrame:
    """Add ``out``: the hash of each run of ``window`` (a power of two) words, from the words' hashes.

    Hashes of runs are doubled: that of a run of 2n is a hash of those of two runs of n. Each doubling is a projection of its own, so
    that no array is computed twice.
    """
    kept, runs, width = rows.columns, hashes, 1
    while width < window:
        after = F.slice(runs, width + 1, F.greatest(F.size(runs), F.lit(1)))
        rows = rows.select("*", F.zip_with(runs, after, lambda a, b: F.xxhash64(a, b)).alias(f"_runs{2 * width}"))
        runs, width = f"_runs{2 * width}", 2 * width
    whole = F.greatest(F.size(runs) - (window - 1), F.lit(0))  # behind it are runs that the text's end cuts short
    return rows.select(*kept, F.slice(runs, F.lit(1), whole).alias(out))


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id`` and the measures of the whole text, all long. A null text measures as an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.array_distinct("lines").alias("kinds"))
    rows = with_windows(rows, "h", "g").drop("h")
    rows = rows.withColumn("again", F.size(F.array_distinct("g")) < F.size("g"))
    # only where a window occurs twice: sort the windows with their places, so that equal ones are neighbours, and unite their words
    rows = rows.withColumn("placed", F.when(F.col("again"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i")))))).drop("g")
    both = F.zip_with("placed", F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1))), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("starts", F.when(F.col("again"), F.array_sort(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))))).drop("placed")
    gaps = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(b - a, F.lit(WINDOW)))  # the last window has no next one: all its words
    n_repeat = F.when(F.col("again"), F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0))
    chars = lambda x: F.char_length(x).cast("long")
    total = lambda array, f: F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + f(x))
    without = lambda symbols: F.col("t") if not symbols else F.replace(without(symbols[1:]), F.lit(symbols[0]), F.lit(""))
    stop = [F.lit(x) for x in dict.fromkeys(STOP_WORDS)]
    measured = rows.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        total(F.col("w"), chars).alias("word_chars"),
        (chars(F.col("t")) - chars(without(SYMBOLS.strip("[]")))).alias("n_symbols"),
        (F.size("lines") - F.size("kinds")).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
        chars(F.col("t")).alias("n_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (total(F.col("lines"), chars) - total(F.col("kinds"), chars)).alias("dup_line_chars"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        (chars(F.col("t")) - chars(F.translate("t", UPPER, ""))).alias("n_upper"),
        F.size(F.filter("w", lambda x: F.translate(x, UPPER, LOWER).isin(*stop))).cast("long").alias("n_stop_words"),
    )
    return settled(measured, *measured.columns[1:])


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) over the columns of ``measure``."""
    words_, repeated = F.col("n_words"), F.col("n_repeat_words")
    base = (words_ < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * words_)
    kept = ~base
    for rule in rules:
        top, under = F.col(rule.numerator), F.col(rule.denominator) if rule.denominator else F.lit(1)
        ok = F.lit(True)
        if rule.low is not None:
            ok = ok & (top >= rule.low * under)
        if rule.high is not None:
            ok = ok & (top <= rule.high * under)
        kept = kept & (ok | (words_ < rule.at_least))
    return base, kept


def judge(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, the measures, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails. Very long texts are read whole; a ratio that equals its threshold passes. Repeated rows have repeated results; an empty table an
    empty one; other columns aren't read, so their names can't clash.
    """
    base, kept = compile_rules(rules)
    return measure(docs, id_col=id_col, text_col=text_col).withColumns({"base_failed": base, "kept": kept})
