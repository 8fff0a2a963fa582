"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import running

#: The six white-space characters that part words: \x09-\x0D and \x20.
WORD_GAPS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where that is unset and the session is local, as in tests, a temporary one is set; on a cluster the executors wouldn't share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The same, read again by a task for so many rows, not by all that a shuffle has. For narrow tables that may be small: what reads them makes tasks and files by their size."""
    shared_folder(df.sparkSession)
    seen = Observation()
    made = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return made.coalesce(1 + seen.get["n"] // rows)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder. For the state of loops: a checkpoint keeps what the optimiser knows of its
    columns, which grows with each round."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it while the table has a column that is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


MOST_BYTES = 64 << 20  # of variable columns in a broadcast


def fits(df: DataFrame, rows: int, *texts: str) -> bool:
    """Whether a table has at most so many rows, and its columns ``texts``, which may be of any size, at most ``MOST_BYTES`` in all. It counts no further than that."""
    if not texts:
        return df.limit(rows + 1).count() <= rows
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in texts), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes")).first()
    return found["n"] <= rows and (found["bytes"] or 0) <= MOST_BYTES


def settled(rows: DataFrame, *names: str) -> DataFrame:
    """The same rows and columns, ``names`` last. A filter on those stays above: pushed below the projections that make them, it would have all of their
    expressions inlined and evaluated again. Spark pushes no filter below what a generator makes, so they go through one of a single element."""
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*rest, F.explode_outer(F.array(F.struct(*names))).alias("_settled")).select(*rest, "_settled.*")


def united(spans: Column, apart) -> Column:
    """Sorted spans (structs with ``start`` and ``end``) of which those that aren't ``apart`` (a test of an end and a later start) are one: a struct with the first
    one's fields and the largest end. Give a column that has been computed, for it's used several times."""
    ends = running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
    both = F.zip_with(spans, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    before = F.concat(F.array(F.lit(-1)), F.slice(ends, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))))
    after = F.concat(F.slice(F.transform(spans, lambda s: s["start"]), 2, F.greatest(F.size(spans), F.lit(1))), F.array(F.lit(None).cast("int")))
    first = F.filter(F.zip_with(both, before, lambda x, b: F.when((b < 0) | apart(b, x["s"]["start"]), x["s"])), lambda x: x.isNotNull())
    last = F.filter(F.zip_with(both, after, lambda x, a: F.when(a.isNull() | apart(x["e"], a), x["e"])), lambda x: x.isNotNull())
    return F.zip_with(first, last, lambda s, e: s.withField("end", e))


def words(text: Column) -> Column:
    """The runs of characters that are not white space; none for null.

    The five rarer gaps become blanks by plain replacement, and a split at one literal character needs no regular expression.
    """
    for gap in WORD_GAPS[:-1]:
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def text_key(text: Column) -> Column:
    """Together with an id it tells rows apart where ids repeat or are null."""
    return F.xxhash64(text)
