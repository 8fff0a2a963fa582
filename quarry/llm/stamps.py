"""Timestamps of mixed notations to UTC.

Notations are read by expressions. Where only the order of day and month is open, stamps that are possible in one order vote within their source, and the votes are joined back.
Wall times then meet the changes of their zone in a sweep: wall times and markers, which say from which wall time on an offset holds and where
wall times are skipped or repeated, are range-partitioned and sorted together by zone; each partition carries the last marker forward, row by row, and hands it on to the
partitions after it.

Scale: one shuffle of the rows that have neither an offset nor a number, by range, where equal wall times are told apart by a hash; none of the others, except that stamps of an open order are joined
with votes by source in a sort-merge join, which adaptive execution splits where a source is hot. Markers come from a table of the zone names that Java knows, so their number has a bound
(about 600 zones, two markers a change), and only zones that occur are expanded. What passes from partition to partition is one row for each shuffle partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_name, stored

#: Fixed values of the notations.
GAPS = "\t\n\x0b\x0c\r "
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_Y, _2 = "(20[0-9][0-9])", "([0-9][0-9])"
_TIME = r"(?:[T\x20]([0-9][0-9]):([0-9][0-9])(?::([0-9][0-9]))?(?:\x20?([AP])M)?(?:\x20?(?:(Z)|([+-])([0-9][0-9]):?([0-9][0-9])))?)?"
_DATES = [(f"{_Y}-{_2}-{_2}", "ymd"), (f"{_Y}{_2}{_2}", "ymd"), (rf"{_2}\.{_2}\.{_Y}", "dmy"), (f"{_2}\\x20({'|'.join(MONTHS)})\\x20{_Y}", "dmy"), (f"{_2}/{_2}/{_Y}", "/")]
FIRST, LAST = 1998, 2102  # years whose changes are known; the notations have 2000 to 2099
MOST_VOTES = 3  # the winner has over so many times the other's


def _date(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970, null for what the calendar doesn't have."""
    y, m, d = y.try_cast("int"), m.try_cast("int"), d.try_cast("int")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when((m >= 1) & (m <= 12) & (d >= 1) & (d <= length), F.unix_date(F.make_date(y, m, d)))


def parsed(raw: Column) -> Column:
    """A struct: ``epoch`` (microseconds of a number), ``day`` and ``other`` (days since 1970, the second by day before month where a slash leaves the order open, else the same), ``votes`` (1 if a slashed date is
    possible with the month first only, -1 with the day first only), ``second`` of the day and ``offset`` (seconds, null without). All null if the stamp is bad."""
    text = F.btrim(raw, F.lit(GAPS))
    number = F.when(text.rlike(r"\A[0-9]{10}\z"), text.try_cast("long") * 1_000_000).when(text.rlike(r"\A[0-9]{13}\z"), text.try_cast("long") * 1000)

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(text, pattern, k)

    kinds = {k: rf"\A{date}{_TIME}\z" for k, (date, _) in enumerate(_DATES)}
    which = F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in kinds.items()])

    def of(pick) -> Column:
        """The value that ``pick`` makes from the pattern and the form that fit."""
        found = F.lit(None)
        for k, p in reversed(kinds.items()):
            found = F.when(which == k, pick(p, _DATES[k][1])).otherwise(found)
        return found

    def month(p: str, k: int) -> Column:
        found = part(p, k)
        return F.when(found.rlike("[A-Z]"), F.array_position(F.array(*map(F.lit, MONTHS)), found).cast("string")).otherwise(found)

    def day(swapped: bool):
        def pick(p: str, form: str) -> Column:
            if form == "ymd":
                return _date(part(p, 1), part(p, 2), part(p, 3))
            if form == "dmy" or swapped:
                return _date(part(p, 3), month(p, 2), part(p, 1))
            return _date(part(p, 3), part(p, 1), part(p, 2))

        return pick

    fields = of(lambda p, _: F.struct(*[F.nullif(part(p, k), F.lit("")).alias(name) for k, name in zip(range(4, 12), ("h", "m", "s", "half", "z", "sign", "oh", "om"))]))
    first, second = of(day(False)), of(day(True))
    slashed = which == len(_DATES) - 1
    found = F.struct(number.alias("epoch"), first.alias("first"), second.alias("second"), slashed.alias("slashed"), fields.alias("f"))

    def read(x: Column) -> Column:
        f = x["f"]
        hour, minute, sec = (F.coalesce(f[c].try_cast("int"), F.lit(0)) for c in "hms")
        hours = F.when(f["half"].isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(f["half"] == "P", 12).otherwise(0))
        offset = F.when(f["z"].isNotNull(), 0).when(f["sign"].isNotNull(), (f["oh"].try_cast("int") * 3600 + f["om"].try_cast("int") * 60) * F.when(f["sign"] == "-", -1).otherwise(1))
        good = (hours < 24) & (minute < 60) & (sec < 60) & (F.coalesce(f["oh"].try_cast("int"), F.lit(0)) <= 14) & (F.coalesce(f["om"].try_cast("int"), F.lit(0)) < 60)
        good = F.coalesce(good & (x["first"].isNotNull() | x["second"].isNotNull()), F.lit(False))
        votes = F.when(~x["slashed"], 0).when(x["second"].isNull(), 1).when(x["first"].isNull(), -1).otherwise(0)
        return F.struct(
            x["epoch"].alias("epoch"),
            F.when(good, F.coalesce(x["first"], x["second"])).alias("day"),
            F.when(good, F.coalesce(x["second"], x["first"])).alias("other"),
            F.when(good, votes).alias("votes"),
            F.when(good, hours * 3600 + minute * 60 + sec).alias("second"),
            F.when(good, offset).alias("offset"),
        )

    return F.transform(F.array(found), read)[0]


def zone_names(spark: SparkSession) -> list[str]:
    """The names of regions that the session's Java knows: a fixed list of some 600."""
    return spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")


def markers(zones: DataFrame) -> DataFrame:
    """Rows (zone, wall, offset, odd) of known zones, each once: from the wall time (seconds since 1970) on, the offset (seconds) holds, and wall times are skipped or repeated (``odd``) or not.

    Offsets are compared day by day, then by quarter-hours, then by seconds, so changes that are undone within a day aren't seen. While wall times are skipped or repeated the offset
    is that before the change. The first marker of a zone is before all years.
    """

    def offset(at: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), F.col("zone"))) - at

    def changes(df: DataFrame, step: int) -> DataFrame:
        return df.withColumn("before", offset(F.col("at") - step)).withColumn("after", offset(F.col("at"))).where(F.col("before") != F.col("after"))

    def each(step: int, n: int) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("at") - k * step))

    start, days = F.lit((date(FIRST, 1, 1) - date(1970, 1, 1)).days * 86_400).cast("long"), (LAST - FIRST) * 365
    found = zones.select("zone", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day")).select("zone", (start + F.col("day").cast("long") * 86_400).alias("at"))
    found = changes(found, 86_400).select("zone", each(900, 96).alias("at"))
    found = changes(changes(found, 900).select("zone", each(1, 900).alias("at")), 1)
    begins = F.struct((F.col("at") + F.least("before", "after")).alias("wall"), F.col("before").alias("offset"), F.lit(True).alias("odd"))
    ends = F.struct((F.col("at") + F.greatest("before", "after")).alias("wall"), F.col("after").alias("offset"), F.lit(False).alias("odd"))
    found = found.select("zone", F.explode(F.array(begins, ends)).alias("m")).select("zone", "m.*")
    first = zones.select("zone", F.lit(-(1 << 62)).alias("wall"), offset(start).alias("offset"), F.lit(False).alias("odd"))
    return first.unionByName(found)


def _swept(rows: DataFrame) -> DataFrame:
    """Rows (row, zone, wall) with ``offset`` and ``odd``, by their zone's markers."""
    marks = markers(rows.select("zone").distinct())
    empty = rows.schema["row"].dataType.simpleString()
    mixed = rows.withColumn("tie", F.xxhash64("row")).select("zone", "wall", F.lit(1).alias("kind"), "tie", "row", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("boolean").alias("odd"))
    mixed = mixed.unionByName(marks.select("zone", "wall", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(empty).alias("row"), "offset", "odd"))
    order = ["zone", "wall", "kind", "tie"]
    sorted_ = mixed.repartitionByRange(*order).sortWithinPartitions(*order)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the last marker before it in the partition, if any; last, the partition's own last marker."""
        held, part, schema = (None, None), TaskContext.get().partitionId(), None
        for batch in batches:
            schema = batch.column("row").type
            marker = batch.column("kind").to_numpy() == 0
            at = np.maximum.accumulate(np.where(marker, np.arange(len(marker)), -1))
            offset, odd = batch.column("offset"), batch.column("odd")
            took = pa.array(np.maximum(at, 0))
            early, is_row = pa.array(at < 0), pa.array(~marker)
            filled = [pa.compute.if_else(early, pa.scalar(h, c.type), c.take(took)) for h, c in zip(held, (offset, odd))]
            if len(at) and at[-1] >= 0:
                held = (offset[int(at[-1])].as_py(), odd[int(at[-1])].as_py())
            out = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("wall"), *filled, pa.array(np.full(len(marker), part), pa.int32()), pa.array(np.zeros(len(marker), bool))], names=names)
            yield out.filter(is_row)
        if schema is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema), pa.nulls(1, pa.int64()), pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.bool_()), pa.array([part], pa.int32()), pa.array([True])], names=names)

    names = ["row", "wall", "offset", "odd", "part", "last"]
    # kept as a table: bounds of ranges are sampled anew in every job, and a partition's number must mean the same to both reads
    kept = stored(sorted_.mapInArrow(carry, f"row {empty}, wall long, offset long, odd boolean, part int, last boolean"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shuffle partition
    handed = kept.where("last").select("part", *[F.last(c, ignorenulls=True).over(before).alias(f"{c}_") for c in ("offset", "odd")])
    whole = kept.where("NOT last AND offset IS NOT NULL").select("row", "wall", "offset", "odd")
    early = kept.where("NOT last AND offset IS NULL").join(F.broadcast(handed), "part")
    return whole.unionByName(early.select("row", "wall", F.col("offset_").alias("offset"), F.col("odd_").alias("odd")))


def normalise(stamps: DataFrame, *, raw: str = "raw", zone: str = "zone", source: str = "source") -> DataFrame:
    """The same rows with a last column (``_utc``, with underscores after it where there is such a column): a struct of ``utc_us``, ``rule`` and ``ambiguous``.

    Rules: ``bad`` (utc_us is null), ``epoch``, ``votes`` and ``default`` (the order of day and month decided by the source's votes, or by the month first), else ``plain``. ``ambiguous`` are the decided ones and wall times that
    the zone skips or repeats; those take the offset before the change. Null and empty stamps, stamps beside the notations, however long, and stamps without an offset whose zone is null or unknown are bad, and bad stamps don't vote. A null source is a
    source; repeated rows count and stay each; with as many votes on both sides the month is first; an empty table gives an empty one; columns may have any names.
    """
    spark, free = stamps.sparkSession, free_name(stamps, "_utc")
    row = F.struct(*[F.col(f"`{c}`") for c in stamps.columns])
    known = F.col(f"`{zone}`").isin(zone_names(spark))
    read = stamps.select(row.alias("row"), parsed(F.col(f"`{raw}`")).alias("p"), F.col(f"`{source}`").cast("string").alias("source"), F.when(known, F.col(f"`{zone}`")).alias("zone"))
    read = read.select("row", "source", "zone", "p.*").withColumn("good", F.coalesce(F.col("epoch").isNotNull() | (F.col("day").isNotNull() & (F.col("offset").isNotNull() | F.col("zone").isNotNull())), F.lit(False)))
    read = stored(read)
    wall = (F.col("day").cast("long") * 86_400 + F.col("second")).alias("wall")
    is_open = "good AND epoch IS NULL AND day <> other"
    votes = read.where("good AND epoch IS NULL AND votes <> 0").groupBy("source").agg(F.count_if(F.col("votes") > 0).alias("month_first"), F.count_if(F.col("votes") < 0).alias("day_first"))
    joined = read.where(is_open).join(votes.hint("merge").withColumnRenamed("source", "voter"), F.col("source").eqNullSafe(F.col("voter")), "left")
    a, b = F.coalesce("month_first", F.lit(0)), F.coalesce("day_first", F.lit(0))
    rule = F.when((a > MOST_VOTES * b) | (b > MOST_VOTES * a), "votes").otherwise("default")
    chosen = joined.withColumn("rule", rule).withColumn("day", F.when(b > MOST_VOTES * a, F.col("other")).otherwise(F.col("day")))
    dated = chosen.select("row", "zone", "offset", "rule", wall).unionByName(read.where(f"good AND epoch IS NULL AND NOT ({is_open})").select("row", "zone", "offset", F.lit("plain").alias("rule"), wall))
    dated = stored(dated)

    def result(df: DataFrame, us: Column, rule: Column, ambiguous: Column) -> DataFrame:
        return df.select("row.*", F.struct(us.cast("long").alias("utc_us"), rule.alias("rule"), ambiguous.alias("ambiguous")).alias(free))

    decided = F.col("rule").isin("votes", "default")
    utc = (F.col("wall") - F.col("offset")) * 1_000_000
    swept = _swept(dated.where("offset IS NULL").select(F.struct("row", "rule").alias("row"), "zone", "wall"))
    swept = swept.select("row.row", "row.rule", "wall", "offset", "odd")
    numbers = result(read.where("epoch IS NOT NULL"), F.col("epoch"), F.lit("epoch"), F.lit(False))
    bad = result(read.where("NOT good"), F.lit(None), F.lit("bad"), F.lit(False))
    offsets = result(dated.where("offset IS NOT NULL"), utc, F.col("rule"), decided)
    return numbers.unionByName(bad).unionByName(offsets).unionByName(result(swept, utc, F.col("rule"), decided | F.col("odd")))
