"""Row numbers over a whole table without passing it through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.files import scratch


def numbered(rows: DataFrame, *order: str, name: str = "n", folder: str | None = None) -> DataFrame:
    """The rows with their number (from 1) in the order of columns, in a last column. Rows are range-partitioned and sorted, and written once, for a second pass needs the same ranges; each partition then adds the sizes
    of those before it, of which there is one for each shuffle partition. Equal rows are numbered in any order."""
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    path = folder or scratch(rows.sparkSession, "numbered")
    dealt.write.parquet(path)
    kept = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shuffle partition
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
