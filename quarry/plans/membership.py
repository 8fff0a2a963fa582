"""Blocked Bloom filters as tables: which keys a table may hold, asked without reading it.

A filter is a number of blocks of 32,768 bits. A key's hash names its block, and further hashes some bits of it, so a question meets one row of the filter. The blocks
are built by Spark's bitmap aggregates, and asked by a join on the block's number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768  # of a block: fixed by bitmap_construct_agg
PER_KEY = 12  # bits for each key: with 7 hashes a key that isn't there passes about once in 300 times
HASHES = 7


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * PER_KEY // BITS))


def _block(key: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def _bits(key: Column) -> list[Column]:
    """The key's bits, from one hash: steps of an odd width never meet within a block."""
    h = F.xxhash64(key)
    start, step = F.pmod(h, F.lit(BITS)), F.pmod(F.shiftright(h, 20), F.lit(BITS // 2)) * 2 + 1
    return [F.pmod(start + k * step, F.lit(BITS)) for k in range(HASHES)]


def built(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (block, bits) of a filter that holds all of a table's keys."""
    rows = keys.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    return rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe(keys: DataFrame, key: str, filters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of ``keys`` with ``part``, for each part whose filter may hold the key. ``filters`` has (part, block, bits), and ``sizes`` (part, blocks), which has few rows."""
    asked = keys.crossJoin(F.broadcast(sizes)).withColumn("block", _block(F.col(key), F.col("blocks"))).drop("blocks")  # a row for each part

    def bit(b: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (b % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    met = asked.join(filters, ["part", "block"])
    return met.where(reduce(Column.__and__, map(bit, _bits(F.col(key))))).drop("bits", "block")
