"""Blocked Bloom filters: broadcast at a bound size before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers, one for each 32-bit word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x2824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
#: Most blocks (32 bytes each) of a filter.
MOST_BLOCKS = 1 << 17


def _address(key: Column, blocks: int) -> list[Column]:
    """The block of a key, and its bit in each of the block's eight words."""
    high = F.shiftrightunsigned(F.xxhash64(key), 32)
    low = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]
    return [(high % F.lit(blocks)).cast("int").alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(bits))]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """A blocked Bloom filter of the column ``key``: at most ``blocks`` rows (block, w0 .. w7), 256 bits each.

    Every key sets one bit in each of the eight words of one block. The size is bound by ``blocks`` whatever the
    number of keys; with more keys, more false positives reach the exact join.
    """
    placed = keys.select(*_address(F.col("key"), blocks))
    return placed.groupBy("block").agg(*(F.expr(f"bit_or(shiftleft(1, b{i}))").alias(f"w{i}") for i in range(8)))


def may_contain(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` the filter may hold. The filter has a proven size and is broadcast."""
    columns = rows.columns
    placed = rows.select("*", *_address(F.col("key"), blocks)).join(F.broadcast(bloom), "block")
    hit = F.lit(True)
    for i in range(8):
        hit = hit & (F.expr(f"w{i} & shiftleft(1, b{i})") != 0)
    return placed.filter(hit).select(*columns)


def sized(keys: DataFrame, most: int = MOST_BLOCKS) -> int:
    """Blocks for so many keys at about 16 bits each, a power of two up to ``most``.

    Beyond some eight million keys the filter passes more and more, and the exact join behind it does the work.
    """
    return min(most, 1 << max(8, (keys.count() // 16).bit_length()))


def apart(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be in ``keys``, rows whose key is not): only the former need an exact join.

    ``keys`` has a column ``key`` and should be a written table. Both parts have the columns of ``rows``, whatever
    their names. A null key is a key like others.
    """
    blocks = sized(keys)
    placed = rows.select(F.struct("*").alias("row"), *_address(key, blocks)).join(F.broadcast(bloom_filter(keys, blocks)), "block", "left")
    hit = F.col("w0").isNotNull()
    for i in range(8):
        hit = hit & (F.expr(f"w{i} & shiftleft(1, b{i})") != 0)
    placed = placed.withColumn("maybe", F.coalesce(hit, F.lit(False)))
    return placed.filter("maybe").select("row.*"), placed.filter("not maybe").select("row.*")
