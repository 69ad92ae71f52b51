"""Small sides of joins, and small tables, whose size is checked."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(df: DataFrame, most: int, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``use`` gives for each block of ``df``, marked for broadcast.

    As many blocks as ``most`` rows each take; rows fall into them by their hash, so a block may hold a few more. Each
    block is one broadcast at a time and one pass over the other side.
    """
    n = -(-df.count() // most)
    if n < 2:
        return use(F.broadcast(df))
    block = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return reduce(DataFrame.unionByName, [use(F.broadcast(df.filter(block == k))) for k in range(n)])


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if all of it is smaller than one input split.

    Such a table often lies in a single row group, which one task reads and works on; larger ones stay where they are.
    """
    spark = df.sparkSession
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())  # as bytes, however it is written ("16m")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size < split else df
