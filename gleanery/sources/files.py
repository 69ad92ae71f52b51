"""File trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """(path, entry_type, size_bytes, is_symlink, modified_time_ns, content) of all files below ``root``.

    Paths are relative to ``root``; ``max_depth`` limits their segments. Object stores hold no symbolic links, so
    is_symlink is false. Content is read only where a later step uses it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.expr(f"substring(path, locate('{base.replace(chr(39), chr(92) + chr(39))}/', path) + {len(base) + 1})"), "^/+", "")
    rows = files.select(
        path.alias("path"), F.lit("file").alias("entry_type"), F.col("length").alias("size_bytes"), F.lit(False).alias("is_symlink"),
        (F.unix_micros("modificationTime") * 1000).alias("modified_time_ns"), "content",
    )
    return rows.filter(F.size(F.split("path", "/")) <= max_depth) if max_depth else rows
