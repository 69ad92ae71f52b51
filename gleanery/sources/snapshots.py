"""Snapshots of inventories and indexes as Parquet, with a log of what was committed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partition columns of the data; a version is one attempt to write a snapshot.
PARTITIONS = ("project_id", "snapshot_id", "version")


def _log(root: str, kind: str) -> str:
    return f"{root}/{kind}_log"


def write_snapshot(df: DataFrame, root: str, kind: str, snapshot_id: str) -> None:
    """Adds the rows (with project_id and created_at) as a snapshot of ``kind``; a snapshot written twice is replaced.

    The rows go to folders of a new version first, then one file of the log names them: project_id, snapshot_id, version,
    created_at (the latest of the project's rows), n_rows and the time. Until that file is in place, readers don't see
    any of the rows, so a write that fails halfway, or is repeated, changes nothing and adds nothing.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    data = f"{root}/{kind}"
    df.withColumns({"snapshot_id": F.lit(snapshot_id), "version": F.lit(version)}).write.mode("append").partitionBy(*PARTITIONS).parquet(data)
    if df.isEmpty():
        return
    written = _data(spark, root, kind).filter(F.col("version") == version)
    entries = written.groupBy(*PARTITIONS).agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("n_rows"))
    entries.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(_log(root, kind))


def _data(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All rows below the folder, with the names of folders as they are: 002 is no number."""
    found = spark.read.parquet(f"{root}/{kind}").schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(f"{root}/{kind}")


def committed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The log's valid entries: of each project and snapshot the version committed last."""
    last = F.max_by(F.struct("version", "created_at", "n_rows", "committed_at"), F.struct("committed_at", "version")).alias("e")
    return spark.read.parquet(_log(root, kind)).groupBy("project_id", "snapshot_id").agg(last).select("project_id", "snapshot_id", "e.*")


def _rows(spark: SparkSession, root: str, kind: str, entries: DataFrame) -> DataFrame:
    """The data of these entries. The log has one row per project and snapshot; its partitions prune the scan of the data."""
    wanted = entries.filter(F.col("n_rows") > 0).select(*PARTITIONS)
    return _data(spark, root, kind).join(wanted, list(PARTITIONS), "left_semi").drop("version")


def read_snapshots(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All committed snapshots."""
    return _rows(spark, root, kind, committed(spark, root, kind))


def read_snapshot(spark: SparkSession, root: str, kind: str, snapshot_id: str) -> DataFrame:
    return _rows(spark, root, kind, committed(spark, root, kind).filter(F.col("snapshot_id") == snapshot_id))


def read_latest_snapshot(spark: SparkSession, root: str, kind: str, before: str | None = None) -> DataFrame:
    """The rows of the newest snapshot of each project, by created_at, then id; with ``before`` of those with a smaller id.

    Which one that is the log tells; only its partitions of the data are read.
    """
    entry, entries = F.struct("snapshot_id", "version", "n_rows"), committed(spark, root, kind)
    if before is not None:
        entries = entries.filter(F.col("snapshot_id") < before)
    newest = entries.groupBy("project_id").agg(F.max_by(entry, F.struct("created_at", "snapshot_id")).alias("e"))
    return _rows(spark, root, kind, newest.select("project_id", "e.*"))
