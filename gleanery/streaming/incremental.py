"""An index kept up to date from a stream of file versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shared import written
from ..operators.code import COUNTS, EDGES, SYMBOLS, update_code
from ..operators.index import text_units
from ..operators.scan import content_fingerprint
from ..sources.snapshots import read_latest_snapshot, write_snapshot


def newest_versions(batch: DataFrame) -> DataFrame:
    """The last version of each file in a batch (project_id, path, content, created_at)."""
    last = F.max_by(F.struct("content", "created_at"), F.struct("created_at", F.sha2(F.col("content").cast("binary"), 256))).alias("v")
    return batch.groupBy("project_id", "path").agg(last).select("project_id", "path", "v.*")


def follow_versions(versions: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the units of every new file version below ``root``/units, one snapshot a batch.

    A batch that runs again after a failure replaces its own snapshot, so units are written exactly once.
    """

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        now = newest_versions(batch)
        units = text_units(now).join(
            now.select("project_id", "path", "created_at", content_fingerprint(F.col("content")).alias("content_fingerprint")),
            ["project_id", "path"],
        )
        write_snapshot(units, root, "units", f"batch-{batch_id:09d}")

    return versions.writeStream.foreachBatch(index_batch).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def follow_code(versions: DataFrame, root: str, checkpoint: str, namespace: str, **trigger) -> StreamingQuery:
    """Symbols, resolved edges and suffix counts of Python files that follow a stream of versions (null content: deleted).

    Each batch parses its own files, changes the counts of their suffixes, and resolves fresh edges and those whose
    suffix changed (:func:`gleanery.operators.code.update_code`). The state of the batch's projects is a snapshot below ``root``;
    a batch that runs again starts from the snapshot before it and replaces its own.
    """

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"batch-{batch_id:09d}"
        now = written(newest_versions(batch).withColumn("content", F.col("content").cast("string")))
        projects = now.select("project_id").distinct()

        def state(kind: str, schema: str) -> DataFrame:
            columns = [c.split()[0] for c in schema.split(", ")]
            try:
                return read_latest_snapshot(spark, root, kind, before=name).join(projects, "project_id", "left_semi").select(*columns)
            except AnalysisException:  # nothing was written yet
                return spark.createDataFrame([], schema)

        kinds = {"symbols": SYMBOLS, "edges": EDGES, "counts": COUNTS}
        before = [state(kind, schema) for kind, schema in kinds.items()]
        for kind, rows in zip(kinds, update_code(*before, now, namespace), strict=True):
            write_snapshot(rows.withColumn("created_at", F.lit(batch_id).cast("long")), root, kind, name)

    return versions.writeStream.foreachBatch(index_batch).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def current_units(units: DataFrame) -> DataFrame:
    """The units of the newest version of each file, from all snapshots (:func:`gleanery.sources.snapshots.read_snapshots`)."""
    latest = units.groupBy("project_id", "path").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))
    return units.join(latest, ["project_id", "path", "snapshot_id"], "left_semi")
