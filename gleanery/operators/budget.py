"""Greedy selection under several limits at once: skip what doesn't fit and go on."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Limits of a budget; a missing or null one doesn't limit.
LIMITS = ["max_estimated_tokens", "max_characters", "max_bytes", "max_artifacts", "max_excerpts", "max_item_bytes", "max_items"]


def _limit(budgets: DataFrame, name: str) -> Column:
    return (F.col(name) if name in budgets.columns else F.lit(None)).cast("long")


#: What a task has taken: sums of sizes, and counts.
USAGE = ["tokens", "characters", "bytes", "items", "artifacts", "excerpts"]
#: Sizes of items that count against a limit each.
SIZES = {"max_estimated_tokens": "tokens", "max_characters": "characters", "max_bytes": "bytes"}
#: Candidates that are passed over together if not even the least of them fits.
BLOCK = 512


def _fold(batches: Iterator[pa.RecordBatch], start: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Takes candidates in order, task by task: a row for each that is taken, and one (without a candidate) with a task's usage.

    Only one task's sums and artifacts are held. A block of candidates is passed over as a whole where the task's room is
    less than the least of the block in any size, or where no further item is allowed.
    """
    task, used, artifacts, excerpts, rank, out = None, list(start), set(), 0, 0, []
    begun = False

    def usage() -> tuple:
        return (task, None, None, *(u - s for u, s in zip(used, start, strict=True)), rank, len(artifacts), excerpts)

    for batch in batches:
        runs = pc.run_end_encode(batch.column("task_id"))
        numbers = [batch.column(c) for c in (*SIZES.values(), "excerpt")]
        names = [batch.column(c) for c in ("candidate_id", "artifact_id")]
        first = 0
        for this, last in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if not begun or this != task:
                if begun:
                    out.append(usage())
                task, used, artifacts, excerpts, rank, begun = this, list(start), set(), 0, 0, True
            most = {c: batch.column(c)[first].as_py() for c in LIMITS}
            for at in range(first, last, BLOCK):
                n = min(BLOCK, last - at)
                part = [v.slice(at, n) for v in numbers]
                room = [None if most[limit] is None else most[limit] - u for limit, u in zip(SIZES, used, strict=True)]
                least = [pc.min(v).as_py() for v in part[:3]]
                if most["max_items"] is not None and rank >= most["max_items"]:
                    break
                if any(r is not None and (low is None or low > r) for r, low in zip(room, least, strict=True)):
                    continue
                for *sizes, excerpt, candidate, artifact in zip(*(v.to_pylist() for v in part), *(v.slice(at, n).to_pylist() for v in names), strict=True):
                    fits = all(r is None or k is not None and k <= r for k, r in zip(sizes, room, strict=True))
                    fits = fits and (most["max_items"] is None or rank < most["max_items"])
                    known = artifact is None or artifact in artifacts
                    fits = fits and (most["max_artifacts"] is None or known or len(artifacts) < most["max_artifacts"])
                    if fits and (most["max_excerpts"] is None or not excerpt or excerpts < most["max_excerpts"]):
                        used = [u + (k or 0) for u, k in zip(used, sizes, strict=True)]
                        room = [None if r is None else r - k for r, k in zip(room, sizes, strict=True)]
                        excerpts, rank = excerpts + (excerpt or 0), rank + 1
                        if not known:
                            artifacts.add(artifact)
                        out.append((this, candidate, rank, *[None] * len(USAGE)))
            first = last
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        out = []
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(usage(), schema, strict=True)], schema=schema)


def folded(candidates: DataFrame, budgets: DataFrame, reserved: dict[str, int] | None = None) -> DataFrame:
    """(task_id, candidate_id, selected_rank, tokens, ..., excerpts) of candidates that are taken, and a row a task, without a candidate, of its usage.

    Candidates (task_id, pos, candidate_id, artifact_id, bytes, characters, tokens, is_excerpt) are tried by (pos,
    candidate_id); each takes its place if all limits of the task's budget then hold. What is turned away frees nothing and
    ends nothing, so this is a fold, not a running sum. A task's candidates pass by in order, sorted on disk if need be.
    Items larger than the item limit never fit and don't enter the fold. ``reserved`` (tokens, characters, bytes) is taken from the
    start and no usage. A candidate without an artifact counts as none. ``budgets`` has task_id and any of the limits (a few numbers a task); a task without one has no limits. A null size fits
    no limit of its kind. Tasks without candidates have no row.
    """
    reserved = reserved or {}
    limits = budgets.select("task_id", F.struct(*(_limit(budgets, n).alias(n) for n in LIMITS)).alias("limits"))
    rows = candidates.join(limits, "task_id", "left")
    small = F.col("limits.max_item_bytes").isNull() | (F.col("bytes") <= F.col("limits.max_item_bytes"))
    item = F.struct("pos", "candidate_id", "artifact_id", "bytes", "characters", "tokens", F.col("is_excerpt").cast("int").alias("excerpt"))
    rows = rows.filter(small).select("task_id", item.alias("item"), "limits")
    # By an expression of its own: rows dealt by the key of the join above would be left as the join deals them, and a join that
    # Spark turns into a broadcast while it runs no longer holds a task together.
    rows = rows.repartition(F.struct("task_id")).sortWithinPartitions("task_id", "item")
    rows = rows.select("task_id", "item.*", *(F.col(f"limits.{n}").alias(n) for n in LIMITS)).drop("pos")
    kinds = {name: rows.schema[name].dataType for name in ("task_id", "candidate_id")}
    fields = [*(T.StructField(name, kind) for name, kind in kinds.items()), T.StructField("selected_rank", T.IntegerType())]
    schema = T.StructType([*fields, *(T.StructField(name, T.LongType()) for name in USAGE)])
    arrow = to_arrow_schema(schema)
    start = [reserved.get(name, 0) for name in SIZES.values()]
    return rows.mapInArrow(lambda batches: _fold(batches, start, arrow), schema)


def greedy(candidates: DataFrame, budgets: DataFrame, reserved: dict[str, int] | None = None) -> DataFrame:
    """Adds ``fits`` and ``selected_rank`` to the candidates, by :func:`folded`."""
    chosen = folded(candidates, budgets, reserved).filter("candidate_id is not null").select("task_id", "candidate_id", "selected_rank")
    return candidates.join(chosen, ["task_id", "candidate_id"], "left").withColumn("fits", F.col("selected_rank").isNotNull())
