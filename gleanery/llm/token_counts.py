"""Token counts per document of flat token files: a vectorised separator scan with a prefix scan over blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import arrow_type, id_type, little_endian, slices, token_ids

#: Tokens of a block.
BLOCK = 1 << 18


def read_token_files(spark: SparkSession, path: str, bits: int = 16, block: int = BLOCK, names: DataFrame | None = None) -> DataFrame:
    """Blocks (file, block, data) of flat files of little-endian unsigned ids, without any index.

    Files are listed with their lengths, not read; each task then reads the byte ranges of its blocks, so a file of any
    size is read by many tasks and no task holds more than a block of it. Empty files have no block. With ``names``
    (column ``file``), only files of these names are read; no bytes of a file are shuffled.
    """
    step = block * bits // 8

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, k, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = FileSystem.from_uri(name)
                with system.open_input_file(inner) as file:
                    data = file.read_at(min(step, length - k * step), k * step)
                yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([k], pa.int64()), "data": pa.array([data], pa.binary())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").filter("length > 0")
    if names is not None:
        files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(names.select("file").distinct(), "file", "left_semi")
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"), "length")
    # A fixed number of tasks: by the size of their rows, which are paths, all blocks would be merged into one.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "path", "block").mapInArrow(ranges, "file string, block long, data binary")


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, ranks: str, pattern: str, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", bits: int = 16,
) -> DataFrame:
    """Flat token files below ``folder``, one for each partition of ``docs``; returns their names (file, part, ordinal, name).

    A file holds the ids of its documents one after the other, each document ended by ``end_id``, and nothing else: no index,
    no lengths. ``name`` is the id of the ordinal-th document of a file, ``part`` the file's name without the attempt.
    Special strings of a text are ordinary text, so ``end_id`` occurs at ends only. A task that is repeated writes a
    file of its own; only files that the returned table names are complete. Files go through ``pyarrow`` to any
    file system that driver and executors share.
    """
    kind = id_type(docs, id_col)
    schema = pa.schema([("file", pa.string()), ("part", pa.string()), ("ordinal", pa.int64()), ("name", arrow_type(kind))])
    system, inner = FileSystem.from_uri(folder)
    system.create_dir(inner)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"part-{TaskContext.get().partitionId():08d}"
        file, out, ordinal = f"{part}-{uuid.uuid4().hex}", None, 0
        system, inner = FileSystem.from_uri(folder)
        try:
            for names, texts in slices(batches):
                out = out or system.open_output_stream(f"{inner}/{file}")
                for ids in token_ids(texts, vocabulary, ranks, pattern, specials=False):
                    out.write(little_endian([*ids, end_id], bits).tobytes())
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n), pa.array([part] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.array(names, schema.field(3).type)], schema=schema,
                )
                ordinal += n
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(write, f"file string, part string, ordinal long, name {kind}"))


def count_documents(spark: SparkSession, names: DataFrame, folder: str, end_id: int = 50256, bits: int = 16, block: int = BLOCK) -> DataFrame:
    """(name, part, ordinal, start, n_tokens, ended) of the documents in the files that :func:`write_token_files` wrote.

    The files are read by byte ranges and searched (:func:`token_counts`); names are joined by file and ordinal
    afterwards. Which file a document is in, and so its ordinal and start, depends on how the input was split.
    """
    blocks = read_token_files(spark, folder, bits, block, names).withColumn("file", F.element_at(F.split("file", "/"), -1))
    return token_counts(blocks, end_id, bits).join(names, ["file", "ordinal"]).select("name", "part", "ordinal", "start", "n_tokens", "ended")


def token_counts(blocks: DataFrame, end_id: int = 50256, bits: int = 16) -> DataFrame:
    """One row per document of each file: file, ordinal (from 0), start, n_tokens, ended (and name, if given).

    Each block is searched on its own, by one vectorised comparison with ``end_id``; a prefix scan over the blocks of
    a file (sums of tokens and of separators, the last separator so far) then gives the place and number of every
    separator, so documents that cross blocks come out whole. The scan sees four numbers of a block, not its positions
    or names, so a file of any size fits its task; these are joined to the positions found, a written table.
    ``n_tokens`` counts the separator. Tokens behind the last separator of a file are a document with ended = false.
    A column ``names`` of ``blocks`` names the documents that end in a block. Blocks may be empty or come in
    any order; no blocks give no rows. A pair of file and block must not repeat. A document of any length counts whole, over
    as many blocks as it takes. Other columns are ignored, whatever their names.
    """
    named = "names" in blocks.columns
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer() if x.is_valid else b"", dtype=f"<u{bits // 8}") for x in batch.column(2)]
            ends = pa.array([np.flatnonzero(x == end_id) + 1 for x in found], schema.field(3).type)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()), ends, *batch.columns[3:],
                ],
                names=[*schema.names, *batch.schema.names[3:]],
            )

    given = blocks.select("file", F.col("block").cast("long").alias("block"), "data", *["names"] * named)
    kind = f", names {id_type(blocks, 'names')}" if named else ""
    scanned = cut(given.mapInArrow(search, f"file string, block long, n long, ends array<long>{kind}"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = scanned.select("file", "block", "n", F.size("ends").alias("found"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("end"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.select(
        "file", "block", "base", F.coalesce(F.max(F.col("base") + F.col("end")).over(before), F.lit(0)).alias("done"),
        F.coalesce(F.sum("found").over(before), F.lit(0)).alias("first"), F.lead("block").over(order).isNull().alias("last"),
    )
    scanned = scanned.join(sums, ["file", "block"])
    stops = F.transform("ends", lambda e: F.col("base") + e)
    starts = F.slice(F.concat(F.array("done"), stops), 1, F.size("ends"))
    rest_from = F.when(F.size("ends") > 0, F.element_at(stops, -1)).otherwise(F.col("done"))
    open_end = F.col("last") & (F.col("base") + F.col("n") > rest_from)
    stops = F.when(open_end, F.concat(stops, F.array(F.col("base") + F.col("n")))).otherwise(stops)
    starts = F.when(open_end, F.concat(starts, F.array(rest_from))).otherwise(starts)
    zipped = F.arrays_zip(starts.alias("start"), stops.alias("stop"), *[F.col("names").alias("name")] * named)
    rows = scanned.select("file", "first", F.size("ends").alias("ended"), F.posexplode(zipped).alias("k", "d"))
    return rows.select(
        "file",
        (F.col("first") + F.col("k")).alias("ordinal"),
        F.col("d.start").alias("start"),
        (F.col("d.stop") - F.col("d.start")).alias("n_tokens"),
        (F.col("k") < F.col("ended")).alias("ended"),
        *[F.col("d.name").alias("name")] * named,
    )
