"""Packing by power-of-two decomposition: pieces of binary length, each a sequence of its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import arrow_type, id_type, little_endian, slices, token_ids


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: as many of the longest as fit, then falling powers of two."""
    pieces, at = [], 0
    while at < n:
        length = min(longest, 1 << ((n - at).bit_length() - 1))
        pieces.append((at, length))
        at += length
    return pieces


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    pattern: str,
    longest: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    spread: int = 64,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    A document is its token ids and ``end_id``. It is cut into pieces whose lengths are powers of two, at most
    ``longest`` (itself a power of two). Every piece is a sequence: none crosses documents, none needs padding. Tokens
    are cut where the rows are read; the pieces then move to partitions by ``bucket`` (the power), so that sequences of
    equal length lie together for batches. A bucket is spread over ``spread`` partitions, as one may hold most pieces.

    ``sequence_id`` is unique and, as it numbers the rows of each input partition, the same when a lost task runs
    again. Null and empty texts are one piece, the end id. Repeated rows are packed each on its own, ties don't arise. A
    very long text is encoded whole, in memory of its task. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = id_type(docs, id_col)
    fields = [("doc_id", arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in slices(batches):
            columns: list[list] = [[] for _ in schema]
            for name, ids in zip(names, token_ids(texts, vocabulary, ranks, pattern), strict=True):
                flat = little_endian([*ids, end_id])
                pieces = binary_pieces(len(flat), longest)
                columns[0] += [name] * len(pieces)
                columns[1] += [at for at, _ in pieces]
                columns[2] += [n for _, n in pieces]
                columns[3] += [zlib.crc32(flat[at : at + n]) for at, n in pieces]
                columns[4] += [len(flat)] * len(pieces)
                if with_ids:
                    columns[5] += [flat[at : at + n] for at, n in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, out)
    rows = rows.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})
    return rows.repartition("bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(spread))).sortWithinPartitions("bucket", "sequence_id")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes packed sequences (with ids) as one folder per length; large buckets are spread over many files."""
    pieces.write.partitionBy("bucket").parquet(path)
