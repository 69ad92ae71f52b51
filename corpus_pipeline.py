"""A corpus pipeline: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each result as a table in the shared folder and reads it again for the next stage. Further columns of
``documents`` pass through, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.bloom import apart
from gleanery.llm.common import cut, table, without_blanks
from gleanery.llm.exact_dedup import exact_dedup
from gleanery.llm.language_id import in_known_language, learn
from gleanery.llm.near_dedup import near_dedup
from gleanery.llm.packing import pack
from gleanery.llm.secret_scan import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null texts too), or with a language that the model can't tell.

    Repeated rows are judged alike and all stay or go; of equally likely languages the first by name counts. A very long
    text is read whole in its task.
    """
    return in_known_language(docs, learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the one with most code points, then the smallest id (null last).

    Rows with the same id and the same text are one document, and one of them stays, whatever their other columns; null,
    empty and blank texts form a group. A very long text is hashed whole. Only documents of groups with several rows are
    shuffled; further columns may be of any type.
    """
    judged = cut(exact_dedup(docs).filter("group_size > 1").select("doc_id", F.col("text_sha256").alias("sha"), "kept"))
    some, single = apart(docs, F.col("doc_id").cast("string"), judged.select(F.col("doc_id").cast("string").alias("key")))
    text = F.coalesce("text", F.lit(""))
    rows = some.select(F.struct("*").alias("row"), "doc_id", F.sha2(without_blanks(text), 256).alias("own"), F.sha2(text, 256).alias("exact"))
    rows = rows.dropDuplicates(["doc_id", "exact"])
    gone = judged.filter("not kept").select(F.col("doc_id").alias("gone_id"), "sha").distinct()
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("own") == F.col("sha")), "left_anti")
    return rows.select("row.*").unionAll(single)


def _own_key(docs: DataFrame) -> Column:
    """One key for each pair of id and text, in the order of the ids; null where there is no id."""
    whole = dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    # Of whole numbers, sixteen digits with the sign bit turned, which sort as the numbers do.
    order = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if whole else F.col("doc_id").cast("string")
    return F.concat(order, F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Texts that share an id are judged one by one, by their own group; rows that repeat an id and a text share their
    verdict. Null, empty and blank texts and documents without an id are in no group and stay. A very long text is
    shingled whole. Only documents that may go are shuffled.
    """
    keyed = docs.select(_own_key(docs).alias("key"), "text")
    gone = cut(near_dedup(keyed, id_col="key").filter("not kept").select(F.col("doc_id").alias("key")).distinct())
    some, clean = apart(docs, _own_key(docs), gone)
    rows = some.select(F.struct("*").alias("row"), _own_key(docs).alias("key")).join(gone, "key", "left_anti")
    return rows.select("row.*").unionAll(clean)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, null texts too; live-looking secrets are replaced by a mark, and n_chars follows.

    Repeated rows are changed alike; spans that overlap are replaced together. A very long text is scanned whole.
    """
    cleaned = redact_secrets(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every document into pieces of binary length; a null or empty text is one piece, the end id.

    Repeated rows are packed one by one. The ids of a very long text are held in its task, eight bytes each.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("packing", packing)]

#: Neither the language model, nor MinHash candidates, nor token ids can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
