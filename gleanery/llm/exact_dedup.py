"""Exact deduplication by content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import apart
from .common import cut, without_blanks


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after the six blanks (space, U+0009 to U+000D) are deleted. A group
    is keyed by the 128-bit MD5 of that normal form *and* by its bytes, so a collision of the hash gives two
    groups. Of a group the row with the most code points in its original text stays, then the smallest id
    (a null id comes last).

    1. Every text is normalised and hashed once, into a table without texts; hashes are counted there.
    2. Only texts whose hash repeats are read again (a Bloom filter of their ids drops nearly all others before the
       shuffle) and grouped by hash and bytes. Equal texts of one input partition collapse before it, so a group
       that holds a third of the rows costs one row per task.
    3. Every row looks up its group by MD5 and SHA-256, without text; Spark splits a hot group there, as one side is
       a written table with one row per group.

    Null and empty texts and texts of blanks only form one group. Rows that repeat an id and a text share their
    result: each of them has kept = true if the id is the group's keep_id. An empty table gives no rows. A very long
    text is one value of a row, hashed whole. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    norm = lambda df: df.select(
        "doc_id", F.length("raw").alias("points"), without_blanks(F.col("raw")).alias("norm"),
    ).withColumn("hash", F.unhex(F.md5("norm")))
    members = cut(norm(rows).select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256")))
    repeated = cut(members.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    again = cut(members.join(repeated, "hash", "left_semi").select(F.col("doc_id").cast("string").alias("key")))
    texts = norm(apart(rows, F.col("doc_id").cast("string"), again)[0]).join(repeated, "hash", "left_semi")
    groups = texts.groupBy("hash", "norm").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min_by("doc_id", F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id")).alias("keep_id"),
    )
    groups = cut(groups.select("hash", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id"))
    found = members.join(groups, ["hash", "text_sha256"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce(
            "group_size", F.lit(1).cast("long"),
        ).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256"
    )
