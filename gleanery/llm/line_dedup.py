"""Line deduplication: winnowed fingerprints of line hashes, extended to whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut


def _hash(text: Column) -> Column:
    """The first 60 bits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _runs(lines: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """One row per window: doc_id, text_key, gram, at, hashes, covered.

    A window is the shortest run of lines that has ``min_words`` words, from a given line on or up to a given line:
    ``hashes`` of its lines, and their places (``covered``). A gram is the shortest run with ``gram_words`` words from a line
    on; the least one that lies within a window is the window's fingerprint (``gram``), which begins at its line ``at``
    (from 1).
    """
    doc = Window.partitionBy("doc_id", "text_key")
    ahead_of = lambda n: doc.orderBy("at").rangeBetween(0, n - 1)  # noqa: E731  the lines that begin within so many words
    behind_of = lambda n: doc.orderBy("upto").rangeBetween(1 - n, 0)  # noqa: E731  those that end within so many words before
    lines = lines.withColumn("upto", F.sum("w").over(doc.orderBy("pos"))).withColumn("at", F.col("upto") - F.col("w"))
    joined = lambda run: F.array_join(F.transform(run, lambda x: x.cast("string")), ",")
    begun = ahead_of(gram_words)
    lines = lines.withColumn("until", F.max("upto").over(begun)).withColumn("gram", _hash(joined(F.collect_list("h").over(begun))))
    lines = lines.withColumn("gram", F.when(F.col("until") - F.col("at") >= gram_words, F.col("gram")))
    line = F.struct("pos", "h", "at", "upto", "gram", "until")
    lines = lines.withColumn("ahead", F.collect_list(line).over(ahead_of(min_words))).withColumn(
        "behind", F.collect_list(line).over(behind_of(min_words)),
    )
    ahead = F.when(F.element_at("ahead", -1)["upto"] - F.col("at") >= min_words, F.col("ahead"))
    # One that is too short without its last line is the window from its first line on as well.
    behind = F.when(F.col("at") - F.col("behind")[0]["at"] >= min_words, F.col("behind"))
    windows = lines.select("doc_id", "text_key", F.explode(F.array_compact(F.array(ahead, behind))).alias("run"))
    within = F.filter("run", lambda x: x["gram"].isNotNull() & (x["until"] <= F.element_at("run", -1)["upto"]))
    mark = F.array_min(F.transform(within, lambda x: F.struct(x["gram"].alias("gram"), x["pos"].alias("place"))))
    windows = windows.select(
        "doc_id", "text_key", mark.alias("mark"), F.transform("run", lambda x: x["h"]).alias("hashes"), F.transform("run", lambda x: x["pos"]).alias("covered"),
    )
    return windows.select(
        "doc_id", "text_key", "mark.gram", F.array_position("covered", F.col("mark.place")).cast("int").alias("at"), "hashes", "covered",
    )


def _extended(near: Column, far: Column, at: Column, far_at: Column) -> tuple[Column, Column]:
    """How many lines before, and from, a common fingerprint on equal those around its other place."""

    def equal(a: Column, b: Column) -> Column:
        differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True)
        return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")

    before = lambda hashes, n: F.reverse(F.slice(hashes, F.lit(1), n - 1))
    behind = lambda hashes, n: F.slice(hashes, n, F.size(hashes) - n + 1)
    return equal(before(near, at), before(far, far_at)), equal(behind(near, at), behind(far, far_at))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """One row per line that a repeated run covers: doc_id, text_key, pos (from 0).

    Lines are what line feeds separate, compared without blanks at their ends; lines without words are skipped.

    1. Winnowing: every window of whole lines with ``min_words`` words picks its least gram of half as many words as its
       fingerprint (:func:`_runs`). Equal windows pick the same one, so a repeated window has a fingerprint that stands in
       two places at least; windows of the others are left.
    2. The places of a fingerprint are joined with its first place among those with the same neighbourhood (a hash of the
       window's lines before and from the fingerprint on), not with its very first place, which may share less than a full
       run, and not with each other.
    3. From the fingerprint each match is extended both ways, line by line. Where it reaches both ends of the window, and the window
       doesn't overlap its own first place, the window's lines are a later copy and go.

    Every line of a shared run of ``min_words`` words lies in a window within that run: the one from the line on, the
    one up to it, or the one from the run's first line on. So exactly the lines of runs go that stood before, apart from
    themselves; the first place of a line stays, as each copy points to an earlier one. The work grows with the lines, not with
    the square of a group; joins have one row per key on one side, a written table, so that Spark can split a hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "text_key", "pos", F.btrim("line", F.lit("".join(BLANKS))).alias("line")).filter("line <> ''")
    # Hashes and word counts of the lines, written once: texts are read a single time.
    lines = cut(
        lines.select(
            "doc_id", "text_key", "pos", _hash(F.col("line")).alias("h"),
            F.size(F.split("line", r"[\x20\x09-\x0D]+")).cast("long").alias("w"),
        )
    )
    lines = lines.repartition("doc_id", "text_key").dropDuplicates(["doc_id", "text_key", "pos"])
    windows = _runs(lines, min_words, -(-min_words // 2))
    places = windows.select("doc_id", "text_key", "gram", F.get("covered", F.col("at") - 1).alias("place")).distinct()
    repeated = cut(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    around = F.xxhash64("at", "hashes")
    windows = cut(windows.join(repeated, "gram", "left_semi").withColumn("around", around))
    place = F.struct("doc_id", "text_key", F.get("covered", 0).alias("pos"), F.element_at("covered", -1).alias("last"))
    first = windows.groupBy("gram", "around").agg(F.min(place).alias("first"), F.min_by(F.struct("at", "hashes"), place).alias("other"), F.count(F.lit(1)).alias("n"))
    first = cut(first.filter("n > 1"))
    met = windows.join(first, ["gram", "around"])
    back, ahead = _extended(F.col("hashes"), F.col("other.hashes"), F.col("at"), F.col("other.at"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    later = met.filter((back + ahead == F.size("hashes")) & ~(own & (F.get("covered", 0) <= F.col("first.last"))))
    return later.select("doc_id", "text_key", F.explode("covered").alias("pos")).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (without the repeated lines), n_lines, n_deleted.

    Runs of lines with at least ``min_words`` words that stood before, in a document with a smaller id (then text
    hash) or earlier in the same one without overlapping, are deleted (:func:`repeated_lines`); the first copy always
    stays: of one line repeated for 200 words, the first 50 words stay. A null text
    counts as empty; an empty text has one empty line. Rows that repeat an id and a text are one document and share
    their result. A null id comes first. An empty table gives no rows. Other columns are ignored, whatever their names.
    The lines of a very long text are sorted in one task, which can spill; a window holds ``min_words`` lines at most.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words).groupBy("doc_id", "text_key").agg(F.collect_list("pos").alias("gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).alias("r")
    rows = rows.join(gone.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.text_key") == F.col("g.text_key")), "left")
    lines = F.split("text", "\n")
    return rows.select(
        F.col("r.doc_id").alias("doc_id"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
        ).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )
