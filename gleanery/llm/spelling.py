"""Spelling variants: words of a corpus that one inserted, deleted or replaced code point sets apart."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of one side of a tile, and of a bucket that isn't split; cells of a padded matrix.
TILE, BUCKET, CELLS = 512, 2048, 1 << 22


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, rare: int = 199) -> DataFrame:
    """(word, n): how often each word of at least ``least_length`` code points occurs in all texts.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. Where ``rare`` divides h, the crc32 of
    ``<doc_id>:<word>``, its code point h % length (from 0) is deleted first.
    """
    text = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= least_length)
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % rare == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _buckets(words: DataFrame, size: int) -> DataFrame:
    """Rows (short, side, bucket, i, j, block, word, n): words that may be near meet in a row of equal first five columns.

    Of two words whose lengths are ``short``, or ``short`` and one more, a single edit leaves the first ``short / 2`` code points
    equal or the last ones, ``short - short / 2`` of them. So a word goes to four buckets: as the shorter or equal one
    and as the longer one, by its first and by its last code points. Words of a bucket with more than ``size`` rows are dealt to
    blocks, and blocks meet in pairs (i <= j).
    """
    length = F.length("word")
    each = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("short"))
    half = F.floor(F.col("short") / 2).cast("int")
    pieces = F.array(
        F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), half).alias("piece")),
        F.struct(F.lit(1).alias("side"), F.substr("word", length - (F.col("short") - half) + 1).alias("piece")),
    )
    each = each.select("word", "n", "short", F.explode(pieces).alias("p"))
    each = each.select("short", "p.side", F.xxhash64("p.piece").alias("bucket"), "word", "n")
    key = ["short", "side", "bucket"]
    large = each.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min(F.length("word")).alias("least")).filter("rows > 1 and least = short")
    blocks = F.ceil(F.col("rows") / size).cast("int")
    each = each.join(large.select(*key, blocks.alias("blocks")), key)
    each = each.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = each.withColumn("other", other)
    return each.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")


def _matrix(words: list[str], backwards: bool) -> np.ndarray:
    """Code points of the words, one word a row, filled up with zeros; ``backwards`` from the last one on."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(w[::-1] if backwards else w for w in words).encode("utf-32-le"), dtype=np.uint32)
    out = np.zeros((len(words), int(lengths.max())), dtype=np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = codes
    return out.astype(np.uint8) if codes.max(initial=0) < 256 else out


def _common(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each ``wanted`` pair of rows the number of equal leading cells that are filled in both."""
    alive, n = wanted.copy(), np.zeros(wanted.shape, dtype=np.int32)
    for k in range(min(a.shape[1], b.shape[1])):
        alive &= (a[:, k, None] == b[None, :, k]) & (a[:, k] != 0)[:, None]
        if not alive.any():
            break
        n += alive
    return n


class _Tiles:
    """Rows of some buckets, in order, compared tile by tile; per row how many are near, and the best of them."""

    def __init__(self, groups: np.ndarray, short: np.ndarray, side: np.ndarray, apart: np.ndarray, block: np.ndarray, words: list[str], n: np.ndarray):
        self.groups, self.short, self.side, self.apart, self.block = groups, short, side, apart, block
        self.length = np.array([len(w) for w in words])
        self.ahead, self.back = _matrix(words, False), _matrix(words, True)
        # Places of the rows by n (largest first), then word.
        self.order = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])), dtype=np.int64)
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(words))
        self.near, self.best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(words))

    def compare(self, a: slice, b: slice) -> None:
        """Both tiles' rows of the same bucket. The prefix decides which of its two buckets counts a pair."""
        short = self.short[a, None]
        wanted = (self.groups[a, None] == self.groups[None, b]) & (np.minimum(self.length[a, None], self.length[None, b]) == short)
        wanted &= ~self.apart[a, None] | (self.block[a, None] != self.block[None, b])
        if a == b:
            np.fill_diagonal(wanted, False)
        prefix = _common(self.ahead[a], self.ahead[b], wanted)
        wanted &= (prefix >= short // 2) == (self.side[a, None] == 0)
        if not wanted.any():
            return
        suffix = _common(self.back[a], self.back[b], wanted)
        near = wanted & (prefix + suffix >= np.maximum(self.length[a, None], self.length[None, b]) - 1)
        for rows, others, met in ((a, b, near), (b, a, near.T))[: 1 if a == b else 2]:
            self.near[rows] += met.sum(axis=1)
            least = np.where(met, self.place[others], len(self.place)).min(axis=1)
            self.best[rows] = np.minimum(self.best[rows], least)

    def all(self, tile: int) -> None:
        n = len(self.groups)
        for a in range(0, n, tile):
            last = min(a + tile, n) - 1
            for b in range(a, n, tile):
                if self.groups[b] > self.groups[last]:
                    break
                self.compare(slice(a, min(a + tile, n)), slice(b, min(b + tile, n)))


def _near(buckets: DataFrame, tile: int) -> DataFrame:
    """(word, n_near, best): near words of each word within its buckets; a bucket's rows are held together."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    key = ["short", "side", "bucket", "i", "j"]

    def results(table: pa.Table) -> pa.RecordBatch:
        columns = {c: table.column(c).to_numpy() for c in (*key, "block", "n")}
        words = table.column("word").to_pylist()
        changed = np.zeros(len(words), dtype=bool)
        for c in key:
            changed[1:] |= columns[c][1:] != columns[c][:-1]
        tiles = _Tiles(np.cumsum(changed), columns["short"], columns["side"], columns["i"] != columns["j"], columns["block"], words, columns["n"])
        tiles.all(max(8, min(tile, CELLS // (tiles.ahead.shape[1] * tile))))
        found = np.flatnonzero(tiles.near)
        best = tiles.order[tiles.best[found]]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in found], pa.string()), pa.array(tiles.near[found]), pa.array(columns["n"][best], pa.int64()), pa.array([words[k] for k in best], pa.string())],
            schema=schema,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets at a time: rows come in order, and the last bucket of a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ids = [batch.column(c).to_numpy() for c in key]
            differs = np.zeros(batch.num_rows, dtype=bool)
            for c in ids:
                differs |= c != c[-1]
            ends = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if ends or any(held[0].column(c)[0] != batch.column(c)[0] for c in key):
                held[-1] = batch.slice(0, ends)
                yield results(pa.Table.from_batches([b for b in held if b.num_rows]))
                held = [batch.slice(ends)]
        if held:
            yield results(pa.Table.from_batches(held))

    return buckets.mapInArrow(work, "word string, n_near long, best_n long, best string")


def spelling_variants(words: DataFrame, ratio: int = 5, size: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, unique; n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts a word's
    near words. Its form is the near word of largest n (ties: the smallest in code-point order) if that n is at least
    ``ratio`` times the word's own; ``root`` is what forms lead to, from the word on.

    Dense tiling: words that may be near share a bucket (:func:`_buckets`). A bucket's words are rows of padded code-point
    matrices, forwards and backwards; block pairs are compared cell by cell, and a common prefix and suffix that reach
    the longer length less one identify a single edit. A block pair returns a count and the best word for each word,
    never its pairs. A bucket with more than ``size`` words is split into blocks that meet pairwise, each pair a task's
    own group, so no task holds a bucket; the work of one bucket is the square of its distinct words, whatever their n.

    Null words take no part. Words of any length count; tiles of long words are smaller. No words give no rows.
    """
    words = words.filter(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n"))
    buckets = _buckets(words, size)
    key = ("short", "side", "bucket", "i", "j")
    buckets = buckets.repartition(*key).sortWithinPartitions(*key, F.length("word"), "word")
    near = _near(buckets, tile).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best"))
    known = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    known = cut(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.best")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    # n grows by the ratio at each form, so a way to a root has few steps; each round doubles what is covered.
    most = known.agg(F.max("n")).first()[0]
    steps = int(math.log(max(most or 1, 1), max(ratio, 2))) + 1
    roots = cut(known.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(max(1, steps).bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5) -> DataFrame:
    """:func:`spelling_variants` of the words of ``docs`` with at least ``least_length`` code points that occur ``least_n`` times.

    Counts cover all documents and whole texts. A null text has no words, a null id counts as an empty one; repeated
    rows count again. Counts are combined before the shuffle, so a hot word is one row of a task. An empty table gives no
    rows. Other columns are ignored, whatever their names. A very long text is one array of runs in its task.
    """
    return spelling_variants(cut(corpus_words(docs, id_col, text_col, least_length).filter(F.col("n") >= least_n)))
