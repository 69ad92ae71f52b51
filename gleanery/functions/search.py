"""Which of many phrases are part of which of many texts: an index of tokens and of their grams, and joins on it."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import in_blocks
from .shared import written
from .text import TOKEN, tokens

#: Phrases without any letter or digit that are sent to the texts at a time.
MOST_MARKS = 2_000
#: Letters of a gram; letters up to which a token is its own key; a longer one is cut to pieces that begin so many letters apart.
GRAM, LONG = 4, 64
#: A piece reaches twice as far, so that any part of at most LONG letters lies within one.
_PIECES = rf"(?s)(?=(.{{1,{2 * LONG}}})).{{1,{LONG}}}"
_GRAMS = rf"(?s)(?=(.{{1,{GRAM}}}))."


def token_key(token: Column) -> Column:
    """What stands for a token in tables: itself, or the digest of a long one, which then enters no shuffle."""
    return F.when(F.length(token) <= LONG, token).otherwise(F.concat(F.lit("#"), F.sha2(token, 256)))


def _grams(text: Column) -> Column:
    """The grams of a text by place, shorter ones at its end; the text is passed over once."""
    return F.regexp_extract_all(text, F.lit(_GRAMS), F.lit(1))


@dataclass
class TextIndex:
    """Tables over texts (id, text), written once for a snapshot and used by all searches in it.

    ``occurrences`` (id, n_tokens, token, long) has a row for each token of each text by its key, with the letters of long
    ones; ``vocabulary`` (token, n) each distinct key and how often it occurs; ``grams`` (gram, token, piece) each gram
    of each distinct token with the piece of the token where it stands. All are linear in the texts' length.
    """

    occurrences: DataFrame

    @functools.cached_property
    def vocabulary(self) -> DataFrame:
        return written(self.occurrences.groupBy("token").agg(F.count(F.lit(1)).alias("n")))

    @functools.cached_property
    def grams(self) -> DataFrame:
        short = self.vocabulary.filter(~F.startswith("token", F.lit("#"))).select("token", F.col("token").alias("piece"))
        long = self.occurrences.filter("long is not null").dropDuplicates(["token"])
        pieces = short.unionByName(long.select("token", F.explode(F.regexp_extract_all("long", F.lit(_PIECES), F.lit(1))).alias("piece")))
        return written(pieces.select(F.explode(F.array_distinct(_grams(F.col("piece")))).alias("gram"), "token", "piece"))

    @functools.cached_property
    def gram_counts(self) -> DataFrame:
        return written(self.grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))


def text_index(texts: DataFrame) -> TextIndex:
    """The index of ``texts`` (id, unique; text). Texts are read and cut into tokens once."""
    cut = texts.select("id", tokens(F.col("text")).alias("tokens"))
    each = cut.select("id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("t"))
    return TextIndex(written(each.select("id", "n_tokens", token_key(F.col("t")).alias("token"), F.when(F.length("t") > LONG, F.col("t")).alias("long"))))


def _by_part(index: TextIndex, partial: DataFrame) -> DataFrame:
    """(phrase, token) of ``partial`` (phrase, part) whose part lies within the token (its first ``LONG`` letters do, of longer parts).

    A part's rarest gram leads to the pieces that may hold it, and only these are read; parts shorter than a gram are
    looked up among the beginnings of grams.
    """
    partial = partial.withColumn("part", F.substr("part", F.lit(1), F.lit(LONG)))
    full = partial.filter(F.length("part") >= GRAM).withColumn("all", F.array_distinct(F.filter(_grams(F.col("part")), lambda g: F.length(g) == GRAM)))
    each = full.select("phrase", "part", F.size("all").alias("all"), F.explode("all").alias("gram")).join(index.gram_counts, "gram")
    rarest = each.groupBy("phrase", "part", "all").agg(F.count(F.lit(1)).alias("met"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    rarest = rarest.filter(F.col("met") == F.col("all")).select("phrase", "part", "gram")
    found = index.grams.join(rarest, "gram").filter(F.contains("piece", "part")).select("phrase", "token")
    little = partial.filter(F.length("part") < GRAM).select("phrase", "part")
    lengths = F.broadcast(little.agg(F.collect_set(F.length("part")).alias("lengths")))  # one row, of at most three numbers
    heads = index.grams.select("gram", "token").crossJoin(lengths).select("token", "gram", F.explode("lengths").alias("n")).filter(F.length("gram") >= F.col("n"))
    heads = heads.select("token", F.substr("gram", F.lit(1), F.col("n")).alias("part")).distinct()
    return found.unionByName(heads.join(little, "part").select("phrase", "token"))


def candidates(index: TextIndex, phrases: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, phrase, sure): texts (of ``ids``, if given) that may hold a phrase with a letter or digit; those that are ``sure`` do.

    * A letter or digit run that stands between other characters of the phrase is a whole token of any text with the
      phrase. Of these the rarest is the phrase's key.
    * A phrase without one is keyed by its longest run, which may be a part of a token (:func:`_by_part`).
    """
    runs = tokens(F.col("phrase"))
    opens, closes = (F.col("phrase").rlike(p).cast("int") for p in (f"^{TOKEN}", f"{TOKEN}$"))
    inner = F.array_distinct(F.slice(runs, opens + 1, F.greatest(F.size(runs) - opens - closes, F.lit(0))))
    asked = phrases.select("phrase").distinct().select("phrase", runs.alias("runs"), inner.alias("inner"))
    whole = asked.filter(F.size("inner") > 0).select("phrase", F.size("inner").alias("all"), F.explode("inner").alias("t"))
    whole = whole.select("phrase", "all", token_key(F.col("t")).alias("token")).join(index.vocabulary, "token")
    whole = whole.groupBy("phrase", "all").agg(F.count(F.lit(1)).alias("met"), F.min_by("token", F.struct("n", "token")).alias("token"))
    whole = whole.filter(F.col("met") == F.col("all")).select("phrase", "token")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(F.length(r).alias("n"), r.alias("part"))))["part"]
    partial = asked.filter((F.size("inner") == 0) & (F.size("runs") > 0)).select("phrase", longest.alias("part"))
    # Written, so that Spark knows its size: a small one is sent to the occurrences, which then stay in place.
    keyed = written(whole.unionByName(_by_part(index, partial)).distinct())
    sure = F.col("phrase").rlike(f"^{TOKEN}$") & (F.length("phrase") <= LONG)
    held = index.occurrences.select("id", "token")
    held = held if ids is None else held.join(ids, "id", "left_semi")
    return held.join(keyed, "token").select("id", "phrase").distinct().withColumn("sure", sure)


def verified(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``found`` (id, phrase, sure) whose phrase is in the text (id, text); only texts of unsure ones are read.

    Candidates are written, so that Spark knows their size: few of them are sent to the texts, which then stay in place.
    """
    found = written(found)
    tested = found.filter("not sure").join(texts, "id").filter(F.contains("text", "phrase"))
    return found.filter("sure").unionByName(tested.select(*found.columns)).drop("sure")


def marked_texts(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase) for the phrases without letters and digits that are part of the texts; phrases are sent in blocks."""
    marks = phrases.select("phrase").distinct().filter(~F.col("phrase").rlike(TOKEN))
    return in_blocks(marks, MOST_MARKS, lambda block: texts.join(block, F.contains("text", "phrase"))).select("id", "phrase").distinct()


def containing(texts: DataFrame, phrases: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """(id, phrase) for the ``phrases`` (phrase) that are part of the ``texts`` (id, text), each pair once.

    Both are compared as they are: fold them first. No text meets every phrase; tokens lead to it (:func:`candidates`),
    and the whole phrase is tested where a token doesn't decide. ``index`` is the texts' own, if there is one already.
    A token of any length costs time and memory in proportion to it. Phrases without letters and digits are sent to the
    texts in blocks. Null texts and phrases are in no pair.
    """
    out = verified(candidates(index or text_index(texts), phrases), texts).select("id", "phrase")
    return out.unionByName(marked_texts(texts, phrases))
