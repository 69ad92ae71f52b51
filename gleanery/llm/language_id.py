"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import slices

#: Buckets of the hashed n-grams, and their lengths in characters.
BITS, ORDERS = 16, (1, 2, 3, 4)
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), dtype=bool, count=sys.maxunicode + 1)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the character n-grams of the lower-cased letters, words set apart by one blank each.

    None for a text without letters.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    found = []
    for order in ORDERS:
        n = len(codes) - order + 1
        if n > 0:
            h = np.full(n, order, dtype=np.uint32)
            for k in range(order):
                h = (h ^ codes[k : k + n]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            found.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(found), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        grams = ngrams(text)
        if grams is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*grams) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    rows: list[tuple[str, str]], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002,
    l2: float = 0.002, rounds: int = 3, seed: int = 7,
) -> Model:
    """A model from (language, text) rows: FTRL-proximal with an elastic net, then a temperature.

    Every fifth row is kept from training; the temperature is the one with which these rows are most likely.
    """
    languages = sorted({lang for lang, _ in rows})
    model = Model(languages, idf, np.zeros((len(idf), len(languages))), np.zeros(len(languages)))
    if not languages:
        return model
    data = [(languages.index(lang), grams) for lang, text in rows if (grams := ngrams(text)) is not None]
    held, data = data[::5], [d for k, d in enumerate(data) if k % 5]
    z, n = np.zeros((len(idf) + 1, len(languages))), np.zeros((len(idf) + 1, len(languages)))

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(data)):
            truth, (at, counts) = data[k]
            x, at = np.append(model.features(at, counts), 1.0), np.append(at, len(idf))
            w = weights(at)
            p = softmax(x @ w)
            p[truth] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    learned = weights(np.arange(len(idf) + 1))
    model.weights, model.bias = learned[:-1], learned[-1]
    if held:
        logits, truth = np.array([model.logits(*grams) for _, grams in held]), np.array([t for t, _ in held])
        # So few rows can't show a certainty of more than 1 - 1 / (n + 2): the others share the rest.
        target = np.full(logits.shape, 1 / (len(truth) + 2) / max(1, len(languages) - 1))
        target[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
        loss = lambda t: -(target * np.log(softmax(logits / t) + 1e-12)).sum()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 600,
    most_languages: int = 200,
) -> Model:
    """A model of the rows with a language whose crc32(id) mod 4 is not 2.

    Document frequencies count all of these rows; each partition sends a count per bucket. The regression is
    fitted on the driver to a sample of about ``sample`` rows of each language, those with the least hashes, so its size is
    bound whatever the table's. The weights of a language take 1.5 MB there, so at most ``most_languages`` are learnt,
    the most frequent ones (ties by name); rarer ones are never predicted unless the limit is raised.
    """
    rows = docs.filter((remainder(id_col) != 2) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(F.lit("sample"), F.col(id_col)).alias("h"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, dtype=np.int64)
        for _, texts in slices(batches):
            for text in texts:
                if (grams := ngrams(text)) is not None:
                    total[grams[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    per_language = {
        r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    }
    frequency = np.zeros(1 << BITS)
    for r in rows.select("h", "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(per_language.values())) / (1 + frequency)) + 1
    if not per_language:
        return fit([], idf)
    share = F.create_map(*(F.lit(v) for lang, n in per_language.items() for v in (lang, min(1.0, sample / n))))[F.col("lang")]
    chosen = rows.filter((F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)
    picked = chosen.orderBy("h", "lang", "text").limit(2 * sample * len(per_language)).select("lang", "text").collect()
    return fit([(r["lang"], r["text"]) for r in picked], idf)


def predictor(spark: SparkSession, model: Model):
    """A column function: text to struct (lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        said = [shared.value.predict(t or "") for t in texts]
        return pd.DataFrame({"lang": [s[0] for s in said], "score": [s[1] for s in said]}, columns=["lang", "score"])

    return predict


def identify_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Only the text decides. ``lang_pred`` is the likeliest language of the model and ``score`` its calibrated probability;
    a text that is null or has no letter gets ``und`` and 0, as does every text where the model knows no language.
    ``held_out`` says that crc32(id) mod 4 is 2 (false for a null id), so the model never saw the row. Repeated rows
    are judged alike; of equally likely languages the first by name wins. A very long text is read whole, some 20 bytes a
    character in its task. An empty table gives no rows. Other columns are ignored, whatever their names. No shuffle.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    rows = rows.withColumn("said", predictor(docs.sparkSession, model)("text"))
    return rows.select("doc_id", "held_out", F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"))


def in_known_language(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least_score``, all columns as they are.

    What goes has no letter (or a null text), or resembles no language more than the others.
    """
    said = predictor(docs.sparkSession, model)(F.col(text_col))
    rows = docs.select(F.struct("*").alias("row"), said.alias("said"))
    return rows.filter((F.col("said.lang") != UNKNOWN) & (F.col("said.score") >= least_score)).select("row.*")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 600) -> DataFrame:
    """:func:`learn` from the labelled rows of ``docs`` and :func:`identify_language` of all of them."""
    return identify_language(docs, learn(docs, id_col, text_col, lang_col, sample), id_col, text_col)
