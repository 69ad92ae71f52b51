"""Column functions on text that the operators share."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line ends of text files: CR LF, or one of these.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: A word: letters and digits, parts joined by one underscore or hyphen.
WORD = r"[\p{L}\p{N}]+(?:[_-][\p{L}\p{N}]+)*"
TOKEN = r"[\p{L}\p{N}]+"
QUOTED = "`([^`\r\n]+)`|\"([^\"\r\n]+)\"|'([^'\r\n]+)'"
#: Texts whose folding is the lower case with ss for the sharp s: up to U+00FF without the micro sign.
LATIN = "^[\\x00-\\xB4\\xB6-\\xFF]*$"


def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose case folding is not their lower case: to one character, and to several."""
    one, several = {}, []
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.casefold() != c.lower():
            if len(c.casefold()) == 1:
                one[c] = c.casefold()
            else:
                several.append((c.lower() if len(c.lower()) == 1 else c, c.casefold()))
    return "".join(one), "".join(one.values()), sorted(set(several))


ONE_FROM, ONE_TO, SEVERAL = _foldings()
#: Besides the sharp s, the characters that fold to several are rare: one pattern finds texts with any of them.
RARE = "[" + "".join(c for c, _ in SEVERAL if c != "ß") + "]"


def fold(text: Column) -> Column:
    """Case folding (not just lower case) of composed text; Latin texts take the short way."""
    lower = F.lower(text)
    wide = F.replace(F.translate(lower, ONE_FROM, ONE_TO), F.lit("ß"), F.lit("ss"))
    return F.when(text.rlike(LATIN), F.replace(lower, F.lit("ß"), F.lit("ss"))).otherwise(F.when(text.rlike(RARE), _fold_rare(text)).otherwise(wide))


def _fold_rare(text: Column) -> Column:
    out = F.translate(F.lower(text), ONE_FROM, ONE_TO)
    pieces = F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SEVERAL for x in pair)), c), c))
    return F.array_join(pieces, "")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed form; for columns that may hold decomposed characters."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def token_estimate(characters: Column) -> Column:
    """Language-model tokens for a number of characters: 0 for none, else at least 1, 11 for every 40."""
    return F.when(characters == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((characters * 11 + 39) / 40))).cast("long")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def quoted(text: Column) -> Column:
    """Values between backticks or quotes, in their order, without the marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), lambda q: F.substr(q, F.lit(2), F.length(q) - 2))


def identifier_parts(value: Column) -> Column:
    """Folded parts of an identifier: cut at dots, underscores, hyphens, blanks, and where a capital follows a small letter or digit."""
    parts = F.split(value, r"[._\-\s]+|(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})")
    return F.transform(F.filter(parts, lambda p: p != ""), fold)


def first_spellings(values: Column) -> Column:
    """The array without values whose folding came before."""
    folded = F.transform(values, fold)
    return F.filter(values, lambda v, i: F.array_position(folded, fold(v)) == i + 1)


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based identifier of version 5, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    flat = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substring(flat, a, n) for a, n in at))
