"""Token ids of whole texts by a public byte-level vocabulary. Paths of the vocabulary files are parameters."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are turned into Python objects at a time.
SLICE = 128


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def _library(vocabulary: str, ranks: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    plain = Tokenizer.from_file(vocabulary)
    plain.encode_special_tokens = True
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
    return whole, plain, fast, special


def token_ids(texts: list[str], vocabulary: str, ranks: str, pattern: str, specials: bool = True) -> list[list[int]]:
    """Ids as the tokenizers library gives for ``vocabulary`` without adding special tokens.

    ``ranks`` holds the same vocabulary for the faster tiktoken, which encodes every text without the string of a
    special token. Where such a string occurs, tokenizers does the work: with ``specials`` the string becomes its
    token, otherwise it is ordinary text.
    """
    whole, plain, fast, special = _library(vocabulary, ranks, pattern)
    slow = whole if specials else plain
    return [
        slow.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts
    ]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a few rows at a time; a null text is empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def id_type(df, column: str) -> str:
    return dict(df.dtypes)[column]


def arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of an id column."""
    known = {
        "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(),
        "binary": pa.binary(), "date": pa.date32(),
    }
    if kind not in known:
        raise TypeError(f"ids of type {kind} are not supported: cast them to string")
    return known[kind]


def little_endian(ids: list[int], bits: int = 32) -> np.ndarray:
    return np.asarray(ids, dtype=f"<u{bits // 8}")
