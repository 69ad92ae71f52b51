"""Byte-level BPE by segment trees over byte positions; encoding of texts and decoding of ids."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import arrow_type, id_type, read_ranks, slices

#: A leaf without a pair that can merge.
NONE = np.int64(1) << 62
#: Words that a worker remembers.
REMEMBERED = 600_000
#: Characters of the longest word whose ids are remembered behind its batch.
LONGEST = 64
#: Trees of words up to so many bytes are merged side by side.
SIDE_BY_SIDE = 256


class Merges:
    """Which pairs of tokens merge, and into what. The rank of a merge is the id of its result."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {
            ranks[token[:k]] << 32 | ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        self.pairs = pairs
        # An open table: a pair lies in one of the slots from its hash on.
        self.bits = max(10, (2 * len(pairs)).bit_length() + 1)
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.values = np.zeros(len(self.keys), dtype=np.int64)
        self.reach = 1
        for key, rank in pairs.items():
            slot = at = self._slot(key)
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.values[slot] = key, rank
            self.reach = max(self.reach, slot - at + 1)

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)

    def of(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves (rank, place) of pairs; NONE where a pair doesn't merge."""
        key = left << 32 | right
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)
        out = np.where(self.keys[slot] == key, self.values[slot] << 32 | at, NONE)
        rest = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        for step in range(1, self.reach):
            if not len(rest):
                break
            s = slot[rest] + step
            hit = self.keys[s] == key[rest]
            out[rest[hit]] = self.values[s[hit]] << 32 | at[rest[hit]]
            rest = rest[~hit & (self.keys[s] >= 0)]
        return out


def merge_side_by_side(words: list[bytes], merges: Merges, width: int) -> list[list[int]]:
    """Ids of words of at most ``width`` (a power of two) bytes, one segment tree a word, all trees step by step.

    The leaf of a byte position holds rank and place of the pair of the token that starts there and the next one; an
    inner node holds the least of its two, so the root is the leftmost pair of the lowest rank. A merge changes
    three leaves (the pair itself, the one swallowed, the one before) and the nodes above them.
    """
    n = len(words)
    lengths = np.array([len(w) for w in words])
    raw = np.zeros((n, width), dtype=np.uint8)
    raw[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    stride = width + 1  # one more place on either side takes writes past the ends
    token = np.zeros((n, stride), dtype=np.int64)
    token[:, :width] = merges.bytes[raw]
    token[np.arange(stride) >= lengths[:, None]] = -1
    after = np.tile(np.minimum(np.arange(1, stride + 1), width), (n, 1))
    after = np.where(after >= lengths[:, None], width, after)
    before = np.tile(np.arange(-1, width), (n, 1))
    tree = np.full((n, 2 * width), NONE)
    if width > 1:
        place = np.broadcast_to(np.arange(width - 1), (n, width - 1))
        ok = token[:, 1:width] >= 0
        tree[:, width : 2 * width - 1][ok] = merges.of(token[:, : width - 1][ok], token[:, 1:width][ok], np.ascontiguousarray(place[ok]))
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    tree_, token_, after_, before_ = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        best = tree_[live * (2 * width) + 1]
        at, merged = best & 0xFFFFFFFF, best >> 32
        row = live * stride
        swallowed = after_[row + at]
        behind = after_[row + swallowed]
        ahead = before_[row + at]
        token_[row + at] = merged
        token_[row + swallowed] = -1
        after_[row + at] = behind
        before_[row + behind] = at
        leaf = live * (2 * width) + width
        tree_[leaf + swallowed] = NONE
        right = np.flatnonzero(behind < width)
        new = np.full(len(live), NONE)
        new[right] = merges.of(merged[right], token_[row[right] + behind[right]], at[right])
        tree_[leaf + at] = new
        left = np.flatnonzero(ahead >= 0)
        tree_[leaf[left] + ahead[left]] = merges.of(token_[row[left] + ahead[left]], merged[left], ahead[left])
        up, ups = [at + width, swallowed + width, np.where(ahead >= 0, ahead, at) + width], live * (2 * width)
        while up[0][0] > 1:
            up = [u >> 1 for u in up]
            for u in up:
                tree_[ups + u] = np.minimum(tree_[ups + 2 * u], tree_[ups + 2 * u + 1])
        live = live[tree_[live * (2 * width) + 1] < NONE]
    kept = token >= 0
    flat, counts = token[kept].tolist(), kept.sum(axis=1).tolist()
    out, start = [], 0
    for c in counts:
        out.append(flat[start : start + c])
        start += c
    return out


def merge_one(word: bytes, merges: Merges) -> list[int]:
    """Ids of one word of any length, by the same tree in plain Python: O(n log n)."""
    n, pairs, none = len(word), merges.pairs, int(NONE)
    width = 1 << max(1, (n - 1).bit_length())
    token = [int(merges.bytes[b]) for b in word]
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    tree = [none] * (2 * width)

    def pair(i: int) -> int:
        j = after[i]
        rank = pairs.get(token[i] << 32 | token[j]) if j >= 0 else None
        return none if rank is None else rank << 32 | i

    tree[width : width + n] = [pair(i) for i in range(n)]
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, leaf: int) -> None:
        i += width
        tree[i] = leaf
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                return
            tree[i] = low

    while tree[1] < none:
        at, merged = tree[1] & 0xFFFFFFFF, tree[1] >> 32
        swallowed = after[at]
        token[at], token[swallowed], after[at] = merged, -1, after[swallowed]
        if after[at] >= 0:
            before[after[at]] = at
        put(swallowed, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    return [t for t in token if t >= 0]


class Words(dict):
    """Ids of words met so far. A new word gets an empty list, to be filled, and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> list[int]:
        self.new.append(word)
        self[word] = ids = []
        return ids


class ByteBpe:
    """Encodes and decodes with the ranks of a file and the pattern that splits texts before the merges."""

    def __init__(self, ranks: str, pattern: str):
        import regex

        self.merges = Merges(read_ranks(ranks))
        self.words = regex.compile(pattern).findall
        self.known = Words()
        self.numbers = list(range(len(self.merges.tokens)))  # one object for each id

    def learn(self) -> None:
        """Merges the new words; a word that is a token itself is that token."""
        ranks, numbers, known, classes = self.merges.ranks, self.numbers, self.known, {}
        for word in known.new:
            raw = word.encode("utf-8", "surrogatepass")
            whole = ranks.get(raw)
            if whole is not None:
                known[word].append(numbers[whole])
            elif len(raw) <= SIDE_BY_SIDE:
                classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((word, raw))
            else:
                known[word] += merge_one(raw, self.merges)
        for width, some in classes.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                for (word, _), ids in zip(part, merge_side_by_side([raw for _, raw in part], self.merges, width), strict=True):
                    known[word] += map(numbers.__getitem__, ids)
        known.new.clear()

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known.__getitem__
        parts = [list(map(known, self.words(t))) for t in texts]
        long = [word for word in self.known.new if len(word) > LONGEST]
        self.learn()
        for word in long:  # seldom seen again, and of any length
            del self.known[word]
        return [list(chain.from_iterable(p)) for p in parts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


@functools.cache
def byte_bpe(ranks: str, pattern: str) -> ByteBpe:
    """One for each worker, with the words that it remembers."""
    return ByteBpe(ranks, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    ``ids_sha256`` is the digest of the decimal ids joined by a space, ``decoded_sha256`` that of the bytes that the ids
    decode to: the digest of the text itself, as byte-level BPE loses nothing. Every match of ``pattern`` is encoded
    separately; special tokens have no meaning. Rows are encoded where they are read, without a shuffle; a worker
    remembers the ids of at most ``REMEMBERED`` words, none of more than ``LONGEST`` characters. A word of n bytes takes O(n log n).

    Null and empty texts have no ids. Repeated rows are encoded each on its own. Of equal ranks the leftmost pair merges
    first. A very long text is encoded whole, in memory of its task. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    kind = id_type(docs, id_col)
    fields = [("doc_id", arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema([*fields, *[("ids", pa.list_(pa.int32()))] * with_ids])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        decimal = [str(i) for i in range(len(bpe.merges.tokens))]
        for names, texts in slices(batches):
            all_ids = bpe.encode(texts)
            ids_sha = [hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest() for ids in all_ids]
            decoded = [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in all_ids]
            columns = [names, [len(ids) for ids in all_ids], ids_sha, decoded, *[all_ids] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, out)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; bytes that are not UTF-8 become the replacement character, null ids null."""
    kind = id_type(encoded, id_col)
    schema = pa.schema([("doc_id", arrow_type(kind)), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decode, f"doc_id {kind}, text string")
