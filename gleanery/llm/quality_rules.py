"""Quality rules: counts of a text, and a linear-chain random field that marks its lines as content or boilerplate."""

from __future__ import annotations

import functools
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS
from .tokens import arrow_type, id_type, slices

#: Words of a window, and what counts as a symbol.
WINDOW, SYMBOLS = 8, "#*$%&|<>"
_WORD, _BLANKS = re.compile(r"[^\x20\x09-\x0D]+"), "".join(BLANKS)
#: Steps at which a share, and a number of words, raise one more bit of a line.
SHARES, LENGTHS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7), (2, 4, 8, 16, 32, 64)
#: Bits of a line: its shares, its length, flags, and one that is always set.
N_SHARES = 7
BITS = N_SHARES * len(SHARES) + len(LENGTHS) + 4
#: Lines that a training sequence is cut to; characters of lines that are described together.
SEGMENT, BLOCK = 16, 1 << 20


@dataclass
class Measured:
    """Counts of a text; ``sizes`` (words) and ``bits`` of each of its lines that have a word."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    sizes: np.ndarray
    bits: np.ndarray

    @property
    def failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def repeated_words(ids: np.ndarray) -> np.ndarray:
    """Which words stand in a window of ``WINDOW`` words that the text holds twice or more.

    Windows are numbered exactly: equal pairs of words get one number, then equal pairs of pairs, and so on.
    """
    marked = np.zeros(len(ids), dtype=bool)
    if len(ids) <= WINDOW:
        return marked
    width = 1
    while width < WINDOW:
        pairs = ids[:-width] * np.int64(ids.max() + 1) + ids[width:]
        ids, width = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * width
    starts = np.flatnonzero((np.bincount(ids) > 1)[ids])
    edges = np.bincount(starts, minlength=len(marked) + 1) - np.bincount(starts + WINDOW, minlength=len(marked) + 1)
    return np.cumsum(edges[: len(marked)]) > 0


def measure(texts: Iterable[str]) -> Iterator[Measured]:
    """Counts and line bits of each text, taken together up to ``BLOCK`` characters; a longer text stands alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > BLOCK:
            yield from _measured(group)
            group, size = [], 0
        group.append(text)
        size += len(text)
    yield from _measured(group)


def _measured(texts: list[str]) -> Iterator[Measured]:
    """Words are numbered by the place where the text has them first, so no number belongs to two texts: a window that
    crosses from one text into the next is found once only.
    """
    ids, rows, lines, ends, copies = array("q"), [], [], [], []
    waiting = 0
    for text in texts:
        numbers: dict[str, int] = {}
        seen: set[str] = set()
        copied = kept = 0
        for line in text.split("\n"):
            words = _WORD.findall(line)
            if words:
                copy = line in seen
                seen.add(line)
                copied, kept = copied + copy, kept + 1
                ids.extend(map(numbers.setdefault, words, count(len(ids))))
                lines.append((line, len(words), len(set(words)), copy))
                waiting += len(line)
                if waiting > BLOCK:
                    rows.append(_described(lines))
                    lines, waiting = [], 0
        ends.append(kept)
        copies.append(copied)
    if lines:
        rows.append(_described(lines))
    if not rows:
        yield from (Measured(0, 0, sum(map(t.count, SYMBOLS)), 0, 0, np.zeros(0, np.int64), np.zeros((0, BITS), bool)) for t in texts)
        return
    number = np.frombuffer(ids, dtype=np.int64)
    marked = repeated_words(number)
    sizes, chars, found = (np.concatenate(part) for part in zip(*rows, strict=True))
    upto = np.concatenate(([0], np.cumsum(sizes)))
    same = np.concatenate(([0, 0], np.cumsum(number[1:] == number[:-1])))  # words equal to the one before, up to a place
    within = (same[upto[1:]] - same[upto[:-1] + 1]) / sizes
    total = np.concatenate(([0], np.cumsum(marked)))
    repeated = total[upto[1:]] - total[upto[:-1]]
    shares = np.concatenate((found[:, : N_SHARES - 1], within[:, None]), axis=1)
    steps = (shares[:, :, None] > np.array(SHARES)).reshape(len(sizes), -1)
    flags = np.stack([found[:, -2] > 0, found[:, -1] > 0, 2 * repeated > sizes, np.ones(len(sizes), bool)], axis=1)
    bits = np.concatenate((steps, sizes[:, None] >= np.array(LENGTHS), flags), axis=1)
    at = 0
    for text, n, copied in zip(texts, ends, copies, strict=True):
        own = slice(at, at + n)
        at += n
        yield Measured(
            int(sizes[own].sum()), int(chars[own].sum()), sum(map(text.count, SYMBOLS)), copied, int(repeated[own].sum()), sizes[own], bits[own],
        )


@functools.cache
def _kinds() -> np.ndarray:
    """A byte of marks for each code point: blank, upper case, lower case, letter or digit, symbol, exclamation, end of a sentence.

    Those above U+1FFFF count as letters.
    """
    kinds = np.full(sys.maxunicode + 1, 1 << 3, dtype=np.uint8)
    every = list(map(chr, range(0x20000)))
    tests = (_BLANKS.__contains__, str.isupper, str.islower, str.isalnum, SYMBOLS.__contains__, "!".__eq__, ".!?:;\"'".__contains__)
    kinds[: len(every)] = sum((np.fromiter(map(t, every), dtype=bool, count=len(every)).astype(np.uint8) << k) for k, t in enumerate(tests))
    return kinds


def _described(lines: list[tuple[str, int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their characters, and features of lines (line, words, distinct words, is it a copy) that have words."""
    codes = np.frombuffer("\n".join(r[0] for r in lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _kinds()[codes]
    starts = np.cumsum([0, *(len(r[0]) + 1 for r in lines[:-1])])
    n = np.array([r[1] for r in lines], dtype=np.int64)
    inside = (kinds & 1) == 0
    words = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))  # the first word of each line
    by_line = lambda bit: np.add.reduceat(kinds >> bit & 1, starts, dtype=np.int64)
    by_word = lambda bit: np.add.reduceat(kinds >> bit & 1, words, dtype=np.int64)
    share = lambda held: np.add.reduceat(held, first, dtype=np.int64) / n
    sizes = np.add.reduceat(inside, words, dtype=np.int64)
    chars, symbols = np.add.reduceat(inside, starts, dtype=np.int64), by_line(4)
    last = kinds[np.append(words[first[1:] - 1], words[-1]) + np.append(sizes[first[1:] - 1], sizes[-1]) - 1]
    features = np.stack(
        [
            symbols / chars, share((by_word(1) > 0) & (by_word(2) == 0)), 1 - np.array([r[2] for r in lines]) / n, share(by_word(3) == 0),
            by_line(5) / n, share(sizes < 4), last >> 6 & 1, np.array([r[3] for r in lines], dtype=float),
        ],
        axis=1,
    )
    return n, chars, features


@dataclass
class LineModel:
    """A linear-chain random field over lines with the labels 0 (content) and 1 (boilerplate)."""

    weights: np.ndarray  # of a line's bits, for boilerplate
    moves: np.ndarray  # from a label to the next
    trained: bool = True

    def label(self, bits: np.ndarray) -> np.ndarray:
        """The likeliest labels of a text's lines (Viterbi). Of equal paths, content wins."""
        if not self.trained or not len(bits):
            return np.zeros(len(bits), dtype=bool)
        (stay, leave), (enter, remain) = self.moves.tolist()
        content, other, back = 0.0, 0.0, bytearray()
        for gain in (bits @ self.weights).tolist():
            to_content, to_other = content + stay, content + leave
            from_other, kept_other = other + enter, other + remain
            if not back:  # the first line has no line before it
                to_content = to_other = from_other = kept_other = 0.0
            back.append((from_other > to_content) + 2 * (kept_other > to_other))
            content, other = max(to_content, from_other), max(to_other, kept_other) + gain
        state, labels = int(other > content), np.zeros(len(bits), dtype=bool)
        for k in range(len(bits) - 1, -1, -1):
            labels[k] = state
            state = back[k] >> state & 1
        return labels


def _expected(gain: np.ndarray, held: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of boilerplate of each line, and expected moves, of padded sequences (scaled forward and backward sums).

    Arrays are laid out by step, sequence and label; steps behind a sequence's end repeat its last state.
    """
    gain, held = gain.T, held.T[:, :, None]
    emit = np.stack([np.ones_like(gain), np.exp(np.clip(gain, -50, 50))], axis=2)
    step = np.exp(moves)
    ahead, behind = np.empty(emit.shape), np.ones(emit.shape)
    ahead[0] = emit[0] / emit[0].sum(axis=1, keepdims=True)
    for t in range(1, len(gain)):
        came = (ahead[t - 1] @ step) * emit[t]
        ahead[t] = np.where(held[t], came / came.sum(axis=1, keepdims=True), ahead[t - 1])
    for t in range(len(gain) - 2, -1, -1):
        back = (emit[t + 1] * behind[t + 1]) @ step.T
        behind[t] = np.where(held[t + 1], back / back.sum(axis=1, keepdims=True), 1.0)
    chance = ahead * behind
    chance = chance[:, :, 1] / chance.sum(axis=2)
    both = ahead[:-1, :, :, None] * step * (emit[1:] * behind[1:])[:, :, None, :]
    both *= held[1:, :, :, None] / both.sum(axis=(2, 3), keepdims=True)
    return chance.T, both.sum(axis=(0, 1))


def fit(rows: list[tuple[bool, np.ndarray]], rounds: int = 2, steps: int = 60, rate: float = 0.15, decay: float = 0.01) -> LineModel:
    """A model from (is the text poor, bits of its lines).

    Labels of lines are not given. All lines of good texts count as content. In the first round all lines of poor ones
    count as boilerplate; then those that their own bits show as content become content, unless that were all of the
    sequence. The likelihood is raised by its gradient, scaled per weight by the squares seen; ``decay`` shrinks weights.
    Without texts of both kinds the model marks nothing.
    """
    model, first_rate = LineModel(np.zeros(BITS), np.zeros((2, 2)), trained=len({poor for poor, _ in rows}) == 2), rate
    if not model.trained:
        return model
    cut = [(poor, bits[at : at + SEGMENT]) for poor, bits in rows for at in range(0, len(bits), SEGMENT)]
    held = np.array([[t < len(bits) for t in range(SEGMENT)] for _, bits in cut])
    x = np.zeros((len(cut), SEGMENT, BITS))
    for k, (_, bits) in enumerate(cut):
        x[k, : len(bits)] = bits
    lines = x[held]
    truth = held & np.array([poor for poor, _ in cut])[:, None]
    both = held[:, 1:]
    for turn in range(rounds):
        if turn:
            for k, (poor, bits) in enumerate(cut):
                if poor and (found := bits @ model.weights > 0).any():
                    truth[k, : len(bits)] = found
        seen = np.stack([[(both & (truth[:, :-1] == a) & (truth[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        squares, squares_moves = np.full(BITS, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(steps):
            gain = np.zeros(held.shape)
            gain[held] = lines @ model.weights
            chance, moved = _expected(gain, held, model.moves)
            slope = (truth[held] - chance[held]) @ lines / len(lines) - decay * model.weights / np.sqrt(len(lines))
            slope_moves = (seen - moved) / len(lines) - decay * model.moves / np.sqrt(len(lines))
            squares, squares_moves = 0.9 * squares + 0.1 * slope**2, 0.9 * squares_moves + 0.1 * slope_moves**2
            model.weights = model.weights + rate * slope / np.sqrt(squares)
            model.moves = model.moves + rate * slope_moves / np.sqrt(squares_moves)
            rate *= 0.97
        rate = first_rate
    return model


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 1500,
    most_lines: int = 200,
) -> LineModel:
    """A model of texts labelled good (1) or poor (0), read from rows of ``labels`` whose crc32(id) mod 4 is not 2.

    Bounds of the sample: about ``sample`` ids of each label, those with the least hashes, at most twice as many; texts of at most
    ``most_lines`` lines. Their lines go to the driver as bits, some ten bytes each. Nothing else is bounded.
    """
    said = F.col(label_col).cast("int")
    usable = labels.filter(said.isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2)).select(
        F.col(id_col).alias("id"), (said == 0).alias("poor"), F.xxhash64(F.lit("lines"), F.col(id_col)).alias("h"),
    )
    n = {r["poor"]: r["n"] for r in usable.groupBy("poor").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("poor"), min(1.0, sample / n.get(True, 1))).otherwise(min(1.0, sample / n.get(False, 1)))
    chosen = usable.filter(F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20)) < share).orderBy("h").limit(4 * sample)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.length(text) - F.length(F.replace(text, F.lit("\n"))) < most_lines)
    rows = rows.join(F.broadcast(chosen.select("id", "poor", "h")), "id").select("h", "poor", "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.packbits(m.bits, axis=1).tobytes() for m in measure(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("poor"), pa.array(found, pa.binary())], names=["h", "poor", "bits"])

    width = -(-BITS // 8)
    picked = rows.mapInArrow(lines, "h long, poor boolean, bits binary").orderBy("h", "bits").limit(4 * sample).collect()
    unpacked = [(r["poor"], np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8).reshape(-1, width), axis=1)[:, :BITS]) for r in picked]
    return fit([(poor, bits.astype(np.float64)) for poor, bits in unpacked if len(bits)])


def judge(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_content_words, kept.

    Words are what blanks (space, U+0009 to U+000D) separate. ``n_dup_lines`` counts lines with a word that equal an earlier
    one; ``n_repeat_words`` words in windows of eight that the text holds twice or more. ``base_failed``: fewer than 20
    words, or more than 30 % of them repeated. The model marks each line with a word (``n_lines``) as content or boilerplate;
    a text is kept if it doesn't fail and at least ``least_share`` of its words are in content lines.

    A null or empty text has no words and fails. Repeated rows are judged alike, each with a row; an equally likely
    boilerplate and content path counts as content. A very long text is read whole in its task, with its distinct words
    and lines held beside it. A null id stays null. An empty table gives no rows. Other columns are ignored, whatever
    their names or types. No shuffle.
    """
    kind = id_type(docs, id_col)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_content_words", "kept")
    types = {n: pa.bool_() if n in ("base_failed", "kept") else pa.int64() for n in names}
    schema = pa.schema([("doc_id", arrow_type(kind)), *types.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            out = []
            for m in measure(texts):
                good = int(m.sizes[~shared.value.label(m.bits)].sum())
                kept = not m.failed and good >= least_share * m.n_words
                out.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.failed, len(m.sizes), good, kept))
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema[0].type), *(pa.array([r[k] for r in out], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)

    fields = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in types.items())
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, {fields}")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`learn` from the labelled texts and :func:`judge` all of them."""
    return judge(docs, learn(docs, labels, id_col, text_col), id_col, text_col)
