"""Near-duplicate documents: SetSketch registers in bands, a likelihood estimate, and exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, may_contain, sized
from .common import cut
from .graph import components
from .tokens import arrow_type, id_type, slices

#: Bands and registers of a band; the base of the registers' spacing and their highest value.
BANDS, ROWS, BASE, TOP = 48, 8, 1.2, 254
#: Hubs of a round that a class is compared with.
HUBS = 4
#: Size bands of the prefix join grow by this factor.
BAND = 1.05
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes; powers of the hash base are kept between texts."""

    def __init__(self, words: int):
        self.words = words
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        raw = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        if len(raw) + 1 > len(self.up):
            self.up, self.down = _powers(_PRIME, 2 * len(raw) + 2), _powers(_INVERSE, 2 * len(raw) + 2)
        blank = np.concatenate(([True], BLANK[raw], [True]))
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        start, stop = edges[::2], edges[1::2]
        if not len(start):
            return np.zeros(0, dtype=np.uint64)
        # The hash of a word: its bytes times the powers of the base from the word's start on, by prefix sums.
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])))
        word = mix((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))
        k = min(self.words, len(word))
        out = np.zeros(len(word) - k + 1, dtype=np.uint64)
        for i in range(k):
            out = mix(out + np.uint64(k)) + word[i : len(word) - k + 1 + i]
        return np.unique(mix(out))


def set_hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def registers(hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of several sets (slices of ``hashes``), a row of ``m`` bytes for each.

    The sketch value of an element for a register is exponential, from a hash with 32 random bits; the register
    keeps the least of a set as 1 - log to the base BASE, cut to 0 .. TOP. So registers of a union are the larger
    ones, and their spacing is exponential.
    """
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    keys = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(_PRIME)).astype(np.uint32)
    most = np.empty((m, len(starts)), dtype=np.uint32)
    x, t = np.empty_like(low), np.empty_like(low)
    for i in range(m):
        np.bitwise_xor(low, keys[2 * i], out=x)
        np.multiply(x, keys[2 * i + 1] | np.uint32(1), out=x)
        np.add(x, high, out=x)
        for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
            np.right_shift(x, np.uint32(shift), out=t)
            np.bitwise_xor(x, t, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(15), out=t)
        np.bitwise_xor(x, t, out=x)
        np.maximum.reduceat(x, starts, out=most[i])
    # The largest uniform value u of a set gives its least exponential one, -log u.
    least = -np.log1p(-(2.0**32 - most.astype(np.float64) - 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(least / 32) / np.log(BASE)), 0, TOP).astype(np.uint8).T.copy()


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs, from how many registers are larger, smaller and equal, and the set sizes.

    With a pair's sizes as shares u and v of their sum, a register of the left is larger with probability
    p(u - v J), smaller with p(v - u J), where p(x) = -log to the base b of (1 - x (b - 1) / b).
    """
    above = (left > right).sum(axis=1)[:, None]
    below = (left < right).sum(axis=1)[:, None]
    equal = left.shape[1] - above - below
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :]
    possible = j <= np.minimum(u / v, v / u) + 1e-9
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    likely = above * np.log(more + tiny) + below * np.log(less + tiny) + equal * np.log(np.maximum(1 - more - less, tiny))
    return j[0, np.where(possible, likely, -np.inf).argmax(axis=1)]


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    kind = id_type(docs, "doc_id")
    schema = pa.schema([("doc_id", arrow_type(kind)), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sketch", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for names, texts in slices(batches, 32):
            sets = [shingles(t) for t in texts]
            full = [k for k, s in enumerate(sets) if len(s)]
            out: list[bytes | None] = [None] * len(sets)
            if full:
                starts = np.concatenate(([0], np.cumsum([len(sets[k]) for k in full])[:-1]))
                made = registers(np.concatenate([sets[k] for k in full]), starts, bands * rows)
                for k, row in zip(full, made, strict=True):
                    out[k] = row.tobytes()
            columns = [names, [len(s) for s in sets], [set_hash(s) for s in sets], out]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.mapInArrow(sketch, f"doc_id {kind}, n_shingles long, set_hash binary, sketch binary")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose estimated similarity is at least ``least``.

    The side b is joined first: a hub stands on side a, so its sketch isn't copied into a shuffle.
    """
    left = classes.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("nx"))
    right = classes.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("ny"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1) for c in ("x", "y"))
                j = estimate(x, y, part.column("nx").to_numpy().astype(float), part.column("ny").to_numpy().astype(float))
                yield part.select(["a", "b"]).filter(pa.array(j >= least))

    # A pair whose sizes differ too much cannot reach the threshold.
    rows = pairs.join(right, "b").join(left, "a").filter(F.least("nx", "ny") >= least * F.greatest("nx", "ny"))
    return rows.select("a", "b", "x", "y", "nx", "ny").mapInArrow(judge, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union; a hub's set isn't copied into a shuffle."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select(
        "a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("common"),
    )
    return both.filter(100 * F.col("common") >= percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("a", "b")


def _only(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` is in ``keys``, a written table of that column without repeats.

    A Bloom filter, sized by their number up to a limit, drops most other rows before they are shuffled. The exact join is an
    inner one: Spark would move a semi join below the filter, and shuffle all rows.
    """
    blocks = sized(keys)
    key = F.col(column).cast("string").alias("key")
    near = may_contain(rows.select("*", key), bloom_filter(keys.select(key), blocks), blocks)
    return near.drop("key").join(keys, column)


def _full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the ``classes``, a written table, from the text of one document of each."""
    schema = pa.schema([("set_hash", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for _, texts in slices(batches):
            sets = [make(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_hash(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], schema.field(1).type)],
                schema=schema,
            )

    texts = _only(docs.select("doc_id", "text"), "doc_id", cut(classes.select("doc_id").distinct())).select("doc_id", "text")
    made = texts.mapInArrow(shingle, "set_hash binary, shingles array<long>")
    return made.join(classes.select("node", "set_hash"), "set_hash").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, met, c) of the buckets whose members have more than one label."""
    tagged = members.select("bucket", "node", "met").join(labels, "node")
    several = cut(tagged.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("bucket"))
    return tagged.join(several, "bucket", "left_semi")


def _to_hubs(members: DataFrame, order: Column) -> DataFrame:
    """Pairs (a, b): members b of buckets with up to ``HUBS`` hubs a of other labels, the first of those in its buckets.

    A bucket's hub is the member that comes first by ``order``.
    """
    hub = cut(members.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), F.col("node").alias("a"), F.col("c").alias("hc"))).alias("hub")))
    met = members.join(hub, "bucket").filter("c <> hub.hc").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    few = F.slice(F.array_sort("hubs"), 1, HUBS)
    return met.select(F.col("node").alias("b"), F.explode(few).alias("x")).select("x.a", "b").distinct()


def _by_prefix(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across labels that share a rare shingle; among them all with 100 * intersection >= percent * union.

    Such a pair has at least need(n_a + n_b) = ceil(percent (n_a + n_b) / (100 + percent)) shingles in common. With
    each set in one order, rarest first, the first common one stands in a at place n_a - need + 1 or before, and
    likewise in b. So the smaller set of a pair is entered with a ninth of its shingles (at 80 percent), the larger
    asks once for each band of partner sizes, and both places are tested in the join. Shingles that a single label holds
    come first and make no rows. Sets that only share a core too small for a link never meet, as the core is
    frequent and stands behind.
    """
    need = lambda total: F.floor((percent * total + 99 + percent) / (100 + percent))
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(BAND)))
    each = sets.join(labels, "node").select("node", "c", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    shared = cut(
        each.groupBy("s").agg(F.count(F.lit(1)).alias("held"), F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("s", "held")
    )
    order = each.join(shared, "s").groupBy("node", "c", "n").agg(F.array_sort(F.collect_list(F.struct("held", "s"))).alias("l"))
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    first = F.col("n") - F.size("l")
    most = F.greatest(F.col("n") - need(F.col("n") + least) + 1 - first, F.lit(0)).cast("int")
    entries = order.select("node", "c", "n", first.alias("first"), F.posexplode(F.slice("l", F.lit(1), most)).alias("i", "x"))
    entries = cut(entries.select("node", "c", "n", "x.s", (F.col("first") + F.col("i") + 1).alias("place")))
    held = entries.filter(F.col("place") <= F.col("n") - need(2 * F.col("n")) + 1).withColumn("k", band(F.col("n")))
    asked = entries.withColumn("k", F.explode(F.sequence(band(least), band(F.col("n")))))
    lowest = F.greatest(F.floor(F.pow(F.lit(BAND), F.col("k"))), least)
    asked = asked.filter(F.col("place") <= F.col("n") - need(F.col("n") + lowest) + 1)
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    room = need(x("n") + y("n")) - 1
    meet = (x("k") == y("k")) & (x("s") == y("s")) & (x("c") != y("c")) & (x("place") <= x("n") - room) & (y("place") <= y("n") - room)
    smaller = (x("n") < y("n")) | ((x("n") == y("n")) & (x("node") < y("node")))
    pairs = held.alias("x").join(asked.alias("y"), meet & smaller)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, slack: float = 0.1
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct shingles of ``words`` words (A-Z lower-cased, split at space and U+0009 to
    U+000D); with fewer words, the whole sequence is the only one. Documents link if 100 * intersection is at least
    ``percent`` * union; component_id is the smallest id that links reach, kept says that it is the row's own.

    1. Every text gives SetSketch registers (exponentially spaced truncated minima). Texts with the same set are one
       class from here on, so a group of copies is one sketch.
    2. Registers are cut into ``bands`` of ``rows`` values; classes that share a band value meet in a bucket. At a
       similarity of 0.8 one band of 8 agrees with probability 0.2, any of 48 with 1 - 3e-5.
    3. Of a bucket, each member is first paired with the smallest one, not with every other; members of buckets that
       still hold several components then with a few hubs of theirs. A pair stays if the joint likelihood of its
       registers puts it no lower than the threshold minus ``slack`` (over four standard errors), and links if the
       full sets confirm it. Links join components.
    4. Members of buckets that hold several components even then are joined on their rarest shingles, across
       components only. No pair at the threshold is lost by this, and documents that merely share a passage don't
       meet, however many there are. Likelihood and full sets decide as before.

    Null, empty and blank texts have an empty set and link with nothing. A null id is never linked: its component_id
    is null. Rows that repeat an id and a text share their result; texts that share an id are judged one by one. An
    empty table gives no rows. Other columns are ignored, whatever their names. A very long text is read whole: its
    task holds some 60 bytes per character of it, and its set is one row.

    Keys that many rows share (a bucket, a hub, a shingle, a component) meet a written table with one row per key, so
    that Spark's skew join can split the other side.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketches = cut(_sketches(plain, words, bands, rows))
    classes = sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("set_hash")
    classes = classes.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    values = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * rows + 1, F.lit(rows))))
    placed = classes.select("node", F.explode(values).alias("bucket"))
    sizes = cut(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = _only(placed, "bucket", sizes)
    # How many others a class meets: most for the one that differs least from the rest of a group.
    members = cut(members.join(members.groupBy("node").agg(F.sum("n").alias("met")), "node").select("bucket", "node", "met"))
    # Only classes that share a bucket are ever compared.
    shared = cut(_only(classes, "node", cut(members.select("node").distinct())))
    full = cut(_full_sets(plain, shared, words))
    labels = classes.select("node", F.col("node").alias("c"))

    def joined(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The labels after links among the pairs (a, b) are confirmed."""
        links = _confirmed(cut(_likely(pairs, shared, percent / 100 - slack)), full, percent)
        for end in ("a", "b"):
            links = links.join(labels.select(F.col("node").alias(end), F.col("c").alias(f"c{end}")), end)
        moved = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("id", "c")
        return cut(labels.join(moved, "c", "left").select("node", F.coalesce("component_id", "c").alias("c")))

    labels = joined(_to_hubs(members.join(labels, "node"), -F.col("met")), labels)
    mixed = cut(_mixed(members, labels))
    labels = joined(_to_hubs(mixed, F.xxhash64("node", "bucket")), labels)
    several = _mixed(mixed, labels).select("node").distinct()
    labels = joined(_by_prefix(full.join(several, "node", "left_semi"), labels, percent), labels)
    named = labels.join(classes.select("node", "set_hash", "doc_id"), "node")
    named = named.join(named.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("set_hash", "component_id")
    out = sketches.join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
