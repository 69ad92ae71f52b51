"""Hard negatives: rows of other labels that score nearly as high as a positive, found by cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Groups that labels are hashed to, centres of the uppermost level, rows that they are chosen from.
GROUPS, MOST_TOPS, SAMPLE = 64, 256, 4096
#: Children of a tree's node, rows of a leaf.
FAN_OUT, LEAF = 16, 256
#: What rounding may add to an angle, and to a bound in units of its largest value.
SLACK = 1e-6
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, whose squares may overflow or vanish."""
    most = np.abs(x).max(axis=1, initial=1e-300)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


@dataclass
class Scale:
    """Sizes of all candidates: columns, largest component, and largest length in units of it."""

    width: int
    largest: float
    longest: float

    def vectors(self, raw: list[bytes], kind: str) -> np.ndarray:
        """Whole-numbered components, floor(256 x) in double precision, filled up with zeros."""
        out = np.zeros((len(raw), self.width))
        for k, cells in enumerate(raw):
            x = np.frombuffer(cells, dtype=kind)
            out[k, : len(x)] = np.floor(256 * x.astype(np.float64))
        return out

    def augmented(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors with a further component that brings all lengths to the largest: inner products become angles."""
        y = x / self.largest
        rest = np.sqrt(np.maximum(self.longest**2 - (y * y).sum(axis=1), 0.0))
        return np.concatenate((y, rest[:, None]), axis=1) / self.longest

    def scores(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products, held to the range of a long."""
        if self.largest * self.longest < 1 << 26:
            return (queries @ rows.T).astype(np.int64)
        whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
        return np.clip(whole(queries) @ whole(rows).T, LOWEST, HIGHEST).astype(np.int64)

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """The score of a query at angle 0."""
        with np.errstate(over="ignore"):
            return np.minimum(_lengths(queries) * self.longest * self.largest, 1e300)


class CoverTree:
    """Levels of balls over unit vectors; the balls of a level cover its parents' rows.

    A ball has the row that is its centre and its measured covering radius (an angle). A ball's children are the rows
    farthest from those chosen before, until all rows lie within half the ball's radius, or ``fan_out`` of them (or as many
    as leaves would hold the rows); each row goes to its nearest. Balls with few rows, or of radius 0, are leaves.
    """

    def __init__(self, x: np.ndarray, fan_out: int = FAN_OUT, leaf: int = LEAF):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # centres, radii, parents, leaf numbers (or -1)
        self.leaves: list[np.ndarray] = []
        balls = [(np.arange(len(x)), x[0], float(_angles(x @ x[0]).max()), 0)]
        while balls:
            numbers, below = [], []
            for k, (rows, centre, radius, _) in enumerate(balls):
                if len(rows) <= leaf or radius <= SLACK:
                    numbers.append(len(self.leaves))
                    self.leaves.append(rows)
                    continue
                numbers.append(-1)
                angle, nearest = _angles(x[rows] @ centre), np.zeros(len(rows), dtype=np.int64)
                chosen = [centre]
                while len(chosen) < max(2, min(fan_out, -(-len(rows) // leaf))) and angle.max() > radius / 2:
                    chosen.append(x[rows[angle.argmax()]])
                    now = _angles(x[rows] @ chosen[-1])
                    nearest[now < angle] = len(chosen) - 1
                    angle = np.minimum(angle, now)
                below += [(rows[nearest == c], at, float(angle[nearest == c].max()), k) for c, at in enumerate(chosen) if (nearest == c).any()]
            self.levels.append(
                (np.array([b[1] for b in balls]), np.array([b[2] for b in balls]), np.array([b[3] for b in balls]), np.array(numbers))
            )
            balls = below

    def descend(self, queries: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most that a query can score in each leaf; -inf where that leaf, or a ball above it, lies outside low .. high."""
        best = np.full((len(queries), len(self.leaves)), -np.inf)
        open_above = np.ones((len(queries), 1), dtype=bool)
        for centres, radii, parents, numbers in self.levels:
            upper, lower = bounds(queries @ centres.T, radii, reach)
            inside = open_above[:, parents] & (upper >= low[:, None]) & (lower <= high[:, None])
            leaf = numbers >= 0
            best[:, numbers[leaf]] = np.where(inside, upper, -np.inf)[:, leaf]
            open_above = inside
        return best


def bounds(cosines: np.ndarray, radii: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most and the least that queries (rows) can score within balls (columns), held to the range of a long."""
    angle, radii, reach = _angles(cosines), radii + SLACK, reach[:, None]
    extra, held = SLACK * reach + 1e-9, lambda x: np.clip(x, float(LOWEST), float(HIGHEST))
    return held(np.cos(np.maximum(angle - radii, 0)) * reach + extra), held(np.cos(np.minimum(angle + radii, np.pi)) * reach - extra)


@dataclass
class _Best:
    """The first ``k`` hits of each window, as flat arrays ordered by window, score (largest first) and id."""

    k: int
    window: np.ndarray
    score: np.ndarray
    row: np.ndarray

    def add(self, window: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        window, score, row = (np.concatenate(p) for p in ((self.window, window), (self.score, score), (self.row, row)))
        order = np.lexsort((ids[row], ~score, window))  # ~score: no overflow
        window, score, row = window[order], score[order], row[order]
        first = np.searchsorted(window, window)
        keep = np.arange(len(window)) - first < self.k
        self.window, self.score, self.row = window[keep], score[keep], row[keep]

    def last(self, n: int) -> np.ndarray:
        """The k-th score of each of ``n`` windows; -inf where there are fewer hits."""
        out = np.full(n, -np.inf)
        counts = np.bincount(self.window, minlength=n)
        full = np.flatnonzero(counts >= self.k)
        out[full] = self.score[np.searchsorted(self.window, full) + self.k - 1]
        return out


@dataclass
class _Asked:
    """Queries with their vectors, ids and labels, and windows (low .. high, at least ``least``) in order of their queries."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    query: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray

    @classmethod
    def read(cls, table: pa.Table, scale: Scale, kind: str) -> _Asked:
        lows = table.column("low").to_pylist()
        flat = lambda name, dtype: np.array([v for cells in table.column(name).to_pylist() for v in cells], dtype=dtype)
        return cls(
            scale.vectors(table.column("x").to_pylist(), kind), table.column("id").to_numpy(), table.column("label").to_numpy(),
            np.repeat(np.arange(len(lows)), [len(v) for v in lows]), flat("low", np.int64), flat("high", np.int64), flat("least", np.float64),
        )

    def firsts(self) -> np.ndarray:
        return np.searchsorted(self.query, np.arange(len(self.x)))

    def needed(self) -> np.ndarray:
        return np.maximum(self.low.astype(np.float64), self.least)


def _rays(queries: np.ndarray) -> np.ndarray:
    """Unit vectors of queries, the further component 0; a query of length 0 is at a right angle to all."""
    lengths = _lengths(queries)
    return np.concatenate((queries / np.where(lengths > 0, lengths, 1.0)[:, None], np.zeros((len(queries), 1))), axis=1)


def _search(tree: CoverTree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, scale: Scale, asked: _Asked, same: bool, k: int) -> _Best:
    """The first ``k`` rows of every window.

    ``same`` wants rows of the query's label other than itself, else rows of other labels. Every query takes its leaves
    best first, one, then two, then four; the queries that are at a leaf are verified together. It ends when no leaf can
    better any of its windows.
    """
    reach, firsts, needed = scale.reach(asked.x), asked.firsts(), asked.needed()
    slack = SLACK * reach + 1e-9  # more than doubles lose of large scores
    upper = tree.descend(
        _rays(asked.x), reach, np.minimum.reduceat(needed, firsts) - slack, np.maximum.reduceat(asked.high.astype(np.float64), firsts) + slack,
    )
    order = np.argsort(-upper, axis=1, kind="stable")
    windows, highest = np.append(firsts[1:], len(needed)) - firsts, np.maximum.reduceat(asked.high, firsts)
    found = _Best(k, *(np.zeros(0, dtype=np.int64) for _ in range(3)))
    turn, width = 0, 1
    while turn < len(tree.leaves):
        # The next best leaves of each query, twice as many each time.
        leaf = order[:, turn : turn + width]
        turn, width = turn + width, 2 * width
        last = np.maximum(needed, found.last(len(needed)))
        lowest = np.minimum.reduceat(last, firsts)
        most = np.take_along_axis(upper, leaf, axis=1)
        who, place = np.nonzero((most >= (lowest - slack)[:, None]) & (most > -np.inf))
        if not len(who):
            break
        by_leaf = np.argsort(leaf[who, place], kind="stable")
        who, leaf = who[by_leaf], leaf[who, place][by_leaf]
        hits = []
        for at in np.split(np.arange(len(who)), np.flatnonzero(leaf[1:] != leaf[:-1]) + 1):
            asking, rows = who[at], tree.leaves[leaf[at[0]]]
            score = scale.scores(asked.x[asking], x[rows])
            fits = (score >= lowest[asking, None]) & (score <= highest[asking, None]) & ((labels[rows] == asked.labels[asking][:, None]) == same)
            if same:
                for q, c in np.argwhere(ids[rows] == asked.ids[asking][:, None]):
                    fits[q, c] &= bool((x[rows[c]] != asked.x[asking[q]]).any())
            q, column = np.nonzero(fits)
            hits.append((asking[q], rows[column], score[q, column]))
        query, row, score = (np.concatenate(part) for part in zip(*hits, strict=True))
        for w in range(int(windows[who].max())):
            window = np.minimum(firsts[query] + w, len(needed) - 1)
            good = (w < windows[query]) & (score >= asked.low[window]) & (score <= asked.high[window]) & (score >= last[window])
            found.add(window[good], score[good], row[good], ids)
    return found


@dataclass
class _Cells:
    """The uppermost level: balls of label group and centre, with what they hold."""

    centres: np.ndarray
    group: np.ndarray
    top: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    only: list[int | None]  # the label of a cell that holds a single one

    def splits(self, size: int) -> np.ndarray:
        return -(-self.rows // size)


def _farthest(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows, each the farthest from those before it."""
    chosen, angle = [x[0]], _angles(x @ x[0])
    while len(chosen) < k and angle.max() > SLACK:
        chosen.append(x[angle.argmax()])
        angle = np.minimum(angle, _angles(x @ chosen[-1]))
    return np.array(chosen)


def _group(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(GROUPS)).cast("int")


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, k: int = 5, rows_per_shard: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), up to ``k`` rows for each anchor and positive.

    Components become floor(256 x), x in double precision; a score is the whole-numbered inner product with the anchor. Higher
    scores come first, ties by smaller id. Anchors are rows whose id is divisible by ``every``, their positives the first
    ``k`` other rows of their label, and the negatives of a positive the first ``k`` rows of other labels with
    80 positive_score <= 100 negative_score <= 100 positive_score.

    1. All vectors get a further component that makes them equally long, so that scores are angles. The uppermost level
       of the cover tree is cells: a hash group of labels and the nearest of up to 256 centres, chosen farthest first
       from a bounded sample; every row is placed, and a cell's covering radius is measured over all its rows. Cells are at
       most 64 x 256, whatever the table's size; the driver sees their counts and radii only.
    2. A cell is split by hash into shards of about ``rows_per_shard`` rows, however hot its label. Shards meet the anchors
       that may find something in them, in blocks; in a task, a cover tree over the shard is descended level by level,
       balls outside a query's windows are skipped by their radii, and leaves are verified exactly, best first.
    3. Positives come first (windows without ends, cells of the own label group), then negatives with the windows of the positives.
       With several centres each search has two rounds: the most promising cell, then the cells that may still better it.

    Rows with a null id, label or vector, a null or non-finite component, or one that overflows when scaled take no part;
    neither do repeats of a row (equal id, label and vector). Rows that share an id but differ are rows of their own. Shorter vectors count
    as filled up with zeros; scores beyond a long are held to its range. A negative positive_score has no negatives. Ids and labels
    are whole numbers. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    if kind == "<f8":
        base = base.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * 256 < F.lit(float("inf"))))
    base = base.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    sizes = F.transform("v", lambda c: F.abs(c.cast("double")) * 256 + 1)
    seen = base.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(sizes)).alias("largest"),
        F.max(F.aggregate(sizes, F.lit(0.0), lambda total, c: total + c * c)).alias("square"), F.approx_count_distinct(_group(F.col("label"))).alias("groups"),
        F.count_if(F.col("id") % every == 0).alias("anchors"),
    ).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not seen["n"] or not seen["anchors"]:
        return spark.createDataFrame([], schema)
    width, largest = max(1, seen["width"]), seen["largest"] or 1.0
    # Upper bounds of lengths; where squares overflow, what the number of components allows.
    scale = Scale(width, largest, float(min(np.sqrt(seen["square"] or 1.0) / largest, np.sqrt(width))) * (1 + 1e-9))
    shard = max(64, min(rows_per_shard, (1 << 22) // width))
    wanted = int(min(MOST_TOPS, max(1, seen["n"] // (max(1, seen["groups"]) * shard))))
    share = min(1.0, 2.0 * SAMPLE / seen["n"])
    some = base.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).orderBy(F.xxhash64("id", "label", "v")).limit(SAMPLE if wanted > 1 else 1).select("v").collect()
    first = scale.augmented(scale.vectors([np.array(r["v"], dtype=kind).tobytes() for r in some], kind)) if some else np.eye(1, width + 1)
    centres = _farthest(first, wanted)
    placed_schema = pa.schema([("grp", pa.int32()), ("top", pa.int32()), ("angle", pa.float64()), ("id", pa.int64()), ("label", pa.int64()), ("x", pa.binary())])
    shared = spark.sparkContext.broadcast((scale, centres))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, centres = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = [np.array(v, dtype=kind).tobytes() for v in part.column("v").to_pylist()]
                angle = _angles(scale.augmented(scale.vectors(raw, kind)) @ centres.T)
                top = angle.argmin(axis=1)
                cells = [part.column("grp"), pa.array(top, pa.int32()), pa.array(angle[np.arange(len(top)), top]), part.column("id"), part.column("label"), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, schema=placed_schema)

    placed = cut(base.select(_group(F.col("label")).alias("grp"), "id", "label", "v").mapInArrow(place, "grp int, top int, angle double, id long, label long, x binary"))
    held = placed.groupBy("grp", "top").agg(
        F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), F.min("label").alias("least"), F.max("label").alias("most"),
    ).orderBy("grp", "top").collect()
    column = lambda name: np.array([r[name] for r in held])
    cells = _Cells(centres, column("grp"), column("top"), column("radius"), column("n"), [r["least"] if r["least"] == r["most"] else None for r in held])
    anchors = placed.filter(F.col("id") % every == 0).dropDuplicates(["id", "label", "x"])
    anchors = cut(anchors.select(F.monotonically_increasing_id().alias("anchor"), "grp", "id", "label", "x"))
    blocks = -(-seen["anchors"] // shard)
    one = lambda value, of: F.array(F.lit(value).cast(of))
    open_windows = anchors.select("*", one(LOWEST, "long").alias("low"), one(HIGHEST, "long").alias("high"), one(float("-inf"), "double").alias("least"))
    search = lambda asked, same: _found(asked, placed, shared, cells, shard, blocks, same, k, kind)
    positives = search(open_windows, True).withColumnRenamed("hit", "positive_id").withColumnRenamed("score", "positive_score")
    # ceil(80 s / 100) = s - floor(s / 5)
    able = positives.filter("positive_score >= 0")
    windows = able.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("w"))
    windows = anchors.join(windows, "anchor").select(
        *anchors.columns, F.expr("transform(w, p -> p.positive_score - p.positive_score div 5)").alias("low"),
        F.transform("w", lambda w: w["positive_score"]).alias("high"), F.transform("w", lambda w: F.lit(float("-inf"))).alias("least"),
    )
    negatives = search(windows, False).withColumnRenamed("place", "rank").withColumnRenamed("window", "place")
    out = able.drop("window").join(negatives, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("hit").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _found(asked: DataFrame, placed: DataFrame, shared, cells: _Cells, shard: int, blocks: int, same: bool, k: int, kind: str) -> DataFrame:
    """(anchor, window from 1, place from 1, hit, score): the first ``k`` rows of each window of ``asked``."""
    rounds = (True, False) if len(cells.centres) > 1 else (None,)
    hits = None
    for first in rounds:
        if hits is not None:  # the k-th score of each window so far
            last = hits.filter(F.col("place") == k).select("anchor", "window", "score")
            last = last.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", F.col("score").cast("double")))).alias("last"))
            asked = asked.join(last, "anchor", "left").withColumn(
                "least", F.transform("least", lambda v, i: F.coalesce(F.try_element_at("last", (i + 1).cast("int")), v))
            ).drop("last")
        now = _round(asked, placed, shared, cells, shard, blocks, same, k, kind, first)
        hits = now if hits is None else hits.drop("place").unionByName(now)
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "hit")
        hits = cut(hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k))
    return hits


def _round(
    asked: DataFrame, placed: DataFrame, shared, cells: _Cells, shard: int, blocks: int, same: bool, k: int, kind: str, first: bool | None,
) -> DataFrame:
    """(anchor, window, hit, score) of one round: each anchor's most promising cell, or all others, or (None) all.

    A cell takes part for an anchor if it may hold a row of a wanted label whose score lies within one of its windows.
    """
    names = ("anchor", "id", "label", "x", "low", "high", "least")
    splits = cells.splits(shard)
    sent = pa.schema(
        [
            ("cell", pa.int32()), ("anchor", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()),
            ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("least", pa.list_(pa.float64())),
        ]
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, _ = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = pa.Table.from_batches([batch.slice(at, 256)])
                query = _Asked.read(part, scale, kind)
                starts, reach = query.firsts(), scale.reach(query.x)
                upper, lower = bounds((_rays(query.x) @ cells.centres.T)[:, cells.top], cells.radius, reach)
                slack = (SLACK * reach + 1e-9)[:, None]
                high = np.maximum.reduceat(query.high.astype(np.float64), starts)[:, None]
                able = (upper >= np.minimum.reduceat(query.low.astype(np.float64), starts)[:, None] - slack) & (lower <= high + slack)
                if same:
                    able &= cells.group == part.column("grp").to_numpy()[:, None]
                else:
                    able &= np.array([[only != mark for only in cells.only] for mark in query.labels])
                best = np.where(able, np.minimum(upper, high), -np.inf).argmax(axis=1)[:, None] == np.arange(len(cells.top))
                if first is not None:
                    better = upper >= np.minimum.reduceat(query.needed(), starts)[:, None] - slack
                    able &= best if first else ~best & better
                who, cell = np.nonzero(able)
                yield from pa.Table.from_arrays([pa.array(cell, pa.int32()), *(part.column(c).take(pa.array(who)) for c in names)], schema=sent).combine_chunks().to_batches()

    kinds = "anchor long, id long, label long, x binary, low array<long>, high array<long>, least array<double>"
    routed = asked.mapInArrow(route, f"cell int, {kinds}")
    # One row a cell, at most GROUPS x MOST_TOPS.
    numbered = asked.sparkSession.createDataFrame(
        [(n, int(g), int(t), int(s)) for n, (g, t, s) in enumerate(zip(cells.group, cells.top, splits, strict=True))], "cell int, grp int, top int, splits int"
    )
    numbered = F.broadcast(numbered)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda of, n: F.pmod(F.xxhash64(*of), n).cast("int")
    queries = routed.join(numbered.select("cell", "splits"), "cell").select("cell", every(F.col("splits")).alias("split"), dealt(["anchor"], F.lit(blocks)).alias("block"), *names)
    rows = placed.join(numbered, ["grp", "top"]).select("cell", dealt(["id", "label", "x"], F.col("splits")).alias("split"), every(F.lit(blocks)).alias("block"), "id", "label", "x")
    found = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("hit", pa.int64()), ("score", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found.empty_table()
        scale, _ = shared.value
        rows = sorted(set(zip(*(right.column(c).to_pylist() for c in ("id", "label", "x")), strict=True)))
        ids, labels = (np.array([r[c] for r in rows], dtype=np.int64) for c in (0, 1))
        x, asked = scale.vectors([r[2] for r in rows], kind), _Asked.read(left, scale, kind)
        best = _search(CoverTree(scale.augmented(x)), x, ids, labels, scale, asked, same, k)
        query = asked.query[best.window]
        columns = [left.column("anchor").to_numpy()[query], best.window - asked.firsts()[query] + 1, ids[best.row], best.score]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found, strict=True)], schema=found)

    by = ("cell", "split", "block")
    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(compare, "anchor long, window int, hit long, score long")
