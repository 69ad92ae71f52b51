"""Exact, line, near and vector deduplication against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import near_dedup as near
from gleanery.llm.bloom import apart
from gleanery.llm.exact_dedup import exact_dedup
from gleanery.llm.graph import components
from gleanery.llm.line_dedup import line_dedup
from gleanery.llm.near_dedup import Shingler, estimate, near_dedup, registers
from gleanery.llm.vector_dedup import vector_dedup

SCHEMA = "doc_id long, text string"
BLANKS = "[\x20\x09-\x0d]"


def table(spark, rows, schema=SCHEMA):
    """With columns that have the names of inner ones."""
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as keep_id", "'x' as norm", "2 as node", "3 as pos", "'y' as hash", "4 as component_id")


def test_exact_dedup(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb \n"), (4, None), (5, ""), (6, " \n"), (7, "a b"), (8, "a b"), (9, "x" * 200_000), (10, "x" * 200_000), (11, "é"), (11, "é"), (None, "zz"), (None, "z z")]
    out = exact_dedup(table(spark, rows)).collect()
    assert len(out) == len(rows)
    norm = {i: re.sub(BLANKS, "", t or "") for i, t in rows if i is not None}
    for r in out:
        if r.doc_id is None:
            assert (r.keep_id, r.kept, r.group_size) == (None, True, 2)
            continue
        same = [(i, t or "") for i, t in rows if i is not None and norm[i] == norm[r.doc_id]]
        keep = min(same, key=lambda s: (-len(s[1]), s[0]))[0]
        assert (r.keep_id, r.kept, r.group_size) == (keep, keep == r.doc_id, len(same))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert exact_dedup(table(spark, [])).count() == 0


def test_exact_dedup_compares_bytes_where_hashes_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gleanery.llm import exact_dedup as module

    class Colliding:
        def __getattr__(self, name):
            return (lambda c: F.lit("00" * 16)) if name == "md5" else getattr(F, name)

    monkeypatch.setattr(module, "F", Colliding())
    out = {r.doc_id: r.keep_id for r in exact_dedup(table(spark, [(1, "a"), (2, "b"), (3, "a ")])).collect()}
    assert out == {1: 3, 2: 2, 3: 3}


def brute_lines(rows, min_words=50):
    """Lines covered by a run of lines with so many words that stood before without overlapping."""
    docs = [(i, [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate((t or "").split("\n"))]) for i, t in sorted(rows)]
    seen, gone = [], {}
    for i, lines in docs:
        lines = [(n, x) for n, x in lines if x]
        flat = [x for _, x in lines]
        for other in [*seen, flat]:
            for a in range(len(flat)):
                for b in range(len(other)):
                    if other is flat and b >= a:
                        continue
                    k = 0
                    while a + k < len(flat) and b + k < len(other) and (other is not flat or k < a - b) and flat[a + k] == other[b + k]:
                        k += 1
                    if sum(len(x.split()) for x in flat[a : a + k]) >= min_words:
                        gone.setdefault(i, set()).update(n for n, _ in lines[a : a + k])
        seen.append(flat)
    return gone


def test_line_dedup(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    long, run, short = line(60), [line(12) for _ in range(6)], line(8)
    rows = [
        (1, "\n".join([line(9), long, line(9)])), (2, "\n".join([short, *run, short])), (3, "\n".join([long, line(20)])), (4, "\n".join([line(30), *run[:5], line(3)])),
        (5, "\n".join([short, line(10), run[0], line(40)])), (6, "\n".join([line(7), "", long, "", *run])), (7, None), (8, ""), (9, "\n\n"), (10, "\n".join([line(55)] * 3)), (10, "\n".join([line(5)])), (11, long), (11, long),
    ]
    gone = brute_lines([r for r in rows if r != (11, long)] + [(11, long)])
    for r in line_dedup(table(spark, rows)).collect():
        if r.doc_id == 10:
            continue
        text = dict(rows)[r.doc_id] or ""
        kept = [x for n, x in enumerate(text.split("\n")) if n not in gone.get(r.doc_id, ())]
        assert r.text == "\n".join(kept), r.doc_id
        assert (r.n_lines, r.n_deleted) == (text.count("\n") + 1, len(gone.get(r.doc_id, ())))
    ten = sorted(r.n_deleted for r in line_dedup(table(spark, rows)).filter("doc_id = 10").collect())
    assert ten == [0, 2]
    assert line_dedup(table(spark, [])).count() == 0


def test_line_dedup_where_the_first_place_shares_only_part_of_a_run(spark):
    """P stands alone in document 1 and before Q in 2 and 3: the run P, Q of 60 words is repeated in 3."""
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = []
    for k in range(12):  # whichever gram of a window is the least
        p, q = line(30), line(30)
        rows += [(k, "\n".join([line(9), p, line(9)])), (100 + k, "\n".join([p, q])), (200 + k, "\n".join([line(9), p, q, line(7)]))]
    # Any mixture of few lines: runs that overlap, themselves too, and end in lines too short for a window of their own.
    few = [line(n) for n in (1, 3, 7, 12, 20, 26, 30, 45, 50, 60)]
    rows += [(300 + k, "\n".join(rng.choice([*few, "", line(4)]) for _ in range(rng.randrange(1, 14)))) for k in range(60)]
    gone = brute_lines(rows)
    assert all(len(gone[200 + k]) == 2 for k in range(12))
    for r in line_dedup(table(spark, rows)).collect():
        kept = [x for n, x in enumerate(dict(rows)[r.doc_id].split("\n")) if n not in gone.get(r.doc_id, ())]
        assert (r.text, r.n_deleted) == ("\n".join(kept), len(gone.get(r.doc_id, ()))), r.doc_id


def test_line_dedup_keeps_the_first_run_of_a_repeated_line(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    two = [" ".join(f"{c}{i}" for i in range(10)) for c in "ab"]
    rows = [(1, "\n".join([ten] * 20)), (2, "\n".join([ten] * 20)), (3, "\n".join(two * 10)), (4, "\n".join([ten] * 4)), (5, "\n".join([ten] * 9))]
    gone = brute_lines(rows)
    out = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup(table(spark, rows)).collect()}
    assert out[1] == ("\n".join([ten] * 5), 15) and out[2] == ("", 20) and out[4][1] == 0 and out[5] == ("", 9)
    assert {i: n for i, (_, n) in out.items() if n} == {i: len(g) for i, g in gone.items()}


def test_line_dedup_of_very_long_texts(spark):
    long = "w " * 400_000 + "end"
    lines = "\n".join(f"line {k} with some more words" for k in range(20_000))
    rows = [(1, long), (2, "before\n" + long), (3, lines), (4, lines + "\nlast")]
    out = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup(table(spark, rows)).collect()}
    assert out == {1: (long, 0), 2: ("before", 1), 3: (lines, 0), 4: ("last", 20_000)}


def shingles(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(BLANKS + "+", text) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def linked(sets, test):
    """Least reachable key of every key, by all pairs."""
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a != b and test(sets[a], sets[b]) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return least


def test_near_dedup(spark):
    rng = random.Random(1)
    words = [f"W{i}é" for i in range(400)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(8)]
    passage = [rng.choice(words) for _ in range(90)]
    rows = []
    for k in range(90):
        w = list(base[k % 8])
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(3)
        if k % 3 == 0:
            w[40:40] = passage
        rows.append((1000 - k, (" " if k % 2 else "\t\n").join(w)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, "a b c d"), (8, "A b c d"), (None, "a b c d"), (9, rows[0][1]), (9, rows[0][1])]
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    expected = linked(sets, lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b))
    out = near_dedup(table(spark, rows), words=4).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id), r.doc_id
    assert near_dedup(table(spark, [])).count() == 0


def test_near_dedup_of_many_texts_around_one_core(spark):
    """A core and own words: just below the threshold (no links), beside a few pairs above it."""
    rng = random.Random(4)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    core = own(200)
    rows = [(k, " ".join(core + own(27 + k % 5))) for k in range(150)]
    for k in range(10):
        w = rows[k][1].split(" ")
        rows.append((1000 + k, " ".join(w[:-3] + own(3))))
    rows.append((2000, " ".join([*own(9), "x" * 3_000_000])))
    sets = {i: shingles(t, 4) for i, t in rows}
    expected = linked(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r.doc_id: r.component_id for r in near_dedup(table(spark, rows), words=4).collect()}
    assert got == expected
    assert len(set(expected.values())) > 100


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(3)
    sets = {}
    for k in range(240):
        core = range(100 * (k % 3), 100 * (k % 3) + 40 + k % 9)
        sets[k] = {*core, *(rng.randrange(400, 430 if k % 2 else 10**6) for _ in range(rng.randrange(0, 14)))}
    sets |= {500 + k: set(range(900, 901 + k)) for k in range(12)}
    label = {k: k - k % 2 if k < 240 else k for k in sets}
    full = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, shingles array<long>")
    labels = spark.createDataFrame(list(label.items()), "node long, c long")
    for percent in (80, 50):
        alike = {(a, b) for a in sets for b in sets if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = [tuple(r) for r in near._by_prefix(full, labels, percent).collect()]
        assert len(got) == len(set(got)) and alike and alike <= set(got)
    core = spark.createDataFrame([(k, [*range(80), *range(1000 * (k + 1), 1000 * (k + 1) + 11)]) for k in range(200)], "node long, shingles array<long>")
    assert near._by_prefix(core, core.select("node", F.col("node").alias("c")), 80).count() == 0


def test_rows_that_are_not_wanted_are_dropped_before_the_exact_join(spark):
    """Bloom filter first: as a semi join, the exact one was moved below it, and every text was shuffled."""
    docs = near.cut(table(spark, [(i, f"text {i}") for i in range(2_000)]))
    classes = near.cut(spark.createDataFrame([(n, n * 100, near.set_hash(Shingler(1)(f"text {n * 100}"))) for n in range(10)], "node long, doc_id long, set_hash binary"))
    sets = near._full_sets(docs, classes, 1)
    assert sorted((r.node, len(r.shingles)) for r in sets.collect()) == [(n, 2) for n in range(10)]
    joins = [line for line in sets._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert "LeftSemi" not in "".join(joins)
    assert ["set_hash" in joins[0], "doc_id" in joins[1], "block" in joins[2]] == [True] * 3


def test_sketches_are_mergeable_and_estimate_similarity():
    make = Shingler(1)
    a, b = make(" ".join(f"w{i}" for i in range(1000))), make(" ".join(f"w{i}" for i in range(200, 1200)))
    one = lambda s: registers(s, np.array([0]), 512)
    assert (np.maximum(one(a), one(b)) == one(np.union1d(a, b))).all()
    both = registers(np.concatenate((a, b)), np.array([0, len(a)]), 512)
    assert (both[0] == one(a)[0]).all() and (both[1] == one(b)[0]).all()
    j = estimate(one(a), one(b), np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(j - 800 / 1200) < 0.1


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)] + [(200, i) for i in range(201, 240)]
    least = linked({i: {i} for e in edges for i in e if e[0] != e[1]}, lambda a, b: False)
    for _ in range(200):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    out = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component_id for r in out.collect()} == least
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_dedup(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    rows = [(int(i), [float(v) for v in (centres[i % 20] + rng.normal(scale=0.12 + 0.1 * (i % 3), size=24)).astype(np.float32)]) for i in range(400)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, [v * 4 for v in rows[3][1]]), (1003, None), (1004, [0.0] * 24), (1005, [1.0, None] + [0.0] * 22), (1006, [float("nan")] * 24), (1007, [float("inf")] + [0.0] * 23), (1008, []), (1009, [1e-30] * 24), (1010, [1e30] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as key", "3 as size")
    usable = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in usable.items()}
    close = lambda a, b: float(unit[a] @ unit[b]) >= 0.95
    least = linked({i: i for i in unit}, close)
    for r in vector_dedup(df).collect():
        n = sum(close(r.vec_id, other) for other in unit if other != r.vec_id) if r.vec_id in unit else 0
        assert (r.n_links, r.component_id) == (n, least.get(r.vec_id, r.vec_id)), r.vec_id
        assert r.kept == (r.vec_id == r.component_id)
    assert vector_dedup(df.limit(0)).count() == 0


def test_vector_dedup_reaches_links_of_low_rank(spark):
    """Vectors of a space of 3 dimensions within 64: displacements don't spread over all dimensions."""
    rng = np.random.default_rng(6)
    basis = np.linalg.qr(rng.normal(size=(64, 3)))[0]
    x = rng.normal(size=(1200, 3)) @ basis.T
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert links.sum() > 200
    assert {r.vec_id: r.n_links for r in vector_dedup(df).collect()} == dict(enumerate(links.tolist()))


def test_bloom_filter_sets_no_row_aside_wrongly(spark):
    rows = spark.createDataFrame([(k if k % 10 else None, "t" * (k % 3), k) for k in range(500)], "doc_id long, text string, block long").selectExpr("*", "'x' as w0", "'y' as row")
    keys = spark.createDataFrame([(str(k),) for k in range(0, 500, 7)] + [(None,)], "key string")
    maybe, other = apart(rows, F.col("doc_id").cast("string"), keys)
    assert maybe.columns == other.columns == rows.columns
    inside = {r.block for r in maybe.collect()}
    outside = {r.block for r in other.collect()}
    assert inside | outside == set(range(500)) and not inside & outside
    wanted = {k for k in range(500) if k % 10 == 0 or k % 7 == 0}
    assert wanted <= inside and len(inside) < len(wanted) + 40
    assert apart(rows, F.col("doc_id").cast("string"), keys.limit(0))[0].count() == 0
