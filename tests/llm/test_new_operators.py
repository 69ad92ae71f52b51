"""Spelling variants, hard negatives and quality rules against brute force on small tables."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleanery.llm.hard_negatives import CoverTree, Scale, _angles, bounds, hard_negatives
from gleanery.llm.quality_rules import BITS, LineModel, _expected, fit, judge, learn, measure, quality_rules
from gleanery.llm.spelling import corpus_variants, corpus_words, spelling_variants

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- Spelling variants -----------------------------------------------------------------------------------------


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6}


def one_edit(a, b):
    """By trying every edit of ``a``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_corpus_words(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choice("abÀÿÈZ") for _ in range(rng.randrange(4, 8))) for _ in range(60)) + "×÷ß,x9Ångström") for k in range(60)]
    rows += [(None, "Anonym anonym ANONYM"), (70, None), (71, ""), (72, "long" * 300_000), (73, "Ǻlphabet ſabcdef"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word", "map('a', 1) as run")
    got = {r.word: r.n for r in corpus_words(df).collect()}
    assert got == brute_words(rows)
    assert any(w not in {re.sub("[A-Z]", lambda m: m[0].lower(), r) for _, t in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")} for w in got), "no word lost a code point"
    assert corpus_variants(df.limit(0)).count() == 0
    frequent = {w: n for w, n in brute_words(rows).items() if n >= 5}
    assert variants(corpus_variants(df)) == brute_variants(frequent)


@pytest.mark.parametrize("size,tile", [(2048, 512), (12, 8), (3, 8)])
def test_spelling_variants(spark, size, tile):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 10))) for _ in range(30)]
    words = {}
    for w in base:
        words[w] = rng.randrange(1, 2000)
        for _ in range(8):
            k, c = rng.randrange(len(w)), rng.choice("abcé")
            words.setdefault(rng.choice([w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + c + w[k:]]), rng.randrange(1, 300))
    # A hot bucket, repeated letters, ties, chains of forms, code points beyond the first plane, words of one code point.
    words |= {"sssssss" + c: 10 for c in "abcdefghijklmnop"} | {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "baaaaaaaa": 625}
    words |= {"x𝄞yz12": 3, "x𝄞yz13": 30, "xyz12": 300, "é" * 3000: 2, "é" * 2999: 10, "a": 1, "b": 9, "ab": 50}
    df = spark.createDataFrame([*words.items(), (None, 4)], "word string, n long")
    assert variants(spelling_variants(df, size=size, tile=tile)) == brute_variants(words)
    assert spelling_variants(df.limit(0)).count() == 0


# --- Hard negatives --------------------------------------------------------------------------------------------


def brute_negatives(rows, every, k=5):
    usable = [(i, label, tuple(int(np.floor(256 * float(c))) for c in v)) for i, label, v in rows if None not in (i, label, v) and None not in v and np.isfinite(v).all()]
    usable, out = sorted(set(usable)), []
    dot = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    for a in usable:
        if a[0] % every:
            continue
        ranked = sorted(((-dot(a[2], b[2]), b[0], b[1]) for b in usable if b != a), key=lambda t: t[:2])
        for score, positive, _ in [t for t in ranked if t[2] == a[1]][:k]:
            window = [t for t in ranked if t[2] != a[1] and 80 * -score <= 100 * -t[0] <= 100 * -score][:k]
            out += [(a[0], positive, n, t[1], -score, -t[0]) for n, t in enumerate(window, 1)]
    return sorted(out)


def vector_rows(seed=3, n=500, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] * (1 + i % 3) + rng.normal(scale=0.02 if i % 4 else 0.4, size=width)
        rows.append((i, int(i % 3 if i % 5 else 7), [float(c) for c in v.astype(np.float32)]))
    rows += [(i + n, 1, rows[i][2]) for i in range(40)]  # equal vectors: ties by id
    rows += [(2000, None, rows[0][2]), (2010, 1, None), (2020, 1, [None] * width), (2030, 1, [float("nan")] * width), (2040, 1, [float("inf")] * width), (None, 1, rows[1][2])]
    rows += [(2050, 1, [0.0] * width), (2060, 2, [1.5]), (2070, 2, []), (2080, 9, rows[3][2]), rows[10], (20, 2, rows[21][2])]
    return rows


@pytest.mark.parametrize("shard", [8192, 64])
def test_hard_negatives(spark, shard):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as anchor", "'c' as cell", "2 as x", "3 as score")
    got = sorted(map(tuple, hard_negatives(df, every=10, rows_per_shard=shard).collect()))
    want = brute_negatives(rows, 10)
    assert got == want and len(want) > 300 and any(r[5] == r[4] for r in want)
    assert hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives(df.filter("vec_id % 10 = 1"), every=10).count() == 0


def test_hard_negatives_of_huge_doubles(spark):
    rows = [(i, i % 2, [s * 10.0**e, 1e-3 * i]) for i, (s, e) in enumerate(itertools.product((1.0, -1.0, 0.9), (0, 3, 7, 9, 40, 200)))]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = sorted(map(tuple, hard_negatives(df, every=1).collect()))
    assert got == brute_negatives(rows, 1) and got


def test_cover_tree_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate((rng.normal(size=(300, 6)) * rng.random((300, 1)), np.repeat(rng.normal(size=(3, 6)), 100, axis=0))))
    scale = Scale(6, float(np.abs(x).max()), float(np.sqrt((x / np.abs(x).max()) ** 2 @ np.ones(6)).max()))
    unit = scale.augmented(x)
    tree = CoverTree(unit, fan_out=4, leaf=8)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(x))) and len(tree.levels) > 3
    rays = np.concatenate((x[:40] / np.linalg.norm(x[:40], axis=1)[:, None], np.zeros((40, 1))), axis=1)
    scores, reach = scale.scores(x[:40], x), scale.reach(x[:40])
    assert np.allclose(rays @ unit.T * reach[:, None], scores)
    every = tree.descend(rays, reach, np.full(40, -1e18), np.full(40, 1e18))
    for number, rows in enumerate(tree.leaves):
        assert (scores[:, rows].max(axis=1) <= every[:, number]).all()
    low, high = np.quantile(scores, 0.97, axis=1), np.quantile(scores, 0.99, axis=1)
    some = tree.descend(rays, reach, low, high)
    assert np.isinf(some).any()
    for number, rows in enumerate(tree.leaves):
        inside = (scores[:, rows] >= low[:, None]) & (scores[:, rows] <= high[:, None])
        assert not (inside.any(axis=1) & np.isinf(some[:, number])).any()
    upper, lower = bounds(np.array([[0.5]]), np.array([0.2]), np.array([10.0]))
    assert lower[0, 0] < 10 * np.cos(_angles(np.array(0.5)) + 0.2) < 10 * np.cos(_angles(np.array(0.5)) - 0.2) < upper[0, 0]


# --- Quality rules ---------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    n = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    lines = text.split("\n")
    copies = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(inside), failed


def quality_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 8)))
    good = lambda n: "\n".join(" ".join(word() for _ in range(rng.randrange(6, 20))) + "." for _ in range(n))
    poor = lambda n: "\n".join(" ".join(word() + rng.choice(["%%%", "###", " |"]) for _ in range(rng.randrange(6, 20))) for _ in range(n))
    texts = [(good(rng.randrange(3, 12)), 1) for _ in range(60)] + [(good(1) + "\n" + poor(rng.randrange(3, 9)), 0) for _ in range(40)]
    odd = [None, "", " \n\x0b", "one", "same line\n" * 40, "a b c d e f g h " * 3, "a b c d e f g h i " + good(4) + " a b c d e f g h", good(3000), "x" * 1_200_000, "ab " * 400_000, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 30, poor(2000)]
    return texts, odd, good, poor


def test_quality_rules(spark):
    texts, odd, _, _ = quality_texts()
    rows = [(k, t) for k, (t, _) in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(odd)] + [(1005, odd[5]), (None, texts[0][0]), (0, texts[0][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as poor", "2 as h", "map('a', 1) as bits", "3 as quality")
    labels = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(texts)] + [(None, 0), (5000, 1), (3, None)], "doc_id long, quality int")
    out = quality_rules(docs, labels).collect()
    assert len(out) == len(rows)
    expected = {i: brute_counts(t) for i, t in rows if i is not None and len(t or "") < 500_000}
    for r in out:
        if r.doc_id in expected:
            assert tuple(r)[1:7] == expected[r.doc_id], r.doc_id
        assert not (r.base_failed and r.kept)
    verdicts = {r.doc_id: r.kept for r in out if not r.base_failed}
    assert all(verdicts[k] == bool(q) for k, (_, q) in enumerate(texts) if k in verdicts)
    assert not verdicts[1011] and verdicts[1007]
    assert next(r for r in out if r.doc_id == 1009).n_repeat_words == 400_000
    assert judge(docs.limit(0), learn(docs, labels)).count() == 0


def test_quality_rules_without_labels(spark):
    texts, _, _, _ = quality_texts()
    docs = spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(texts)], "doc_id string, text string")
    for labels in ([], [("1", 1)]):
        table = spark.createDataFrame(labels, "doc_id string, quality int")
        assert all(r.kept != r.base_failed for r in quality_rules(docs, table).collect())


def test_texts_measured_together_equal_texts_measured_alone():
    texts, odd, _, _ = quality_texts()
    every = [t for t, _ in texts] + [t or "" for t in odd if len(t or "") < 500_000]
    for together, text in zip(measure(every), every, strict=True):
        (alone,) = measure([text])
        assert (together.n_words, together.n_repeat_words, together.n_dup_lines) == (alone.n_words, alone.n_repeat_words, alone.n_dup_lines)
        assert (together.bits == alone.bits).all() and (together.sizes == alone.sizes).all()


def path_score(model, bits, path):
    gain = bits @ model.weights
    return sum(g for g, s in zip(gain, path, strict=True) if s) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))


def test_viterbi_and_sums_equal_all_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        model = LineModel(rng.normal(size=BITS), rng.normal(size=(2, 2)) * 2)
        bits = rng.random((n, BITS)) < 0.1
        paths = list(itertools.product((0, 1), repeat=n))
        score = np.array([path_score(model, bits, p) for p in paths])
        assert tuple(model.label(bits).astype(int)) == paths[score.argmax()]
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        held = np.array([[True] * n + [False] * 2])
        gain = np.concatenate((bits @ model.weights, [0, 0]))[None]
        chance, moved = _expected(gain, held, model.moves)
        assert np.allclose(chance[0, :n], [sum(w for w, p in zip(weight, paths, strict=True) if p[t]) for t in range(n)])
        assert np.allclose(moved, [[sum(w * sum(q == (a, b) for q in itertools.pairwise(p)) for w, p in zip(weight, paths, strict=True)) for b in (0, 1)] for a in (0, 1)])


def test_fit_tells_lines_of_a_mixed_text_apart():
    texts, _, good, poor = quality_texts()
    rows = [(not q, m.bits.astype(float)) for (_, q), m in zip(texts, measure([t for t, _ in texts]), strict=True)]
    model = fit(rows)
    (mixed,) = measure([good(3) + "\n" + poor(4) + "\n" + good(2)])
    assert model.label(mixed.bits).tolist() == [False] * 3 + [True] * 4 + [False] * 2
    assert not fit([r for r in rows if not r[0]]).label(mixed.bits).any()
