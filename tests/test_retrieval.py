import math
from itertools import accumulate

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions.search import candidates, containing, text_index
from gleanery.functions.text import fold, identifier_parts, token_estimate, uuid5
from gleanery.operators import audit, code, evaluation, retrieval, terms
from gleanery.operators.budget import greedy


def test_text_functions(spark):
    values = ["STRAßE", "Σας", "İx", "plain", "ﬃ", "ſ", None, ""]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", fold(F.col("v")).alias("f")).collect()
    assert [r.f for r in rows] == [None if v is None else v.casefold() for v in values]
    one = spark.range(1).select(identifier_parts(F.lit("CaféService2Go.snake_case-kebab")).alias("p"), *(token_estimate(F.lit(n)).alias(f"t{n}") for n in (0, 1, 3, 40, 41)), uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.lit("x:y")).alias("u")).first()
    assert one.p == ["café", "service2", "go", "snake", "case", "kebab"]
    assert [one.t0, one.t1, one.t3, one.t40, one.t41] == [0, 1, 1, 11, 12]
    import uuid

    assert one.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:y"))


def test_operation_hints(spark):
    rows = spark.createDataFrame([("t", "Renomear a função e explain `run_job`", "modify")], "task_id string, task_text string, task_kind string")
    assert terms.operation_hints(rows).first().operation_hints == ["modify", "rename", "explain"]
    signals = terms.normalize_tasks(rows).first()
    assert signals.symbols == ["run_job"] and "run" in signals.keywords and "explain" not in signals.keywords


def test_frequency_outranks_single_words(spark):
    units = spark.createDataFrame([("u1", "a.py", "cache unrelated words"), ("u2", "b.py", "cache cache"), ("u3", "c.py", "nothing")], "unit_id string, path string, text string")
    tasks = spark.createDataFrame([("t", ["cache", "two_part"], 'about "cache cache"')], "task_id string, terms array<string>, task_text string")
    out = retrieval.lexical_rank(tasks, units).orderBy("rank").collect()
    assert [r.unit_id for r in out] == ["u2", "u1"]
    assert [r.score for r in out] == [0.5 + 0.25 + 0.25, round(0.5 + 0.25 / 3, 8)]


def test_traversal_weights_and_first_visit(spark):
    edges = spark.createDataFrame([("r1", "a", "b", "imports", "resolved_internal"), ("r2", "b", "c", "depends_on", "resolved_internal"), ("r3", "a", "c", "documents", "unresolved"), ("r4", "c", "d", "calls", "resolved_internal")], "relationship_id string, source_reference string, target_reference string, kind string, resolution string")
    seeds = spark.createDataFrame([("t", "a", 0)], "task_id string, reference string, pos int")
    known = spark.createDataFrame([("b",), ("c",), ("d",)], "reference string")
    out = retrieval.dependency_traversal(seeds, edges, known).orderBy("seq").collect()
    assert [(r.target, r.weight, r.path) for r in out] == [("b", 0.95, "a>b"), ("c", 0.76, "a>b>c")]


def test_fan_out_is_cut_before_visits(spark):
    edges = spark.createDataFrame([(f"r{i:02}", "hub", f"n{i:02}", "imports", "resolved_internal") for i in range(30)], "relationship_id string, source_reference string, target_reference string, kind string, resolution string")
    seeds = spark.createDataFrame([("t", "hub", 0), ("t", "n00", 1)], "task_id string, reference string, pos int")
    known = edges.select(F.col("target_reference").alias("reference"))
    assert retrieval.dependency_traversal(seeds, edges, known).count() == 19


CANDIDATES = "task_id string, pos int, candidate_id string, artifact_id string, bytes long, characters long, tokens long, is_excerpt boolean"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 4), st.booleans()), min_size=1, max_size=25), st.integers(20, 150), st.integers(1, 6))
def test_greedy_never_exceeds_and_skips_what_is_too_large(spark, items, most_bytes, most_items):
    rows = [("t", n, f"c{n:02}", f"a{a}", b, b, b // 4, e) for n, (b, a, e) in enumerate(items)]
    budgets = spark.createDataFrame([("t", most_bytes, most_items, 3, 2)], "task_id string, max_bytes int, max_items int, max_artifacts int, max_excerpts int")
    got = [r.candidate_id for r in greedy(spark.createDataFrame(rows[::-1], CANDIDATES).repartition(3), budgets).filter("fits").orderBy("selected_rank").collect()]
    chosen, used, files, excerpts = [], 0, set(), 0
    for _, _, c, a, b, _, _, e in rows:
        if used + b <= most_bytes and len(chosen) < most_items and len(files | {a}) <= 3 and excerpts + e <= 2:
            chosen.append(c)
            used, files, excerpts = used + b, files | {a}, excerpts + e
    assert got == chosen and used <= most_bytes


def judged(spark, levels, ranks):
    j = spark.createDataFrame([("c", p, r) for p, r in levels.items()], "case_id string, path string, relevance string")
    s = spark.createDataFrame([("c", "s", p, r) for p, r in ranks.items()], "case_id string, strategy_id string, path string, rank int")
    rows = evaluation.retrieval_metrics(j, s, spark.createDataFrame([("s",)], "strategy_id string"), ks=(1, 2, 3)).collect()
    return {r.metric_name: r.value for r in rows}


def test_metrics_by_hand(spark):
    m = judged(spark, {"a": "required", "b": "supporting"}, {"b": 1, "a": 2})
    assert math.isclose(m["ndcg"], (1 / math.log2(2) + 3 / math.log2(3)) / (3 / math.log2(2) + 1 / math.log2(3)))
    assert m["reciprocal-rank"] == 0.5 and m["complete-evidence"] == 1
    m = judged(spark, {"a": "required", "b": "required", "x": "irrelevant"}, {"x": 1, "a": 2, "b": 3})
    assert [m[f"recall-at-{k}"] for k in (1, 2, 3)] == [0, 0.5, 1]
    assert math.isclose(m["judged-precision"], 2 / 3)
    m = judged(spark, {"x": "irrelevant"}, {"y": 1})
    assert (m["required-artifact-recall"], m["judged-precision"], m["reciprocal-rank"], m["ndcg"], m["complete-evidence"]) == (1, 1, 0, 0, 1)


def test_dependency_boost_is_four(spark):
    units = spark.createDataFrame([("u1", "src/app.py", "greeting service greeting render handler export"), ("u2", "src/dep.py", "other")], "unit_id string, path string, text string")
    tasks = spark.createDataFrame([("t", ["greeting", "service", "render", "handler", "export", "dep"])], "task_id string, search_terms array<string>")
    edges = spark.createDataFrame([("r", "src/app.py", "src/dep.py", "imports", "resolved_internal")], "relationship_id string, source_path string, target_path string, kind string, resolution string")
    out = {r.candidate_id: r for r in retrieval.boost_dependencies(retrieval.suppress_historical(retrieval.score_units(tasks, units), units), edges).collect()}
    assert out["u1"].score == 5 and out["u2"].structural_boost == 1 and out["u2"].score == 4
    wide = spark.createDataFrame([("t", ["greeting", "service", "render", "handler", "export", "src/app", "app", "dep"])], "task_id string, search_terms array<string>")
    out = {r.candidate_id: r for r in retrieval.boost_dependencies(retrieval.suppress_historical(retrieval.score_units(wide, units), units), edges).collect()}
    assert out["u2"].structural_boost == 4


def test_path_evidence_comes_before_dependency(spark):
    kinds = ["explicit-x", "dependency-traversal-path", "dependency-x", "relationship-y", "none"]
    rows = spark.createDataFrame([(k,) for k in kinds], "k string").select(retrieval.component_of(F.col("k")).alias("c")).collect()
    assert [r.c for r in rows] == ["explicit_reference", "path_match", "dependency_distance", "dependency_distance", None]


def test_resolution_with_module_fallback(spark):
    symbols = spark.createDataFrame([("p", "s1", "module", "pkg.mod"), ("p", "s2", "function", "pkg.mod.run"), ("p", "s3", "function", "pkg.other.run")], "project_id string, symbol_id string, kind string, qualified_name string")
    edges = spark.createDataFrame([("e1", "p", "python-name:run"), ("e2", "p", "python-module:..mod.run"), ("e3", "p", "python-module:pkg.mod.missing"), ("e4", "p", "python-name:none")], "relationship_id string, project_id string, target_reference string")
    out = {r.relationship_id: (r.resolution, r.target_symbol) for r in code.resolve_edges(edges, symbols).collect()}
    assert out == {"e1": ("ambiguous", None), "e2": ("resolved_internal", "s2"), "e3": ("resolved_internal", "s1"), "e4": ("unresolved", None)}


def test_header_like_content_of_a_hunk(spark):
    patch = "--- a/x\n+++ b/x\n@@ -1,2 +1,1 @@\n--- old\n context\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-a\n+b"
    stats = audit.diff_stats(audit.diff_lines(spark.createDataFrame([(1, patch)], "patch_id int, patch string"))).orderBy("file").collect()
    assert [(r.new_path, r.added, r.removed, r.consistent) for r in stats] == [("x", 0, 1, True), ("y", 1, 1, True)]


def test_lines_of_random_diffs_equal_a_walk(spark):
    import random
    import re

    rng = random.Random(4)
    head = lambda: f"@@ -{rng.randrange(9)}" + rng.choice(["", f",{rng.randrange(4)}"]) + f" +{rng.randrange(9)}" + rng.choice(["", f",{rng.randrange(4)}"]) + " @@"
    pick = lambda: rng.choice(["--- a/x", "+++ b/x", "-old", "+new", " same", "\\ No newline", "", "diff --git", "--- ", head(), head()])
    patches = {k: "\n".join(pick() for _ in range(rng.randrange(0, 40))) for k in range(80)} | {90: None}

    def walk(patch):
        old, new, begun = 0, 0, False
        for line in patch.split("\n"):
            found = re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)
            first = line[:1]
            if found:
                begun, old, new = True, *(int(g) if g is not None else 1 for g in found.groups())
                yield "hunk"
            elif begun and (old > 0 or new > 0):
                kind = {"-": "remove", "+": "add", "\\": "no_newline"}.get(first, "context")
                old, new = old - (kind in ("remove", "context")), new - (kind in ("add", "context"))
                yield kind
            elif first == "\\":
                yield "no_newline"
            elif line.startswith(("--- ", "+++ ")):
                yield "old_file" if first == "-" else "new_file"
            else:
                yield {"-": "remove", "+": "add", " ": "context"}.get(first, "other") if begun else "other"

    out = audit.diff_lines(spark.createDataFrame(list(patches.items()), "patch_id int, patch string"))
    every = {(r.patch_id, r.n): r.kind for r in out.collect()}
    assert every == {(k, n): kind for k, p in patches.items() if p is not None for n, kind in enumerate(walk(p))}
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()


def test_rename_cycles(spark):
    rows = [(1, n, "rename", a, b) for n, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y"), ("s", "s")])] + [(2, 9, "rename", "a", "b")]
    df = spark.createDataFrame(rows, "proposal_id int, change_id int, operation string, path string, destination_path string")
    assert sorted((r.proposal_id, r.first_path, r.length) for r in audit.rename_cycles(df).collect()) == [(1, "a", 3), (1, "s", 1)]
    assert audit.rename_cycles(df.filter("path = 'x'")).count() == 0


def test_sums_of_greedy_sizes_are_no_running_sum(spark):
    rows = [("t", n, f"c{n}", "a", b, b, 0, False) for n, b in enumerate([60, 50, 40, 1])]
    budgets = spark.createDataFrame([("t", 100)], "task_id string, max_bytes int")
    got = [r.candidate_id for r in greedy(spark.createDataFrame(rows, CANDIDATES), budgets).filter("fits").orderBy("pos").collect()]
    assert got == ["c0", "c2"] != [f"c{n}" for n, s in enumerate(accumulate([60, 50, 40, 1])) if s <= 100]


def test_many_tasks_and_queries(spark):
    from gleanery.operators import index

    units = spark.createDataFrame([(f"u{i}", f"src/f{i}.py", f"word{i} word{i + 1}", f"p{i % 3}") for i in range(30)], "unit_id string, path string, text string, project_id string")
    tasks = spark.createDataFrame([(i, [f"word{i}"], f"p{i % 3}") for i in range(6_001)], "task_id long, search_terms array<string>, project_id string")
    found = {(r.task_id, r.candidate_id) for r in retrieval.score_units(tasks.drop("project_id"), units).collect()}
    hit = lambda i, k: f"word{i}" in f"word{k} word{k + 1}"
    assert found == {(i, f"u{k}") for i in range(100) for k in range(30) if hit(i, k)}
    assert {(r.task_id, r.candidate_id) for r in retrieval.score_units(tasks, units).collect()} == {(i, u) for i, u in found if i % 3 == int(u[1:]) % 3}
    queries = spark.createDataFrame([(f"Word{i}",) for i in range(2_500)] + [(None,), ("Word7",)], "query string")
    assert {(r.query, r.unit_id) for r in index.find_text(units, queries).collect()} == {(f"Word{i}", u) for i, u in found}
    assert index.find_text(units, queries.limit(0)).count() == 0


def test_phrases_in_texts_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    piece = lambda: "".join(rng.choice("abé1") for _ in range(rng.randrange(1, 4)))
    mark = lambda: rng.choice([" ", "_", ".", "--", " - "])
    text = lambda n: "".join(piece() + mark() for _ in range(n))
    texts = {i: text(rng.randrange(0, 30)) for i in range(120)} | {200: "", 201: None, 202: "a" * 3_000}
    phrases = ["", "-", " ", "_", "a", "aa", "é", "1.", ".1", "a_b", "nothing here", "b - a"]
    for t in list(texts.values())[:100]:
        if t:
            at = rng.randrange(len(t))
            phrases.append(t[at : at + rng.randrange(1, 25)])
    found = containing(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame([(p,) for p in [*phrases, phrases[-1]]] + [(None,)], "phrase string"))
    got = [tuple(r) for r in found.select("id", "phrase").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, p) for i, t in texts.items() if t is not None for p in phrases if p in t}
    nothing = spark.createDataFrame([], "id long, text string")
    assert containing(nothing, spark.createDataFrame([("a b c",)], "phrase string")).count() == 0


def test_ancestors_of_any_depth(spark):
    chain = spark.range(40).selectExpr("concat('s', id) as symbol_id", "concat('n', id) as name", "if(id > 0, concat('s', id - 1), null) as parent_symbol_id")
    units = spark.range(40).selectExpr("concat('u', id) as unit_id", "id as ord", "array(concat('s', id)) as symbol_ids")
    edges = spark.createDataFrame([], "source_reference string, unit_id string, kind string")
    out = retrieval.structural_candidates(spark.createDataFrame([("t", "n39")], "task_id string, name string"), chain, units, edges)
    assert {r.unit_id: r.role for r in out.collect()} == {f"u{i}": "definition" if i == 39 else "scope" for i in range(40)}


def test_greedy_does_not_gather_a_task_into_one_row(spark):
    rows = spark.range(20_000).select(F.lit("t").alias("task_id"), (-F.col("id")).cast("int").alias("pos"), F.col("id").cast("string").alias("candidate_id"), (F.col("id") % 7).cast("string").alias("artifact_id"), F.lit(2).cast("long").alias("bytes"), F.lit(2).cast("long").alias("characters"), F.lit(1).cast("long").alias("tokens"), F.lit(True).alias("is_excerpt"))
    out = greedy(rows, spark.createDataFrame([("t", 30_001, 3)], "task_id string, max_bytes long, max_artifacts long"))
    taken = [i for i in range(19_999, -1, -1) if i % 7 in {19_999 % 7, 19_998 % 7, 19_997 % 7}][:15_000]
    assert {r.candidate_id: r.selected_rank for r in out.filter("fits").collect()} == {str(i): k + 1 for k, i in enumerate(taken)}
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_fallback_takes_the_smallest_files(spark):
    units = spark.createDataFrame([(f"f{i:02d}", "x" * (i % 7 + 1)) for i in range(30)] + [("f00", "y")], "path string, text string")
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string")
    expected = [f"artifact-{p}" for _, p in sorted((i % 7 + 1 + (i == 0), f"f{i:02d}") for i in range(30))]
    for limits in ([("a", 4, 6), ("b", 9, 11), ("c", 1, 1)], [("a", 4, 6), ("b", None, 11), ("c", 1, 1)]):
        budgets = spark.createDataFrame(limits, "task_id string, max_items long, max_bytes long")
        out = retrieval.fallback_smallest(tasks, tasks.filter("task_id = 'c'"), units, budgets).collect()
        got = {t: [r.candidate_id for r in sorted((r for r in out if r.task_id == t), key=lambda r: r.selected_rank)] for t in "abc"}
        assert got == {"a": expected[:4], "b": expected[: len(got["b"])], "c": []} and len(got["b"]) > 4


def test_parts_of_very_long_tokens(spark):
    """Pieces of a long token overlap, so parts across their ends are found; its letters enter no shuffle."""
    import random

    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(3_000))
    texts = {1: f"x {long} y", 2: long[:65], 3: long[10:74], 4: "𝄞" + "é𝄞" * 90, 5: "A" + long[:64], 6: long[500:900]}
    phrases = [long[a : a + n] for a in (0, 1, 60, 63, 64, 65, 127, 128, 700, 2_900) for n in (2, 4, 30, 64, 65, 129, 400)] + ["x " + long[:5], long[-3:] + " y", "é𝄞é", "z"]
    found = containing(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert {tuple(r) for r in found.select("id", "phrase").collect()} == {(i, p) for i, t in texts.items() for p in phrases if p in t}


def test_first_places_equal_the_full_rank(spark):
    import random

    rng = random.Random(5)
    words = [f"word{i}" for i in range(30)]
    units = spark.createDataFrame([(f"u{i:03d}", f"src/{rng.choice(words)}_{i % 9}.py", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(150)], "unit_id string, path string, text string")
    rows = [(f"t{i}", rng.sample(words, rng.randrange(1, 8)), f'say "{rng.choice(words)} {rng.choice(words)}" or `{rng.choice(["-", "_1", "zzz"])}`') for i in range(25)]
    rows += [("none", ["absent"], "nothing"), ("path", ["src"], ""), ("phrase", ["absent"], f'"{words[0]} "')]
    tasks = spark.createDataFrame(rows, "task_id string, terms array<string>, task_text string")
    full = {tuple(r) for r in retrieval.lexical_rank(tasks, units).collect()}
    for k in (1, 4, 40):
        got = [tuple(r) for r in retrieval.lexical_rank(tasks, units, k).collect()]
        assert len(got) == len(set(got)) and set(got) == {r for r in full if r[3] <= k}


def test_fallback_passes_over_files_without_text(spark):
    units = spark.createDataFrame([("n1", None), ("n2", None), ("a", "x" * 10), ("b", "x" * 20), ("c", "x" * 30), ("d", None), ("d", "")], "path string, text string")
    tasks = spark.createDataFrame([("t",)], "task_id string")
    for items, expected in ((2, ["artifact-d", "artifact-a"]), (3, ["artifact-d", "artifact-a", "artifact-b"])):
        budgets = spark.createDataFrame([("t", items, 1000)], "task_id string, max_items long, max_bytes long")
        out = retrieval.fallback_smallest(tasks, tasks.limit(0), units, budgets).orderBy("selected_rank")
        assert [r.candidate_id for r in out.collect()] == expected


def test_a_name_of_many_files_does_not_fan_out(spark):
    files = spark.range(500).selectExpr("concat('a', id) as artifact_id", "concat('d', id, '/Shared.py') as path")
    terms = spark.createDataFrame([(f"t{i}", "filename", "shared.py", "shared.py") for i in range(50)] + [("t0", "path", "D3/shared.py", "d3/shared.py"), ("t1", "path", "d3/Shared.py", "d3/shared.py")], "task_id string, kind string, original string, normalized string")
    symbols = spark.createDataFrame([], "symbol_id string, name string, qualified_name string")
    out = {(r.task_id, r.kind): (r.outcome, r.matches, r.target) for r in retrieval.resolve_explicit(terms, files, symbols).collect()}
    assert out["t5", "filename"] == ("ambiguous", 500, None) and out["t0", "path"] == ("selected", 1, "a3") == out["t1", "path"]
    assert ("t0", "filename") not in out and len(out) == 50


CANDIDATE = "task_id string, candidate_id string, artifact_id string, type string, reason string, eligibility string, deferred boolean, bytes long, tokens long, characters long"


def planned(spark, rows, budgets, reserved=None):
    made = spark.createDataFrame([("t", c, None, kind, reason, "eligible", False, size, tokens, chars) for c, kind, reason, size, tokens, chars, _ in rows], CANDIDATE)
    scores = spark.createDataFrame([("t", r[0], r[-1]) for r in rows], "task_id string, candidate_id string, rank int")
    selection, usage = retrieval.plan_under_budget(made, scores, budgets, reserved)
    return {r.candidate_id: r.outcome for r in selection.collect()}, {r.task_id: tuple(r)[1:] for r in usage.collect()}


def test_budget_usage_and_overflow(spark):
    limits = spark.createDataFrame([("t", 50, 50, 15), ("none", 10, None, None)], "task_id string, max_bytes long, max_characters long, max_estimated_tokens long")
    high, low = ("high", "full_artifact", "x", 40, 10, 30, 1), ("low", "full_artifact", "x", 40, 10, 30, 2)
    outcomes, usage = planned(spark, [low, high], limits)
    assert outcomes == {"high": "selected", "low": "budget_exceeded"}
    assert usage == {"t": (10, 30, 40, 1, 0, 0, False, False, None), "none": (0, 0, 0, 0, 0, 0, False, False, None)}
    outcomes, usage = planned(spark, [high], limits, {"tokens": 6, "characters": 11, "bytes": 11})
    assert outcomes == {"high": "budget_exceeded"}
    assert usage["t"] == (0, 0, 0, 0, 0, 0, False, False, None) and usage["none"][-3:] == (True, False, "RETRIEVAL_BUDGET_EXCEEDED")
    must = ("must", "source_excerpt", "required_context", 45, 1, 1, 9)
    outcomes, usage = planned(spark, [high, must, ("huge", "source_excerpt", "required_context", 60, 1, 1, 10)], limits)
    assert outcomes == {"must": "selected", "high": "budget_exceeded", "huge": "budget_exceeded"}
    assert usage["t"] == (1, 1, 45, 1, 0, 1, False, True, "RETRIEVAL_BUDGET_EXCEEDED")


def test_fold_equals_one_by_one(spark):
    import random

    rng = random.Random(8)
    rows, limits = [], []
    for t in range(12):
        limits.append((t, *(rng.choice([None, rng.randrange(1, 400)]) for _ in range(5))))
        rows += [(t, k, f"c{k:05d}", rng.choice([None, *"abcdef"]), rng.choice([None, *range(1, 60)]), rng.randrange(1, 60), rng.randrange(0, 20), rng.random() < 0.5) for k in range(rng.choice([0, 5, 700, 2500]))]
    cols = ["max_bytes", "max_characters", "max_estimated_tokens", "max_artifacts", "max_items"]
    budgets = spark.createDataFrame(limits, "task_id int, " + ", ".join(f"{c} int" for c in cols))
    made = spark.createDataFrame(rows, "task_id int, pos int, candidate_id string, artifact_id string, bytes long, characters long, tokens long, is_excerpt boolean")
    got = {(r.task_id, r.candidate_id): r.selected_rank for r in greedy(made, budgets).filter("fits").collect()}
    expected = {}
    for t, by, ch, tk, art, items in limits:
        used, seen, n = [0, 0, 0], set(), 0
        for _, _, c, a, b, h, k, _ in (r for r in rows if r[0] == t):
            fits = all(m is None or v is not None and u + v <= m for u, v, m in zip(used, (b, h, k), (by, ch, tk), strict=True))
            if fits and (items is None or n < items) and (art is None or len(seen | ({a} - {None})) <= art):
                used, seen, n = [u + (v or 0) for u, v in zip(used, (b, h, k), strict=True)], seen | ({a} - {None}), n + 1
                expected[t, c] = n
    assert got == expected and len(got) > 50


def test_traversal_limits_as_a_queue_meets_them(spark):
    """Against a queue that is worked off node by node."""
    import random
    from collections import deque

    rng = random.Random(11)
    edges = sorted({(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice(["calls", "imports"])) for _ in range(260)} | {("hub", f"n{i}", "calls") for i in range(30)})
    table = spark.createDataFrame([(f"{a}>{b}>{k}", a, b, k, "resolved_internal") for a, b, k in edges], "relationship_id string, source_reference string, target_reference string, kind string, resolution string")
    entities = {f"n{i}" for i in range(60) if i % 4}
    seeds = [(f"t{t}", s, p) for t in range(30) for p, s in enumerate(rng.sample([f"n{i}" for i in range(60)] + ["hub", "alone"], 1 + t % 3))]

    def queue(starts, depth, most, fan):
        waiting, seen, found, flags = deque((s, 0) for s in starts), set(starts), 0, [False, False]
        while waiting and found < most:
            node, at = waiting.popleft()
            out = sorted((k, b) for a, b, k in edges if a == node)
            if at >= depth:
                flags[0] |= bool(out)
                continue
            flags[1] |= len(out) > fan
            for _, b in out[:fan]:
                if b not in seen:
                    seen.add(b)
                    found += b in entities
                    if b in entities and found >= most:
                        break
                    waiting.append((b, at + 1))
        return (*flags, bool(waiting) and found >= most)

    for depth, most, fan in ((2, 50, 20), (2, 6, 3), (1, 3, 2), (2, 2, 20)):
        out = retrieval.traversal_limits(spark.createDataFrame(seeds, "task_id string, reference string, pos int"), table, spark.createDataFrame([(e,) for e in entities], "reference string"), depth, most, fan)
        got = {r.task_id: (r.depth_limited, r.fan_out_limited, r.candidate_limited) for r in out.collect()}
        expected = {t: queue([s for u, s, _ in seeds if u == t], depth, most, fan) for t, _, _ in seeds}
        assert got == expected


def test_greedy_holds_a_task_together_where_spark_turns_a_join_into_a_broadcast(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        one = lambda c: F.lit(1).cast("long").alias(c)
        rows = spark.range(2000, numPartitions=8).select(
            (F.col("id") % 3).alias("task_id"), one("pos"), F.format_string("c%09d", "id").alias("candidate_id"),
            F.lit("a").alias("artifact_id"), one("bytes"), one("characters"), one("tokens"), F.lit(False).alias("is_excerpt"),
        )
        budgets = rows.select("task_id").distinct().withColumn("max_items", F.lit(10))
        got = greedy(rows, budgets).filter("fits").select("task_id", "candidate_id", "selected_rank").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r.task_id, r.selected_rank, r.candidate_id) for r in got) == [(t, n + 1, f"c{t + 3 * n:09d}") for t in range(3) for n in range(10)]


def test_few_keys_go_to_the_occurrences_of_an_index(spark):
    index = text_index(spark.range(300).select(F.col("id").cast("string").alias("id"), F.concat_ws(" ", *(F.sha1((F.col("id") * 20 + k).cast("string")) for k in range(20))).alias("text")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = candidates(index, spark.createDataFrame([("356a192b7913",), ("nothing",)], "phrase string"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert [r.id for r in out.collect()] == ["0"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
