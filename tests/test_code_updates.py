"""Symbols and edges that follow changes equal those of a full build."""

import ast
import random
from collections import Counter
from pathlib import Path

import gleanery.plans
from gleanery.operators import code
from gleanery.sources.snapshots import read_latest_snapshot
from gleanery.streaming.incremental import follow_code

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
FILE = "project_id string, path string, content string, created_at long"


def versions(seed):
    """Files of two projects over four steps: changed, new, deleted and brought back."""
    rng, files = random.Random(seed), {}
    for step in range(4):
        changed = {}
        for _ in range(7):
            key = (rng.choice("pq"), f"pkg/m{rng.randrange(6)}.py")
            body = "".join(f"def f{rng.randrange(6)}():\n    return f{rng.randrange(6)}()\n" for _ in range(rng.randrange(1, 4)))
            imports = "".join(f"import pkg.m{rng.randrange(7)}\nfrom pkg.m{rng.randrange(7)} import f{rng.randrange(6)}\n" for _ in range(2))
            changed[key] = rng.choice([None, imports + body, imports + body, body])
        files.update(changed)
        yield step, changed, {k: v for k, v in files.items() if v is not None}


def full(spark, files):
    contents = spark.createDataFrame([(p, f, c, 0) for (p, f), c in files.items()], FILE)
    parsed = code.parse_python(contents)
    symbols = code.python_symbols(parsed, NAMESPACE)
    edges = code.python_edges(parsed, symbols, NAMESPACE)
    rest = code.resolve_edges(edges.filter("kind not in ('contains', 'defines')"), symbols)
    fixed = edges.filter("kind in ('contains', 'defines')").selectExpr("*", "1L as matches", "target_reference as target_symbol")
    return symbols, fixed.unionByName(rest)


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


SEEN = {"edges": ["project_id", "path", "relationship_id", "matches", "resolution", "target_symbol"], "symbols": ["project_id", "path", "symbol_id", "qualified_name", "parent_symbol_id"]}


def test_updates_equal_a_full_build(spark):
    state = [spark.createDataFrame([], schema) for schema in (code.SYMBOLS, code.EDGES, code.COUNTS)]
    for _, changed, files in versions(2):
        state = code.update_code(*state, spark.createDataFrame([(*k, c, 0) for k, c in changed.items()], FILE), NAMESPACE)
    symbols, edges = full(spark, files)
    assert rows(state[0], SEEN["symbols"]) == rows(symbols, SEEN["symbols"])
    assert rows(state[1], SEEN["edges"]) == rows(edges, SEEN["edges"])
    assert {"ambiguous", "unresolved", "resolved_internal"} == {r.resolution for r in state[1].collect()}
    counts = lambda df: rows(df.selectExpr("project_id", "key", "n", "mn", "if(n = 1, s, null) as s", "if(mn = 1, ms, null) as ms"), ["project_id", "key", "n", "mn", "s", "ms"])
    assert counts(state[2]) == counts(code.suffix_counts(symbols))


def test_a_stream_of_versions_equals_a_full_build(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for step, changed, files in versions(5):
        if step == 3:
            break
        spark.createDataFrame([(*k, c, step) for k, c in changed.items()], FILE).coalesce(1).write.mode("append").parquet(source)
        follow_code(spark.readStream.schema(FILE).parquet(source), root, str(tmp_path / "check"), NAMESPACE).awaitTermination(120)
        now = files
    symbols, edges = full(spark, now)
    for kind, expected in (("symbols", symbols), ("edges", edges)):
        assert rows(read_latest_snapshot(spark, root, kind), SEEN[kind]) == rows(expected, SEEN[kind])


def test_no_helper_of_the_queries_is_defined_twice():
    """A second helper of the same name would be taken by the queries of the first, as happened to python_edges."""
    for file in Path(gleanery.plans.__file__).parent.glob("*.py"):
        names = Counter(node.name for node in ast.parse(file.read_text()).body if isinstance(node, ast.FunctionDef))
        assert [name for name, n in names.items() if n > 1 and name != "_"] == [], file.name


TWICE = "class A:\n    def f(self):\n        return A\n\n\nclass A:\n    def g(self):\n        return f\n"


def test_parents_come_with_the_facts_of_their_file(spark):
    """No join, so nothing of a table that Python made goes through the driver; of repeated names the last is the parent."""
    parsed = code.parse_python(spark.createDataFrame([("p", f"a{k}.py", TWICE) for k in range(1, 3)], "project_id string, path string, content string"))
    symbols = code.python_symbols(parsed, NAMESPACE)
    edges = code.python_edges(parsed, symbols, NAMESPACE)
    for rows in (symbols, edges):
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    found = symbols.filter("path = 'a1.py'").collect()
    last = max((r for r in found if r.kind == "class"), key=lambda r: r.start_line)
    module = next(r for r in found if r.kind == "module")
    assert {r.name: r.parent_symbol_id for r in found} == {"a1": None, "A": module.symbol_id, "f": last.symbol_id, "g": last.symbol_id}
    assert edges.filter("path = 'a1.py'").count() == 4 * 2 + 2
