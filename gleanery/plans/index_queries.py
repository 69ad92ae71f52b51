"""Queries on index tables, task terms and code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sets import spread
from ..functions.shared import written
from ..operators import code, index, scan, terms
from . import views
from .views import FOLD, with_views

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


_ROUTE = """r AS (SELECT project_id, doc_id, (doc_id // 20) % 10 AS p, CASE
  WHEN doc_id % 13 = 0 THEN 'skipped:not_included' WHEN (doc_id // 20) % 10 = 5 THEN 'skipped:binary' WHEN (doc_id // 20) % 10 = 6
  THEN 'skipped:sensitive'
  WHEN doc_id % 17 = 0 THEN 'failed:missing_content' WHEN doc_id % 19 = 0 THEN 'failed:fingerprint_mismatch' WHEN size_bytes >
  20000 THEN 'metadata:too_large'
  WHEN (doc_id // 20) % 10 IN (0, 2, 8) THEN 'indexed:python' ELSE 'indexed:generic' END AS x FROM artifacts)"""


def _routed(spark, sf_dir):
    rows = views.artifacts(spark, sf_dir)
    labels = scan.classify_artifacts(
        rows.withColumns(
            {"binary_sample": F.lit(False), "generated_sample": F.lit(False), "sensitive_sample": F.lit(False), "encoding": F.lit("utf-8")}
        )
    )
    records = labels.select(
        "project_id", "doc_id", "path", "kind", "classifications", "detected_language",
        F.when(F.col("doc_id") % 13 == 0, "exclude").otherwise("include").alias("ignore_action"),
        F.when(F.col("doc_id") % 19 == 0, "sha256:old").otherwise(scan.content_fingerprint(F.col("content"))).alias("content_fingerprint"),
    )
    return index.route_artifacts(records, rows.filter("doc_id % 17 <> 0"), max_content_bytes=20_000)


@query(
    "route_artifacts",
    with_views(
        ["artifacts"],
        f"{_ROUTE} SELECT doc_id, split_part(x, ':', 1) AS state, CASE WHEN x LIKE 'indexed:%' THEN split_part(x, ':', 2) END AS strategy, CASE WHEN x NOT LIKE 'indexed:%' THEN split_part(x, ':', 2) END AS diagnostic FROM r",
    ),
)
def _(spark, sf_dir):
    return _routed(spark, sf_dir).select("doc_id", "state", "strategy", "diagnostic")


@query("index_statistics", with_views(["artifacts", "search_units"], f"""{_ROUTE},
u AS (SELECT project_id, count(*) AS units FROM search_units GROUP BY 1),
g AS (SELECT project_id, count(*) AS evaluated, count(*) FILTER (WHERE x LIKE 'indexed%') AS indexed, count(*) FILTER (WHERE x
  LIKE 'skipped%') AS skipped, count(*) FILTER (WHERE x LIKE 'metadata%') AS metadata_only, count(*) FILTER (WHERE x LIKE
  'failed%') AS failures, coalesce(sum(b) FILTER (WHERE x LIKE 'indexed%'), 0)::BIGINT AS indexed_bytes, count(*) FILTER (WHERE x = 'indexed:python' AND doc_id % 7 = 0) AS fallbacks,
  count(*) FILTER (WHERE x LIKE 'indexed%' AND doc_id % 3 = 0) AS reused FROM (SELECT r.*, size_bytes AS b FROM r JOIN artifacts USING (doc_id)) GROUP BY 1)
SELECT g.*, coalesce(units, 0) AS units, CASE WHEN evaluated = failures THEN 'failed' WHEN failures > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM g LEFT JOIN u USING (project_id)"""))
def _(spark, sf_dir):
    routed = _routed(spark, sf_dir).withColumns(
        {"fallback": (F.col("strategy") == "python") & (F.col("doc_id") % 7 == 0), "reused": F.col("doc_id") % 3 == 0}
    )
    return index.index_statistics(routed, units=views.search_units(spark, sf_dir))


_UNITS = """l AS (SELECT doc_id, project_id, path, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT *, string_split(content, chr(10)) AS s FROM artifacts)),
p AS (
  SELECT doc_id, project_id, path, n, 0 AS k, 0 AS start, line AS rest FROM l WHERE line <> ''
  UNION ALL
  SELECT doc_id, project_id, path, n, k + 1, start + c, substr(rest, c + 1) FROM (
    SELECT *, list_max(list_filter(range(1, 4097), lambda m: strlen(substr(rest, 1, m)) <= 4096)) AS c FROM p WHERE strlen(rest) > 4096)),
u AS (SELECT *, CASE WHEN strlen(rest) > 4096 THEN substr(rest, 1, list_max(list_filter(range(1, 4097), lambda m:
  strlen(substr(rest, 1, m)) <= 4096))) ELSE rest END AS text FROM p)
SELECT project_id, path, row_number() OVER (PARTITION BY project_id, path ORDER BY n, k) - 1 AS ord, n + 1 AS start_line, start + 1 AS start_column, n + 1 AS end_line, start + length(text) AS end_column, text FROM u"""


@query("text_units", with_views(["artifacts"], _UNITS).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf_dir):
    return index.text_units(views.artifacts(spark, sf_dir))


@query(
    "update_index",
    with_views(
        ["snapshot_current"],
        "SELECT c.project_id, c.path, 'sha256:' || sha256(content) AS content_fingerprint, u.n + 1 AS start_line, u.line AS text FROM snapshot_current c, LATERAL (SELECT unnest(range(len(string_split(content, chr(10))))) AS n, unnest(string_split(content, chr(10))) AS line) u WHERE u.line <> ''",
    ),
)
def _(spark, sf_dir):
    def build(contents):
        return index.text_units(contents, max_unit_bytes=1_000_000).select("project_id", "path", "start_line", "text")

    before = views.snapshot(spark, sf_dir, "previous").withColumn("content_fingerprint", scan.content_fingerprint(F.col("content")))
    held = build(before).join(before.select("project_id", "path", "content_fingerprint"), ["project_id", "path"])
    return index.update_index(held, views.snapshot(spark, sf_dir, "current"), build)


@query(
    "find_artifacts",
    with_views(
        ["artifacts"],
        "SELECT DISTINCT reference, doc_id FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'src/mod_' || item_id * 7 || '.py' ELSE 'a' || item_id * 11 END AS reference FROM benchmark) r JOIN artifacts ON reference = path OR reference = 'a' || doc_id",
    ),
)
def _(spark, sf_dir):
    wanted = views.table(spark, sf_dir, "benchmark").select(
        F.when(
            F.col("item_id") % 2 == 0, F.concat(F.lit("src/mod_"), F.col("item_id") * 7, F.lit(".py")),
        ).otherwise(F.concat(F.lit("a"), F.col("item_id") * 11)).alias("reference")
    )
    rows = views.artifacts(spark, sf_dir).select(F.concat(F.lit("a"), "doc_id").alias("artifact_id"), "doc_id", "path")
    return index.find_artifacts(rows, wanted).select("reference", "doc_id")


@query(
    "find_symbols",
    with_views(
        ["symbols"],
        "SELECT wanted, symbol_id FROM (SELECT DISTINCT upper(regexp_replace(p_name, '[ #]', '_', 'g')) AS wanted FROM part) JOIN symbols ON lower(wanted) = lower(name) OR lower(wanted) = lower(qualified_name)",
    ),
)
def _(spark, sf_dir):
    wanted = views.table(spark, sf_dir, "part").select(F.upper(F.regexp_replace("p_name", "[ #]", "_")).alias("wanted")).distinct()
    return index.find_symbols(views.symbols(spark, sf_dir), wanted).select("wanted", "symbol_id")


@query(
    "find_text",
    with_views(
        ["search_units"],
        f"SELECT query, unit_id FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS query FROM benchmark) q JOIN search_units u ON query <> '' AND contains({
            FOLD.format('u.text')
        }, {FOLD.format('query')})",
    ),
)
def _(spark, sf_dir):
    asked = views.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("query")).filter("query <> ''")
    return index.find_text(views.search_units(spark, sf_dir), asked).select("query", "unit_id")


@query(
    "find_relationships",
    with_views(
        ["edges_orders"],
        "SELECT DISTINCT reference, relationship_id FROM (SELECT 'o:' || o_orderkey AS reference FROM orders) JOIN edges_orders ON reference = source_reference OR reference = target_reference",
    ),
)
def _(spark, sf_dir):
    wanted = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("reference"))
    return index.find_relationships(views.edges_orders(spark, sf_dir), wanted).select("reference", "relationship_id")


@query("stale_indexes", "SELECT o_custkey AS project_id FROM orders GROUP BY o_custkey HAVING NOT (count(*) % 3 <> 0 AND max(o_orderkey) % 4 <> 0)")
def _(spark, sf_dir):
    now = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(
        F.max("o_orderkey").alias("inventory_id"), F.count(F.lit(1)).alias("project_fingerprint"),
    )
    was = now.filter("project_fingerprint % 3 <> 0").withColumn(
        "inventory_id", F.when(F.col("inventory_id") % 4 == 0, -1).otherwise(F.col("inventory_id")),
    )
    return index.stale_indexes(was, now)


@query("check_index", with_views(["artifacts", "search_units", "symbols"], """
a AS (SELECT 'a' || (doc_id % 90) AS artifact_id FROM artifacts), u AS (SELECT 'a' || (doc_id % 95) AS artifact_id, 'u' || (doc_id
  * 50 + line % 40) AS unit_id FROM search_units)
SELECT 'DUPLICATE_ID' AS code, 'artifacts' AS "table", artifact_id AS id FROM a GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_ID', 'units', unit_id FROM u GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'UNKNOWN_ARTIFACT', 'units', unit_id FROM u WHERE artifact_id NOT IN (SELECT artifact_id FROM a)
UNION ALL SELECT 'UNKNOWN_ARTIFACT', 'symbols', symbol_id FROM symbols WHERE artifact_id NOT IN (SELECT artifact_id FROM a)"""))
def _(spark, sf_dir):
    files = views.artifacts(spark, sf_dir).select(F.concat(F.lit("a"), F.col("doc_id") % 90).alias("artifact_id"))
    units = views.search_units(spark, sf_dir).select(
        F.concat(F.lit("a"), F.col("doc_id") % 95).alias("artifact_id"),
        F.concat(F.lit("u"), F.col("doc_id") * 50 + F.col("line") % 40).alias("unit_id"),
    )
    return index.check_index(files, views.symbols(spark, sf_dir), units, views.edges_pages(spark, sf_dir))


@query("snapshots_equivalent", with_views(["snapshot_previous", "snapshot_current"], """
d AS ((SELECT project_id, path, content FROM snapshot_previous EXCEPT ALL SELECT project_id, path, content FROM snapshot_current)
  UNION ALL (SELECT project_id, path, content FROM snapshot_current EXCEPT ALL SELECT project_id, path, content FROM snapshot_previous))
SELECT project_id, project_id NOT IN (SELECT project_id FROM d) AS equivalent FROM (SELECT project_id FROM snapshot_previous UNION SELECT project_id FROM snapshot_current)"""))
def _(spark, sf_dir):
    a, b = (views.snapshot(spark, sf_dir, w).withColumn("digest", F.sha2("content", 256)) for w in ("previous", "current"))
    return index.snapshots_equivalent(a, b, ["path", "digest"])


# --- Task terms. The texts are made so that their signals are known. --------------------------------------------


def _texts(spark, sf_dir):
    t = views.tasks(spark, sf_dir).select("task_id", F.get("keywords", 0).alias("a"), F.get("keywords", 1).alias("b"))
    text = F.format_string(
        'Corrigir src/pkg_%s/mod.py and rename `make_%s` to "New%s" in Core.Widget%s for the %s-%s, see readme.md.',
        "task_id", "a", F.initcap("a"), "task_id", "a", F.coalesce("b", F.lit("")),
    )
    return t.select("task_id", "a", "b", text.alias("task_text"), F.when(F.col("task_id") % 2 == 0, "modify").otherwise("unknown").alias("task_kind"))


_T = "t AS (SELECT task_id, keywords[1] AS a, keywords[2] AS b, upper(keywords[1][1]) || substr(keywords[1], 2) AS c FROM tasks)"


def _normal(spark, sf_dir):
    return terms.normalize_tasks(_texts(spark, sf_dir))


@query("task_signals", with_views(["tasks"], f"""{_T} SELECT task_id, 'src/pkg_' || task_id || '/mod.py' AS paths, 'mod.py,Core.Widget' || task_id || ',readme.md' AS filenames,
  'mod.py,Core.Widget' || task_id || ',readme.md,make_' || a || ',New' || c AS symbols, 'make_' || a || ',New' || c AS quoted_identifiers FROM t"""))
def _(spark, sf_dir):
    return terms.task_signals(_texts(spark, sf_dir)).select(
        "task_id", *(F.array_join(c, ",").alias(c) for c in ("paths", "filenames", "symbols", "quoted_identifiers")),
    )


@query(
    "identifier_parts",
    "SELECT p_partkey, lower(array_to_string(list_filter(regexp_split_to_array(p_name || '_' || p_type || '2Go', '[._ -]+'), lambda x: x <> ''), '|')) AS parts FROM (SELECT p_partkey, p_name, replace(p_type, '2', '') AS p_type FROM part)".replace("'2Go'", "'2 Go'"),
)
def _(spark, sf_dir):
    from ..functions.text import identifier_parts

    part = views.table(spark, sf_dir, "part")
    joined = F.concat("p_name", F.lit("_"), F.replace("p_type", F.lit("2"), F.lit("")), F.lit("2Go"))
    return part.select("p_partkey", F.array_join(identifier_parts(joined), "|").alias("parts"))


@query(
    "operation_hints",
    with_views(["tasks"], "SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'modify,fix,rename' ELSE 'fix,rename' END AS operation_hints FROM tasks"),
)
def _(spark, sf_dir):
    return terms.operation_hints(_texts(spark, sf_dir)).select("task_id", F.array_join("operation_hints", ",").alias("operation_hints"))


_KEYWORDS = "list_filter(['src', 'pkg', task_id::VARCHAR, 'mod', 'py', 'make', a, 'new', 'core', 'widget' || task_id, b, 'see', 'readme', 'md'], lambda x: length(x) > 1)"


@query("task_keywords", with_views(["tasks"], f"{_T} SELECT task_id, array_to_string({_KEYWORDS}, ',') AS keywords FROM t"))
def _(spark, sf_dir):
    return _normal(spark, sf_dir).select("task_id", F.array_join("keywords", ",").alias("keywords"))


_MADE = f"""{_T}, m AS (SELECT task_id, ['mod.py', 'Core.Widget' || task_id, 'readme.md'] AS files, ['make_' || a, 'New' || c] AS quoted, {_KEYWORDS} AS keywords,
  list_concat(CASE WHEN task_id % 2 = 0 THEN ['modify'] ELSE [] END, ['fix', 'rename']) AS hints FROM t),
k AS (SELECT task_id, list_concat(['path:src/pkg_' || task_id || '/mod.py'], list_transform(files, lambda x: 'filename:' || x),
  list_transform(list_concat(files, quoted), lambda x: 'symbol:' || x),
  list_transform(quoted, lambda x: 'quoted_identifier:' || x), list_transform(keywords, lambda x: 'keyword:' || x),
  list_transform(hints, lambda x: 'operation:' || x)) AS l FROM m),
e AS (SELECT task_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS x FROM k)"""


@query("task_terms", with_views(["tasks"], f"""{_MADE},
o AS (SELECT task_id, pos, split_part(x, ':', 1) AS kind, substr(x, instr(x, ':') + 1) AS original FROM e) SELECT *, {FOLD.format('original')} AS normalized FROM o"""))
def _(spark, sf_dir):
    return terms.task_terms(_normal(spark, sf_dir))


@query(
    "expand_keywords",
    with_views(
        ["tasks"],
        "SELECT task_id, array_to_string(list_distinct_ordered, ',') AS search_terms FROM (SELECT task_id, ['greeting_' || task_id, 'salutation', 'greeting', 'composed', 'configuration', 'settings'] AS list_distinct_ordered FROM tasks)",
    ).replace("['greeting_' || task_id, ", "[").replace("'settings']", "'settings', 'key_' || task_id]"),
)
def _(spark, sf_dir):
    rows = views.tasks(spark, sf_dir).select(
        "task_id", F.concat(F.lit("salutation composed constructed ab key_"), "task_id").alias("task_text"),
        F.array(F.lit("salutation"), F.lit("composed"), F.lit("ab"), F.lit("settings")).alias("keywords"),
    )
    return terms.expand_keywords(rows).select("task_id", F.array_join("search_terms", ",").alias("search_terms"))


# --- Code --------------------------------------------------------------------------------------------------------


def _sources(spark, sf_dir):
    """A Python file for each part: a class with a method, a function that uses it, imports of the next part's file."""
    text = F.format_string(
        'import os\nfrom pkg.part_%s import Shape%s as other\n\n\nclass Shape%s:\n    """%s"""\n\n    def area(self, x=os):\n        return helper(x)\n\n\ndef helper(value):\n    return other(value)\n',
        "next", "next", "p_partkey", "p_name",
    )
    part = spread(views.table(spark, sf_dir, "part")).withColumn("next", F.col("p_partkey") + 1)
    broken = F.when(F.col("p_partkey") % 50 == 0, "def broken(:\n").otherwise(text)
    return part.select(
        "p_partkey", F.concat(F.lit("p"), F.col("p_partkey") % 7).alias("project_id"),
        F.concat(F.lit("pkg/part_"), "p_partkey", F.lit(".py")).alias("path"), broken.alias("content"),
    )


@query(
    "parse_python",
    "SELECT 'pkg/part_' || p_partkey || '.py' AS path, tag, n FROM part, (VALUES ('module', 1), ('definition', 3), ('import', 2), ('reference', 5)) v(tag, n) WHERE p_partkey % 50 <> 0 UNION ALL SELECT 'pkg/part_' || p_partkey || '.py', 'error', 1 FROM part WHERE p_partkey % 50 = 0",
)
def _(spark, sf_dir):
    return code.parse_python(_sources(spark, sf_dir)).groupBy("path", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("python_symbols", """SELECT 'pkg.part_' || p_partkey || x AS qualified_name, kind, CASE parent WHEN '-' THEN NULL ELSE 'pkg.part_' || p_partkey || parent END AS parent FROM (
  SELECT p_partkey, x.* FROM part, (VALUES ('', 'module', '-'), ('.Shape{}', 'class', ''), ('.Shape{}.area', 'method', '.Shape{}'), ('.helper', 'function', '')) x(a, kind, b), LATERAL (SELECT replace(a, '{}', p_partkey::VARCHAR) AS x, kind, replace(b, '{}', p_partkey::VARCHAR) AS parent) x WHERE p_partkey % 50 <> 0)""".replace("SELECT p_partkey, x.* FROM part, (VALUES", "SELECT p_partkey, y.* FROM part, (VALUES").replace("x(a, kind, b), LATERAL (SELECT replace(a, '{}', p_partkey::VARCHAR) AS x, kind, replace(b, '{}', p_partkey::VARCHAR) AS parent) x", "v(a, k, b), LATERAL (SELECT replace(a, '{}', p_partkey::VARCHAR) AS x, k AS kind, replace(b, '{}', p_partkey::VARCHAR) AS parent) y"))
def _(spark, sf_dir):
    # Written, as Spark can't tell how much Python returns and would send the parents to all tasks by way of the driver.
    symbols = written(code.python_symbols(code.parse_python(_sources(spark, sf_dir)), views.NAMESPACE))
    parents = symbols.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("qualified_name").alias("parent"))
    return symbols.join(parents, "parent_symbol_id", "left").select("qualified_name", "kind", "parent")


@query(
    "python_edges",
    "SELECT 'pkg/part_' || p_partkey || '.py' AS path, kind, resolution, n FROM part, (VALUES ('contains', 'resolved_internal', 3), ('defines', 'resolved_internal', 3), ('imports', 'unresolved', 2), ('depends_on', 'unresolved', 2), ('references', 'unresolved', 5)) v(kind, resolution, n) WHERE p_partkey % 50 <> 0",
)
def _(spark, sf_dir):
    parsed = code.parse_python(_sources(spark, sf_dir))
    edges = code.python_edges(parsed, code.python_symbols(parsed, views.NAMESPACE), views.NAMESPACE)
    return edges.groupBy("path", "kind", "resolution").agg(F.count(F.lit(1)).alias("n"))


@query(
    "python_units",
    """SELECT 'pkg/part_' || p_partkey || '.py' AS path, v.ord, v.kind, v.start_line FROM part, (VALUES (0, 'module_summary', 1), (1, 'import_block', 1), (2, 'import_block', 2), (3, 'symbol_definition', 5), (4, 'symbol_definition', 8), (5, 'symbol_definition', 12)) v(ord, kind, start_line) WHERE p_partkey % 50 <> 0""",
)
def _(spark, sf_dir):
    return code.python_units(code.parse_python(_sources(spark, sf_dir))).select("path", "ord", "kind", "start_line")


_RESOLVED = with_views(["symbols"], """
e AS (SELECT p_partkey AS relationship_id, CASE p_partkey % 4 WHEN 0 THEN regexp_replace(p_name, '[ #]', '_', 'g') WHEN 1 THEN
  '..' || regexp_replace(p_type, '[ #]', '_', 'g') || '.' || regexp_replace(p_name, '[ #]', '_', 'g') WHEN 2 THEN 'nowhere.' || p_partkey
      ELSE regexp_replace(p_brand, '[ #]', '_', 'g') || '.' || regexp_replace(p_type, '[ #]', '_', 'g') || '.' ||
  regexp_replace(p_name, '[ #]', '_', 'g') END AS target FROM part),
k AS (SELECT e.relationship_id, s.symbol_id FROM e JOIN symbols s ON s.qualified_name = ltrim(target, '.') OR
  suffix(s.qualified_name, '.' || ltrim(target, '.'))),
g AS (SELECT relationship_id, count(*) AS n, min(symbol_id) AS s FROM k GROUP BY 1)
SELECT e.relationship_id, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN 'resolved_internal' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution, CASE WHEN n = 1 THEN s END AS target_symbol FROM e LEFT JOIN g USING (relationship_id)""")


def _edges(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    plain = lambda c: F.regexp_replace(c, "[ #]", "_")
    m = F.col("p_partkey") % 4
    target = F.when(m == 0, plain("p_name")).when(
        m == 1, F.concat(F.lit(".."), plain("p_type"), F.lit("."), plain("p_name")),
    ).when(m == 2, F.concat(F.lit("nowhere."), "p_partkey")).otherwise(F.concat_ws(".", plain("p_brand"), plain("p_type"), plain("p_name")))
    edges = part.select(F.col("p_partkey").alias("relationship_id"), F.lit("p").alias("project_id"), target.alias("target_reference"))
    symbols = views.symbols(spark, sf_dir).withColumn("project_id", F.lit("p"))
    return edges, symbols


@query("resolve_edges", _RESOLVED)
def _(spark, sf_dir):
    edges, symbols = _edges(spark, sf_dir)
    return code.resolve_edges(edges, symbols).select("relationship_id", "matches", "resolution", "target_symbol")


@query("update_edges", _RESOLVED)
def _(spark, sf_dir):
    """From a version with other symbols and edges to the current one, by what changed between them."""
    edges, symbols = _edges(spark, sf_dir)
    edges = edges.withColumn("path", F.concat(F.lit("f"), F.col("relationship_id") % 50))
    number = F.expr("int(substring(symbol_id, 4))")
    kept = symbols.filter(number % 5 != 0)
    other = symbols.filter(number % 7 == 0).withColumn("symbol_id", F.concat("symbol_id", F.lit("-old")))
    late = F.col("path").isin("f3", "f14")
    before = code.resolve_edges(edges.filter(~late).unionByName(edges.filter("path = 'f15'").withColumn("path", F.lit("gone"))), kept.unionByName(other))
    counts, touched = code.change_counts(code.suffix_counts(kept.unionByName(other)), symbols, symbols.filter(number % 5 == 0), other)
    gone = spark.range(1).select(F.lit("p").alias("project_id"), F.lit("gone").alias("path"))
    out = code.update_edges(before, gone, edges.filter(late), counts, touched)
    return out.select("relationship_id", "matches", "resolution", "target_symbol")
