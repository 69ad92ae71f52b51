"""Queries on retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import retrieval as r
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


# --- Words -------------------------------------------------------------------------------------------------------

LEXICAL = f"""q AS (SELECT task_id, unnest(keywords) AS term, len(keywords) AS n_terms, keywords[1] || ' ' AS phrase FROM tasks),
k AS (SELECT unit_id, path, regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}]+') AS ts, {FOLD.format('text')} AS
  folded FROM search_units),
x AS (SELECT unit_id, unnest(ts) AS term FROM k),
h AS (SELECT task_id, unit_id, count(DISTINCT term) AS matched, count(*) AS occ FROM x JOIN q USING (term) GROUP BY 1, 2),
ip AS (SELECT DISTINCT task_id, unit_id FROM q JOIN k ON contains({FOLD.format('path')}, term)),
ph AS (SELECT DISTINCT task_id, unit_id FROM (SELECT DISTINCT task_id, phrase FROM q) JOIN k ON contains(folded, phrase)),
a AS (SELECT task_id, unit_id FROM h UNION SELECT * FROM ip UNION SELECT * FROM ph),
s AS (SELECT a.task_id, a.unit_id, round(coalesce(matched, 0) / n_terms + least(coalesce(occ, 0) / greatest(len(ts), 1), 1.0) *
  0.25 + CASE WHEN ph.task_id IS NULL THEN 0 ELSE 0.25 END + CASE WHEN ip.task_id IS NULL THEN 0 ELSE 0.15 END, 8) AS score
  FROM a JOIN (SELECT DISTINCT task_id, n_terms FROM q) USING (task_id) JOIN k USING (unit_id) LEFT JOIN h USING (task_id,
  unit_id) LEFT JOIN ip USING (task_id, unit_id) LEFT JOIN ph USING (task_id, unit_id)),
t AS (SELECT task_id, unit_id, round(score, 6) AS score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, unit_id) AS rank FROM s)"""


def lexical_ranks(spark, sf_dir, k=None):
    tasks = views.tasks(spark, sf_dir).select(
        "task_id", F.col("keywords").alias("terms"),
        F.concat(F.lit('say "'), F.get("keywords", 0), F.lit(' "')).alias("task_text"),
    )
    return r.lexical_rank(tasks, views.search_units(spark, sf_dir), k).withColumn("score", F.round("score", 6))


@query("lexical_rank", with_views(["search_units", "tasks"], f"{LEXICAL} SELECT * FROM t"))
def _(spark, sf_dir):
    return lexical_ranks(spark, sf_dir)


@query("lexical_top_ten", with_views(["search_units", "tasks"], f"{LEXICAL} SELECT * FROM t WHERE rank <= 10"))
def _(spark, sf_dir):
    """Pruned by the bound of the tenth place; every task's first ten."""
    return lexical_ranks(spark, sf_dir, 10)


@query(
    "lexical_top_document",
    with_views(["search_units", "tasks"], f"{LEXICAL} SELECT task_id, unit_id, path, score FROM t JOIN k USING (unit_id) WHERE rank = 1"),
)
def _(spark, sf_dir):
    """The best unit of each task: read, split, count, join, aggregate, rank."""
    best = lexical_ranks(spark, sf_dir, 1)
    return best.join(views.search_units(spark, sf_dir).select("unit_id", "path"), "unit_id").select("task_id", "unit_id", "path", "score")


# --- References --------------------------------------------------------------------------------------------------


@query("resolve_explicit", with_views(["artifacts", "symbols"], """
f AS (SELECT 'a' || doc_id AS artifact_id, CASE WHEN doc_id % 9 = 0 THEN 'lib/shared.py' ELSE path END AS path FROM artifacts),
w AS (SELECT o_orderkey AS task_id, k.kind, CASE kind WHEN 'path' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'SRC/mod_' || d || '.py'
  ELSE 'src/mod_' || d || '.py' END WHEN 'filename' THEN 'page_' || d || '.md'
  WHEN 'shared' THEN 'Shared.py' ELSE regexp_replace(p_name, '[ #]', '_', 'g') END AS reference FROM (SELECT *, o_orderkey %
  (SELECT count(*) FROM documents) AS d, o_orderkey % (SELECT count(*) FROM part) AS m FROM orders) JOIN part ON p_partkey = m +
  1, (VALUES ('path'), ('filename'), ('shared'), ('symbol')) k(kind)),
n AS (SELECT task_id, CASE kind WHEN 'shared' THEN 'filename' ELSE kind END AS kind, reference FROM w),
m AS (
  SELECT task_id, n.kind, reference, artifact_id AS target FROM n JOIN f ON lower(reference) = lower(path) WHERE kind = 'path'
  UNION SELECT task_id, kind, reference, artifact_id FROM n JOIN f ON lower(reference) = regexp_extract(lower(path), '[^/]*$') WHERE kind = 'filename'
  UNION SELECT task_id, n.kind, reference, symbol_id FROM n JOIN symbols ON lower(reference) = lower(name) OR lower(reference) =
  lower(qualified_name) WHERE n.kind = 'symbol'),
g AS (SELECT task_id, kind, reference, count(*) AS c, min(target) AS t FROM m GROUP BY 1, 2, 3)
SELECT DISTINCT n.task_id, n.kind, n.reference, CASE WHEN c IS NULL THEN 'not_found' WHEN c = 1 THEN 'selected' ELSE 'ambiguous' END AS outcome, coalesce(c, 0) AS matches, CASE WHEN c = 1 THEN t END AS target FROM n LEFT JOIN g USING (task_id, kind, reference)"""))
def _(spark, sf_dir):
    orders, part, docs = (views.table(spark, sf_dir, t) for t in ("orders", "part", "documents"))
    sizes = part.agg(F.count(F.lit(1)).alias("parts")).crossJoin(docs.agg(F.count(F.lit(1)).alias("docs")))
    rows = orders.crossJoin(F.broadcast(sizes)).join(part, F.col("p_partkey") == F.col("o_orderkey") % F.col("parts") + 1)
    number = F.col("o_orderkey") % F.col("docs")
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "SRC").otherwise("src"), F.lit("/mod_"), number, F.lit(".py"))
    wanted = F.array(
        *(
            F.struct(F.lit(k).alias("kind"), v.alias("original")) for k, v in (
                ("path", path), ("filename", F.concat(F.lit("page_"), number, F.lit(".md"))),
                ("filename", F.lit("Shared.py")), ("symbol", F.regexp_replace("p_name", "[ #]", "_")),
            )
        )
    )
    terms = rows.select(F.col("o_orderkey").alias("task_id"), F.inline(wanted)).withColumn("normalized", fold(F.col("original")))
    files = views.artifacts(spark, sf_dir).select(
        F.concat(F.lit("a"), "doc_id").alias("artifact_id"),
        F.when(F.col("doc_id") % 9 == 0, "lib/shared.py").otherwise(F.col("path")).alias("path"),
    )
    return r.resolve_explicit(terms, files, views.symbols(spark, sf_dir))


# --- Structure and dependencies ------------------------------------------------------------------------------------


@query("structural_candidates", """
WITH c AS (SELECT c_nationkey AS task_id, 'c:' || c_custkey AS sym, 'n:' || c_nationkey AS par FROM customer),
ch AS (SELECT DISTINCT task_id, sym, 0 AS role FROM c UNION SELECT DISTINCT task_id, par, 1 FROM c UNION SELECT DISTINCT task_id,
  'r:' || n_regionkey, 1 FROM c JOIN nation ON n_nationkey = task_id),
u AS (SELECT 'uc:' || c_custkey AS unit_id, c_custkey AS ord, 'c:' || c_custkey AS sym FROM customer UNION ALL SELECT 'un:' ||
  n_nationkey, n_nationkey, 'n:' || n_nationkey FROM nation UNION ALL SELECT 'ur:' || r_regionkey, r_regionkey, 'r:' || r_regionkey FROM region),
h AS (SELECT task_id, unit_id, ord, role FROM ch JOIN u USING (sym) UNION ALL SELECT task_id, 'un:' || n_nationkey, n_nationkey, 2
  FROM ch JOIN nation ON sym = 'r:' || n_regionkey),
b AS (SELECT task_id, unit_id, ord, min(role) AS m FROM h GROUP BY 1, 2, 3)
SELECT task_id, unit_id, ['definition', 'scope', 'imports'][m + 1] AS role, CASE WHEN m = 0 THEN 1.0 ELSE 0.8 END AS weight, row_number() OVER (PARTITION BY task_id ORDER BY m, ord, unit_id) AS seq FROM b""")
def _(spark, sf_dir):
    customer, nation, region = (views.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    symbols = customer.select(name("c:", "c_custkey").alias("symbol_id"), name("n:", "c_nationkey").alias("parent_symbol_id"))
    symbols = symbols.unionByName(nation.select(name("n:", "n_nationkey").alias("symbol_id"), name("r:", "n_regionkey").alias("parent_symbol_id"))).unionByName(
        region.select(name("r:", "r_regionkey").alias("symbol_id"), F.lit(None).cast("string").alias("parent_symbol_id"))
    ).withColumn("name", F.col("symbol_id"))
    unit = lambda df, u, s, k: df.select(name(u, k).alias("unit_id"), F.col(k).cast("long").alias("ord"), F.array(name(s, k)).alias("symbol_ids"))
    units = unit(customer, "uc:", "c:", "c_custkey").unionByName(
        unit(nation, "un:", "n:", "n_nationkey")
    ).unionByName(unit(region, "ur:", "r:", "r_regionkey"))
    edges = nation.select(
        name("r:", "n_regionkey").alias("source_reference"), name("un:", "n_nationkey").alias("unit_id"),
        F.lit("imports").alias("kind"),
    )
    roots = customer.select(F.col("c_nationkey").alias("task_id"), name("c:", "c_custkey").alias("name"))
    return r.structural_candidates(roots, symbols, units, edges)


_TRAVERSAL = """
p AS (SELECT *, row_number() OVER (PARTITION BY source_reference ORDER BY kind, target_reference, relationship_id) AS place FROM edges_orders),
e AS (SELECT source_reference AS s, target_reference AS t, kind, place, CASE kind WHEN 'depends_on' THEN 1.0 WHEN 'imports' THEN
  0.95 ELSE 0.85 END AS w FROM p WHERE place <= 20),
seeds AS (SELECT c_custkey AS task_id, 'c:' || c_custkey AS node, c_custkey AS pos FROM customer),
s1 AS (SELECT task_id, t AS node, node AS seed, [pos, place] AS trail, round(w, 8) AS total, node || '>' || t AS path, kind FROM
  seeds JOIN e ON node = s),
d1 AS (SELECT task_id, node, arg_min({'seed': seed, 'trail': trail, 'total': total, 'path': path, 'kind': kind}, trail) AS x FROM
  s1 WHERE (task_id, node) NOT IN (SELECT task_id, node FROM seeds) GROUP BY 1, 2),
s2 AS (SELECT task_id, t AS node, x.seed AS seed, list_append(x.trail, place) AS trail, round(x.total * w * 0.8, 8) AS total,
  x.path || '>' || t AS path, e.kind FROM d1 JOIN e ON node = s),
d2 AS (SELECT task_id, node, arg_min({'seed': seed, 'trail': trail, 'total': total, 'path': path, 'kind': kind}, trail) AS x FROM
  s2 WHERE (task_id, node) NOT IN (SELECT task_id, node FROM seeds UNION ALL SELECT task_id, node FROM d1) GROUP BY 1, 2),
f AS (SELECT task_id, node, x, 1 AS depth FROM d1 UNION ALL SELECT task_id, node, x, 2 FROM d2),
g AS (SELECT task_id, node AS target, x.seed AS seed, depth, x.kind AS kind, round(x.total, 6) AS weight, x.path AS path,
  row_number() OVER (PARTITION BY task_id ORDER BY depth, x.trail) AS seq FROM f WHERE node NOT LIKE '%7'),
t AS (SELECT * FROM g WHERE seq <= 50)"""


def _traversal_inputs(spark, sf_dir):
    seeds = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("task_id"), F.concat(F.lit("c:"), "c_custkey").alias("reference"),
        F.col("c_custkey").alias("pos"),
    )
    edges = views.edges_orders(spark, sf_dir)
    known = edges.select(F.col("target_reference").alias("reference")).filter("reference not like '%7'").distinct()
    return seeds, edges, known


def _traversed(spark, sf_dir):
    seeds, edges, known = _traversal_inputs(spark, sf_dir)
    return r.dependency_traversal(seeds, edges, known), seeds


@query("traversal_limits", with_views(["edges_orders"], f"""{_TRAVERSAL},
deg AS (SELECT source_reference AS node, count(*) AS edges FROM edges_orders GROUP BY 1),
nodes AS (SELECT task_id, node, {{'d': 0, 't': [pos]}} AS spot FROM seeds UNION ALL SELECT task_id, node, {{'d': depth, 't': x.trail}} FROM f),
g2 AS (SELECT task_id, depth, x.trail AS trail, row_number() OVER (PARTITION BY task_id ORDER BY depth, x.trail) AS seq FROM f WHERE node NOT LIKE '%7'),
l AS (SELECT task_id, {{'d': depth, 't': trail}} AS last, {{'d': depth - 1, 't': trail[1:len(trail) - 1]}} AS parent FROM g2 WHERE seq = 50),
w AS (SELECT n.task_id, n.spot, coalesce(edges, 0) AS edges, last, parent FROM nodes n LEFT JOIN deg ON deg.node = n.node LEFT JOIN l ON l.task_id = n.task_id)
SELECT task_id, bool_or(last IS NULL AND spot.d = 2 AND edges > 0) AS depth_limited,
  bool_or((last IS NULL OR spot <= parent) AND spot.d < 2 AND edges > 20) AS fan_out_limited,
  coalesce(bool_or(last IS NOT NULL AND spot > parent AND spot < last), false) AS candidate_limited FROM w GROUP BY task_id"""))
def _(spark, sf_dir):
    """Which of the limits of depth, fan-out and candidates cut each task's traversal."""
    return r.traversal_limits(*_traversal_inputs(spark, sf_dir)).drop("codes")


@query("dependency_traversal", with_views(["edges_orders"], f"{_TRAVERSAL} SELECT * FROM t"))
def _(spark, sf_dir):
    return _traversed(spark, sf_dir)[0].withColumn("weight", F.round("weight", 6))


@query("dependency_closure", with_views(["edges_orders"], f"""{_TRAVERSAL},
c AS (SELECT task_id, target, weight, target NOT LIKE '%3' AS ok FROM t WHERE weight >= 0.5 AND (task_id, target) NOT IN (SELECT
  task_id, node FROM seeds)),
o AS (SELECT *, row_number() OVER (PARTITION BY task_id, ok ORDER BY weight DESC, target) AS place FROM c)
SELECT task_id, target, weight, place, CASE WHEN NOT ok THEN 'ineligible' WHEN place > 20 THEN 'over_limit' ELSE 'mandatory' END AS outcome FROM o"""))
def _(spark, sf_dir):
    found, seeds = _traversed(spark, sf_dir)
    eligible = found.select(F.col("target").alias("reference")).filter("reference not like '%3'")
    return r.dependency_closure(seeds, found, eligible).withColumn("weight", F.round("weight", 6))


# --- Eligibility, scores, budget ---------------------------------------------------------------------------------

TYPES = [
    "full_artifact", "symbol_definition", "structural_unit", "source_excerpt", "test_artifact", "configuration_block",
    "manifest_section", "other_type",
]
EVIDENCE = [
    "explicit-path-reference", "dependency-traversal-path", "symbol-name", "lexical-text-match", "structural-scope",
    "dependency-direct", "generated-penalty", "security-note", "unrelated",
]
REASONS = [
    "lexical_content_match", "exact_path_match", "explicit_symbol_reference", "exact_symbol_match",
    "dependency_relationship", "security_prohibited", "required_context",
]
STATES = ["eligible", "eligible", "eligible", "prohibited", "eligible", "unavailable"]


def _pick(values: list[str], n):
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _candidates(spark, sf_dir):
    """Orders as candidates of a hundred tasks."""
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    piece = lambda n, w: F.struct(_pick(EVIDENCE, n).alias("type"), F.lit("s").alias("source"), F.lit("d").alias("detail"), w.alias("weight"))
    evidence = F.array(piece(k, (k % 13) / 10), piece(F.floor(k / 7), (k % 5) / 8))
    return o.select(
        (F.col("o_custkey") % 100).alias("task_id"), F.format_string("c%09d", k).alias("candidate_id"),
        F.concat(F.lit("a"), k % 23).alias("artifact_id"), _pick(TYPES, k).alias("type"), evidence.alias("evidence"),
        _pick(REASONS, F.floor(k / 3)).alias("reason"), _pick(STATES, F.floor(k / 5)).alias("eligibility"),
        (k % 29 == 0).alias("deferred"), (k % 997).alias("bytes"), F.floor((k % 997) / 4).alias("tokens"),
    )


def _sql_pick(values: list[str], n: str) -> str:
    return f"{values}[(({n}) % {len(values)} + 1)::INT]"


_COMPONENT = "CASE WHEN {0} LIKE 'explicit-%' THEN 0 WHEN {0} LIKE '%path%' THEN 1 WHEN {0} LIKE '%symbol%' THEN 2 WHEN {0} LIKE '%lexical%' THEN 3 WHEN {0} LIKE '%structural%' THEN 4 WHEN {0} LIKE '%dependency%' THEN 5 WHEN {0} LIKE '%generated%' THEN 8 WHEN {0} LIKE '%security%' THEN 7 END"
_CANDIDATES = f"""c AS (SELECT o_custkey % 100 AS task_id, printf('c%09d', o_orderkey) AS candidate_id, 'a' || (o_orderkey % 23) AS artifact_id, {_sql_pick(TYPES, 'o_orderkey')} AS type, {_sql_pick(EVIDENCE, 'o_orderkey')} AS e1, least((o_orderkey % 13) / 10, 1.0) AS w1,
  {_sql_pick(EVIDENCE, 'o_orderkey // 7')} AS e2, (o_orderkey % 5) / 8 AS w2, {_sql_pick(REASONS, 'o_orderkey // 3')} AS reason,
  {_sql_pick(STATES, 'o_orderkey // 5')} AS eligibility, o_orderkey % 29 = 0 AS deferred, o_orderkey % 997 AS bytes, (o_orderkey %
  997) // 4 AS tokens FROM orders),
v AS (SELECT *, {_COMPONENT.format('e1')} AS k1, {_COMPONENT.format('e2')} AS k2 FROM c),
m AS (SELECT *, list_transform(range(9), lambda i: greatest(CASE WHEN k1 = i THEN w1 ELSE 0 END, CASE WHEN k2 = i THEN w2 ELSE 0 END)) AS x FROM v),
z AS (SELECT *, CASE WHEN reason IN ('explicit_symbol_reference') THEN 1 ELSE x[1] END + 0.9 * CASE WHEN reason =
  'exact_path_match' THEN 1 ELSE x[2] END + 0.9 * CASE WHEN reason = 'exact_symbol_match' THEN 1 ELSE x[3] END + 0.7 * x[4] + 0.7 * x[5] + 0.6 * x[6]
  + 0.4 * CASE type WHEN 'full_artifact' THEN 1.0 WHEN 'symbol_definition' THEN 0.95 WHEN 'structural_unit' THEN 0.9 WHEN
  'source_excerpt' THEN 0.85 WHEN 'test_artifact' THEN 0.75 WHEN 'configuration_block' THEN 0.8 WHEN 'manifest_section' THEN 0.75 ELSE 0.5 END
  - CASE WHEN eligibility = 'prohibited' OR reason = 'security_prohibited' THEN 1 ELSE x[8] END - 0.5 * x[9] AS raw FROM m),
y AS (SELECT *, round(raw, 8)::DOUBLE AS raw_score, min(round(raw, 8)::DOUBLE) OVER w AS lo, max(round(raw, 8)::DOUBLE) OVER w AS
  hi FROM z WINDOW w AS (PARTITION BY task_id)),
n AS (SELECT *, CASE WHEN hi = lo THEN CASE WHEN raw_score > 0 THEN 1.0 ELSE 0.0 END ELSE round((raw_score - lo) / (hi - lo), 8) END AS norm FROM y),
s AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY norm DESC, raw_score DESC, candidate_id) AS rank FROM n)"""


@query(
    "score_candidates",
    f"WITH {_CANDIDATES} SELECT task_id, candidate_id, floor(raw_score * 1000000 + 0.5)::BIGINT AS raw_score_e6, floor(norm * 1000000 + 0.5)::BIGINT AS normalized_score_e6, rank FROM s",
)
def _(spark, sf_dir):
    millionths = lambda c: F.floor(F.col(c) * 1000000 + 0.5).alias(f"{c}_e6")
    return r.score_candidates(_candidates(spark, sf_dir)).select(
        "task_id", "candidate_id", millionths("raw_score"), millionths("normalized_score"), "rank",
    )


_MANDATORY = "reason IN ('exact_path_match', 'explicit_symbol_reference', 'exact_symbol_match', 'required_context')"


_FOLD = f"""WITH RECURSIVE {_CANDIDATES},
o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY NOT ({_MANDATORY}), rank, candidate_id) AS i FROM s WHERE
  eligibility = 'eligible' AND NOT deferred),
f AS (
  SELECT DISTINCT task_id, 0::BIGINT AS i, 100::BIGINT AS b, 0::BIGINT AS t, 0 AS n, 0 AS ex, []::VARCHAR[] AS arts, NULL::VARCHAR
  AS cid, false AS fits FROM o
  UNION ALL
  SELECT task_id, i, CASE WHEN ok THEN b + bytes ELSE b END, CASE WHEN ok THEN t + tokens ELSE t END, CASE WHEN ok THEN n + 1 ELSE
  n END, CASE WHEN ok THEN ex + e ELSE ex END, CASE WHEN ok THEN list_distinct(list_append(arts, artifact_id)) ELSE arts END, candidate_id, ok
  FROM (SELECT f.task_id, o.i, f.b, f.t, f.n, f.ex, f.arts, o.candidate_id, o.bytes, o.tokens, o.artifact_id, CASE WHEN type =
  'full_artifact' THEN 0 ELSE 1 END AS e,
          f.b + o.bytes <= 6000 AND o.bytes <= 900 AND f.n + 1 <= 25 AND f.t + o.tokens <= 1400 AND (list_contains(f.arts,
  o.artifact_id) OR len(f.arts) + 1 <= 9) AND f.ex + CASE WHEN type = 'full_artifact' THEN 0 ELSE 1 END <= 15 AS ok
        FROM f JOIN o ON f.task_id = o.task_id AND o.i = f.i + 1))"""


@query("select_under_budget", f"""{_FOLD}
SELECT s.task_id, s.candidate_id, {_MANDATORY} AS mandatory, CASE WHEN eligibility <> 'eligible' THEN eligibility WHEN deferred
  THEN 'deferred' WHEN f.fits THEN 'selected' ELSE 'budget_exceeded' END AS outcome, CASE WHEN f.fits THEN f.n::INT ELSE 0 END AS selected_rank
FROM s LEFT JOIN f ON s.task_id = f.task_id AND s.candidate_id = f.cid""")
def _(spark, sf_dir):
    rows, budgets = _candidates(spark, sf_dir), _candidate_budgets(spark, sf_dir)
    return r.select_under_budget(
        rows, r.score_candidates(rows), budgets, {"bytes": 100},
    ).withColumn("selected_rank", F.coalesce("selected_rank", F.lit(0)))


def _candidate_budgets(spark, sf_dir):
    return _candidates(spark, sf_dir).select("task_id").distinct().select(
        "task_id",
        *(
            F.lit(v).alias(k) for k, v in (
                ("max_bytes", 6000), ("max_item_bytes", 900), ("max_items", 25), ("max_estimated_tokens", 1400),
                ("max_artifacts", 9), ("max_excerpts", 15),
            )
        ),
    )


@query("budget_usage", f"""{_FOLD},
used AS (SELECT f.task_id, sum(s.tokens)::BIGINT AS tokens, sum(s.bytes)::BIGINT AS bytes, count(*) AS items, count(DISTINCT s.artifact_id) AS artifacts,
  count(*) FILTER (WHERE type <> 'full_artifact') AS excerpts FROM f JOIN s ON s.task_id = f.task_id AND s.candidate_id = f.cid WHERE f.fits GROUP BY 1),
bb AS (SELECT s.task_id, bool_or({_MANDATORY} AND eligibility = 'eligible' AND NOT deferred AND NOT coalesce(f.fits, false)) AS over
  FROM s LEFT JOIN f ON s.task_id = f.task_id AND s.candidate_id = f.cid GROUP BY 1)
SELECT bb.task_id, coalesce(tokens, 0) AS tokens, coalesce(bytes, 0) AS characters, coalesce(bytes, 0) AS bytes, coalesce(items, 0) AS items,
  coalesce(artifacts, 0) AS artifacts, coalesce(excerpts, 0) AS excerpts, false AS reservation_overflow, over AS mandatory_overflow,
  CASE WHEN over THEN 'RETRIEVAL_BUDGET_EXCEEDED' END AS code FROM bb LEFT JOIN used USING (task_id)""")
def _(spark, sf_dir):
    """What each task's selection uses, and whether a mandatory candidate was left out."""
    rows = _candidates(spark, sf_dir)
    return r.plan_under_budget(rows, r.score_candidates(rows), _candidate_budgets(spark, sf_dir), {"bytes": 100})[1]


@query("filter_eligibility", """
WITH c AS (SELECT o_orderkey AS candidate_id, o_orderkey % 40 AS a FROM orders),
x AS (SELECT *, a < 36 AS indexed, a % 9 <> 8 AS has, a % 7 = 1 AS sensitive, a % 5 = 2 AS bin, a % 11 = 3 AS skipped, a % 6 = 4 AS gen FROM c),
y AS (SELECT *, CASE WHEN NOT indexed THEN 'unavailable:not_indexed' WHEN NOT has THEN 'eligible:no_record' WHEN sensitive THEN
  'prohibited:sensitive' WHEN bin THEN 'unavailable:binary' WHEN skipped THEN 'unavailable:skipped' WHEN gen THEN
  'eligible:generated_penalty' ELSE 'eligible:clean' END AS r FROM x)
SELECT candidate_id, split_part(r, ':', 1) AS eligibility, split_part(r, ':', 2) AS eligibility_reason, CASE WHEN r = 'eligible:generated_penalty' THEN 3 ELSE 2 END AS n_evidence FROM y""")
def _(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select(
        F.expr("cast(substring(candidate_id, 2) as bigint)").alias("candidate_id"), "evidence",
    ).withColumn("artifact_id", F.col("candidate_id") % 40)
    ids = spark.range(40).withColumnRenamed("id", "artifact_id")
    a = F.col("artifact_id")
    labels = F.array_compact(F.array(F.when(a % 7 == 1, "sensitive"), F.when(a % 5 == 2, "binary"), F.when(a % 6 == 4, "generated")))
    records = ids.filter("artifact_id % 9 <> 8").select(
        "artifact_id", labels.alias("classifications"),
        F.when(a % 11 == 3, "skipped").otherwise("available").alias("availability"),
    )
    out = r.filter_eligibility(rows, ids.filter("artifact_id < 36"), records)
    return out.select("candidate_id", "eligibility", "eligibility_reason", F.size("evidence").alias("n_evidence"))


# --- The simple retriever ----------------------------------------------------------------------------------------

_UNITS = f"""s0 AS (SELECT task_id, unit_id AS candidate_id, path, line, strlen(text) AS bytes, length(text) AS characters, keywords, list_filter(keywords, lambda k: contains({FOLD.format('path')}, k)) AS ph, list_filter(keywords, lambda k: contains({FOLD.format('text')}, k)) AS ch FROM search_units, tasks2),
s1 AS (SELECT *, 3 * len(ph) + len(ch) AS score FROM s0 WHERE len(ph) + len(ch) > 0)"""
_TASKS2 = "tasks2 AS (SELECT task_id, list_concat(keywords, CASE WHEN task_id % 3 = 0 THEN ['current', 'mod_1'] ELSE ['page_2'] END) AS keywords FROM tasks)"
_OLD = f"o AS (SELECT path, bool_or(regexp_matches({FOLD.format('text')}, 'archive|deprecated|historical|legacy')) AS old FROM search_units GROUP BY path), s2 AS (SELECT s1.* EXCLUDE (score), CASE WHEN old_now THEN score ELSE 0 END AS historical_penalty, CASE WHEN old_now THEN 0 ELSE score END AS score FROM (SELECT s1.*, list_contains(keywords, 'current') AND (old OR regexp_matches(path, 'archive|deprecated|historical|legacy')) AS old_now FROM s1 JOIN o USING (path)) s1)"
_LINKS = "l AS (SELECT a.doc_id AS rid, a.path AS sp, b.path AS tp FROM artifacts a JOIN artifacts b ON b.doc_id = (a.doc_id * 3 + 1) % (SELECT max(doc_id) + 1 FROM artifacts))"
_BOOST = """b AS (SELECT task_id, max(score) AS top FROM s2 GROUP BY 1 HAVING max(score) > 0), sd AS (SELECT DISTINCT task_id, path FROM s2 JOIN b USING (task_id) WHERE score = top AND historical_penalty = 0),
hh AS (SELECT task_id, tp AS path, count(DISTINCT rid) AS links FROM sd JOIN l ON sp = path GROUP BY 1, 2), h2 AS (SELECT * FROM
  hh WHERE (task_id, path) NOT IN (SELECT task_id, path FROM sd)),
s3 AS (SELECT s2.* EXCLUDE (score), s2.score AS s2score, CASE WHEN links IS NOT NULL AND historical_penalty = 0 THEN least(s2.score + 4 * links, greatest(0, top - 1)) ELSE s2.score END AS score FROM s2 LEFT JOIN h2 USING (task_id, path) LEFT JOIN b USING (task_id))"""
_DEDUPE = "s4 AS (SELECT *, row_number() OVER (PARTITION BY task_id, path, line // 2 ORDER BY score DESC, bytes, candidate_id) > 1 AS duplicate FROM s3)"
_SELECT = """o5 AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY -score, bytes, candidate_id) AS i, CASE WHEN characters = 0 THEN 0 ELSE greatest(1, (characters * 11 + 39) // 40) END AS tokens FROM s4 WHERE score > 0 AND NOT duplicate),
f AS (SELECT DISTINCT task_id, 0::BIGINT AS i, 0::BIGINT AS b, 0 AS n, []::VARCHAR[] AS arts, NULL::VARCHAR AS cid, false AS fits FROM o5
  UNION ALL SELECT task_id, i, CASE WHEN ok THEN b + bytes ELSE b END, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN
  list_distinct(list_append(arts, path)) ELSE arts END, candidate_id, ok
  FROM (SELECT f.task_id, o5.i, f.b, f.n, f.arts, o5.candidate_id, o5.bytes, o5.path, f.b + o5.bytes <= 4000 AND f.n + 1 <= 5 AND
  (list_contains(f.arts, o5.path) OR len(f.arts) + 1 <= 3) AS ok FROM f JOIN o5 ON f.task_id = o5.task_id AND o5.i = f.i + 1)),
s5 AS (SELECT s4.*, CASE WHEN f.fits THEN f.n::INT ELSE 0 END AS selected_rank, CASE WHEN f.fits THEN 'selected' ELSE 'excluded' END AS outcome,
  CASE WHEN duplicate THEN 'duplicate_content' WHEN score <= 0 THEN 'below_relevance_threshold' WHEN NOT coalesce(f.fits, false) THEN 'context_budget_exceeded' ELSE 'lexical_content_match' END AS reason FROM s4 LEFT JOIN f ON f.task_id = s4.task_id AND f.cid = s4.candidate_id)"""
_VIEWS = ["artifacts", "search_units", "tasks"]


def _chain(upto: str, body: str) -> str:
    steps = [_TASKS2, _UNITS, _OLD, _LINKS, _BOOST, _DEDUPE, _SELECT]
    names = ["tasks2", "units", "old", "links", "boost", "dedupe", "select"]
    return with_views(_VIEWS, ",\n".join(steps[: names.index(upto) + 1]) + "\n" + body).replace("WITH ", "WITH RECURSIVE ", 1)


def _tasks(spark, sf_dir):
    extra = F.when(F.col("task_id") % 3 == 0, F.array(F.lit("current"), F.lit("mod_1"))).otherwise(F.array(F.lit("page_2")))
    return views.tasks(spark, sf_dir).select("task_id", F.concat("keywords", extra).alias("search_terms"))


def _links(spark, sf_dir):
    a = views.artifacts(spark, sf_dir).select("doc_id", "path")
    to = a.select(F.col("doc_id").alias("to"), F.col("path").alias("target_path"))
    size = F.broadcast(a.agg((F.max("doc_id") + 1).alias("size")))
    rows = a.crossJoin(size).withColumn("to", (F.col("doc_id") * 3 + 1) % F.col("size")).join(to, "to")
    return rows.select(
        F.col("doc_id").alias("relationship_id"), F.col("path").alias("source_path"), "target_path",
        F.lit("imports").alias("kind"), F.lit("resolved_internal").alias("resolution"),
    )


def _scored(spark, sf_dir):
    return r.score_units(_tasks(spark, sf_dir), views.search_units(spark, sf_dir))


def _boosted(spark, sf_dir):
    now = r.suppress_historical(_scored(spark, sf_dir), views.search_units(spark, sf_dir))
    return r.boost_dependencies(now.drop("search_terms"), _links(spark, sf_dir))


def _selected(spark, sf_dir):
    rows = r.dedupe_spans(_boosted(spark, sf_dir).withColumn("pair", F.expr("int(substring(candidate_id, 11)) div 2")), ["path", "pair"])
    return r.select_simple(rows, _limits(_tasks(spark, sf_dir)))


def _limits(tasks):
    return tasks.select("task_id", F.lit(5).alias("max_items"), F.lit(4000).alias("max_bytes"), F.lit(3).alias("max_artifacts"))


@query(
    "score_units",
    _chain("units", "SELECT task_id, candidate_id, score, array_to_string(ph, ',') AS path_hits, array_to_string(ch, ',') AS content_hits FROM s1"),
)
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "task_id", "candidate_id", "score", F.array_join("path_hits", ",").alias("path_hits"),
        F.array_join("content_hits", ",").alias("content_hits"),
    )


@query("score_symbols", with_views(["artifacts", "search_units", "symbols", "tasks"], f"""{_TASKS2},
y AS (SELECT symbol_id, name, 'src/mod_' || (substr(symbol_id, 4)::INT * 200 % 1000) || '.py' AS path FROM symbols), z AS (SELECT
  path, sum(strlen(text))::BIGINT AS bytes FROM search_units GROUP BY 1),
k AS (SELECT task_id, list_append(keywords, ['gear', 'bolt', 'ring', 'widget'][(task_id % 4 + 1)::INT]) AS keywords FROM tasks2),
h AS (SELECT task_id, symbol_id, path, 3 * len(list_filter(keywords, lambda k: contains(path, k))) + 6 * len(list_filter(keywords,
  lambda k: contains(lower(name), k))) AS score FROM y, k)
SELECT task_id, symbol_id AS candidate_id, score, coalesce(bytes, 0) AS bytes FROM h LEFT JOIN z USING (path) WHERE score > 0"""))
def _(spark, sf_dir):
    symbols = views.symbols(spark, sf_dir).withColumn(
        "path", F.concat(F.lit("src/mod_"), F.expr("int(substring(symbol_id, 4))") * 200 % 1000, F.lit(".py")),
    )
    tasks = _tasks(spark, sf_dir).withColumn(
        "search_terms", F.concat("search_terms", F.array(_pick(["gear", "bolt", "ring", "widget"], F.col("task_id")))),
    )
    return r.score_symbols(tasks, symbols, views.search_units(spark, sf_dir)).select("task_id", "candidate_id", "score", "bytes")


@query("suppress_historical", _chain("old", "SELECT task_id, candidate_id, score, historical_penalty FROM s2"))
def _(spark, sf_dir):
    return r.suppress_historical(
        _scored(spark, sf_dir), views.search_units(spark, sf_dir),
    ).select("task_id", "candidate_id", "score", "historical_penalty")


@query("boost_dependencies", _chain("boost", "SELECT task_id, candidate_id, score, score - s2score AS structural_boost FROM s3"))
def _(spark, sf_dir):
    return _boosted(spark, sf_dir).select("task_id", "candidate_id", "score", "structural_boost")


@query("dedupe_spans", _chain("dedupe", "SELECT task_id, candidate_id, duplicate FROM s4"))
def _(spark, sf_dir):
    rows = _boosted(spark, sf_dir).withColumn("pair", F.expr("int(substring(candidate_id, 11)) div 2"))
    return r.dedupe_spans(rows, ["path", "pair"]).select("task_id", "candidate_id", "duplicate")


@query("retrieve", _chain("select", "SELECT task_id, candidate_id, outcome, reason, selected_rank FROM s5"))
def _(spark, sf_dir):
    return _selected(spark, sf_dir).select(
        "task_id", "candidate_id", "outcome", "reason", F.coalesce("selected_rank", F.lit(0)).alias("selected_rank"),
    )


@query("retrieval_status", _chain("select", """, m AS (SELECT task_id, bool_or(list_contains(ph, 'mod_1')) AS met FROM s5 WHERE outcome = 'selected' GROUP BY 1)
SELECT task_id, CASE WHEN met IS NULL OR (task_id % 3 = 0 AND NOT met) THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN met IS NULL THEN 'RETRIEVAL_NO_RELEVANT_CONTEXT' WHEN task_id % 3 = 0 AND NOT met THEN 'RETRIEVAL_INSUFFICIENT_CONTEXT' END AS code FROM tasks2 LEFT JOIN m USING (task_id)"""))
def _(spark, sf_dir):
    tasks = _tasks(spark, sf_dir).withColumn(
        "signals",
        F.when(F.col("task_id") % 3 == 0, F.array(F.lit("mod_1"))).otherwise(F.array().cast("array<string>")),
    )
    return r.retrieval_status(tasks, _selected(spark, sf_dir))


@query("retrieval_statistics", _chain("select", """SELECT task_id, count(*) AS candidates_generated, count(DISTINCT CASE WHEN outcome = 'selected' THEN path END) AS artifacts_selected, count(*) FILTER (WHERE outcome = 'selected') AS excerpts_selected, 0 AS symbols_selected,
  count(*) FILTER (WHERE reason = 'context_budget_exceeded') AS budget_excluded, count(*) FILTER (WHERE reason = 'duplicate_content') AS duplicates,
  sum(CASE WHEN outcome = 'selected' THEN greatest(1, (characters * 11 + 39) // 40) ELSE 0 END)::BIGINT AS selected_tokens FROM s5 GROUP BY task_id"""))
def _(spark, sf_dir):
    return r.retrieval_statistics(_selected(spark, sf_dir))


@query("check_selection", _chain("select", """, c AS (SELECT task_id, candidate_id, CASE WHEN abs(score) % 2 = 1 THEN 'eligible' ELSE 'prohibited' END AS eligibility FROM s5 WHERE outcome = 'selected')
SELECT task_id, candidate_id, 'INELIGIBLE_SELECTED' AS code FROM c WHERE eligibility <> 'eligible' UNION ALL SELECT task_id, candidate_id, 'SELECTION_MISMATCH' FROM c WHERE task_id % 2 = 0"""))
def _(spark, sf_dir):
    rows = _selected(spark, sf_dir).withColumn("eligibility", F.when(F.abs("score") % 2 == 1, "eligible").otherwise("prohibited"))
    return r.check_selection(rows, rows.filter("outcome = 'selected' and task_id % 2 = 1"))


@query("fallback_smallest", with_views(["artifacts", "search_units", "tasks"], """
z AS (SELECT path, sum(strlen(text))::BIGINT AS bytes FROM search_units GROUP BY 1), o AS (SELECT path, bytes, row_number() OVER
  (ORDER BY bytes, 'artifact-' || path) AS i FROM z),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS b, 0 AS n, NULL::VARCHAR AS p, false AS fits UNION ALL
  SELECT o.i, CASE WHEN f.b + bytes <= 4000 AND n + 1 <= 3 THEN f.b + bytes ELSE f.b END, CASE WHEN f.b + bytes <= 4000 AND n + 1
  <= 3 THEN n + 1 ELSE n END, path, f.b + bytes <= 4000 AND n + 1 <= 3 FROM f JOIN o ON o.i = f.i + 1)
SELECT task_id, 'artifact-' || p AS candidate_id, n AS selected_rank FROM tasks, f WHERE fits AND task_id % 4 = 0""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    limits = tasks.select("task_id", F.lit(5).alias("max_items"), F.lit(4000).alias("max_bytes"), F.lit(3).alias("max_artifacts"))
    return r.fallback_smallest(tasks, tasks.filter("task_id % 4 <> 0"), views.search_units(spark, sf_dir), limits)
