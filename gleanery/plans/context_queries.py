"""Queries on bundles, prompts and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as c
from ..operators.scan import content_fingerprint
from . import views
from .views import with_views

QUERIES, ORACLE_SQL = {}, {}
REASONS = ["lexical_content_match", "exact_path_match", "required_context", "dependency_relationship"]
TYPES = ["source_excerpt", "full_artifact", "structural_unit", "dependency_record", "symbol_definition"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _pick(values, n):
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _items(spark, sf_dir):
    """One item for each document: its first lines, some with a stale fingerprint or a span beyond the end."""
    a = views.artifacts(spark, sf_dir)
    k = F.col("doc_id")
    last = F.when(k % 4 == 0, None).otherwise(F.when(k % 5 == 0, 99_999).otherwise(1 + k % 2)).cast("int")
    rows = a.select(
        k, (k % 37).alias("bundle_id"), "project_id", "path", F.concat(F.lit("i"), k).alias("item_id"), F.concat(F.lit("c"), k).alias("candidate_id"), F.concat(F.lit("a"), k % 300).alias("artifact_id"), F.col("path").alias("content_reference"),
        F.when(k % 9 == 0, "sha256:old").otherwise(
            content_fingerprint(F.col("content"))
        ).alias("content_fingerprint"), _pick(TYPES, k).alias("type"), _pick(REASONS, F.floor(k / 2)).alias("reason"), F.when(k % 6 != 0, k % 11).alias("rank"),
        F.when(
            k % 7 == 0, F.array(F.lit("x")),
        ).otherwise(F.array().cast("array<string>")).alias("dependency_path"), (k % 50).alias("estimated_tokens"), last.alias("end_line"), F.when(k % 17 == 0, "unclassified").otherwise("standard").alias("sensitivity"),
    )
    spanned = F.col("end_line").isNotNull()
    return rows.withColumns({"start_line": F.when(spanned, 1), "start_column": F.when(spanned, 2), "end_column": F.when(spanned, 3)}), a


_ITEMS = f"""i AS (SELECT doc_id, doc_id % 37 AS bundle_id, project_id, path, 'i' || doc_id AS item_id, 'c' || doc_id AS candidate_id, 'a' || (doc_id % 300) AS artifact_id, CASE WHEN doc_id % 9 = 0 THEN 'sha256:old' ELSE 'sha256:' || sha256(content) END AS fp, {TYPES}[(doc_id % 5 + 1)::INT] AS type,
  {REASONS}[(doc_id // 2 % 4 + 1)::INT] AS reason, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 11 END AS rank, doc_id % 7 = 0 AS dep,
  doc_id % 50 AS tok, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN 99999 ELSE 1 + doc_id % 2 END END AS el,
  content, string_split(content, chr(10)) AS ls FROM artifacts),
m AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'stale' WHEN el IS NOT NULL AND (el > len(ls) OR (el = len(ls) AND ls[-1] = '') OR
  length(ls[1]) + 1 < 1 OR 3 > length(ls[el]) + CASE WHEN el < len(ls) THEN 1 ELSE 0 END) THEN 'out_of_range' END AS failure FROM i),
c AS (SELECT *, CASE WHEN failure IS NULL THEN CASE WHEN el IS NULL THEN content WHEN el = 1 THEN substr(ls[1] || CASE WHEN
  len(ls) > 1 THEN chr(10) ELSE '' END, 2, 2) ELSE substr(ls[1] || chr(10), 2) || substr(ls[2] || CASE WHEN len(ls) > 2 THEN
  chr(10) ELSE '' END, 1, 3) END END AS txt FROM m),
t AS (SELECT *, CASE WHEN reason = 'exact_path_match' THEN 0 WHEN dep THEN 3 WHEN type IN ('full_artifact', 'symbol_definition')
  THEN 1 WHEN type = 'structural_unit' THEN 2 WHEN type = 'dependency_record' THEN 3 ELSE 4 END AS tier FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY tier, rank NULLS LAST, lower(path), CASE WHEN el IS NULL THEN 0 ELSE 1 END, CASE WHEN el IS NULL THEN 0 ELSE 2 END, coalesce(el, 0), CASE WHEN el IS NULL THEN 0 ELSE 3 END, candidate_id) AS ord FROM t)"""


def _materialized(spark, sf_dir):
    items, a = _items(spark, sf_dir)
    return c.materialize(items, a)


@query("materialize", with_views(["artifacts"], f"{_ITEMS} SELECT item_id, failure, sha256(txt) AS content_sha256 FROM o"))
def _(spark, sf_dir):
    return _materialized(spark, sf_dir).select("item_id", "failure", F.sha2("content", 256).alias("content_sha256"))


@query("order_items", with_views(["artifacts"], f"{_ITEMS} SELECT bundle_id, item_id, tier, ord FROM o"))
def _(spark, sf_dir):
    return c.order_items(_items(spark, sf_dir)[0]).select("bundle_id", "item_id", "tier", "ord")


def _good(spark, sf_dir):
    return c.order_items(_materialized(spark, sf_dir).filter("failure is null"))


@query("bundle_statistics", with_views(["artifacts"], f"""{_ITEMS} SELECT bundle_id, count(*) AS item_count, count(DISTINCT artifact_id) AS artifact_count, count(*) FILTER (WHERE type = 'symbol_definition') AS symbol_count, count(*) FILTER (WHERE type = 'source_excerpt') AS excerpt_count,
  sum(strlen(txt))::BIGINT AS byte_count, sum(length(txt))::BIGINT AS character_count, sum(CASE WHEN txt = '' THEN 0 ELSE length(txt) - length(replace(txt, chr(10), '')) + 1 END)::BIGINT AS line_count, sum(tok)::BIGINT AS estimated_tokens FROM o WHERE failure IS NULL GROUP BY 1"""))
def _(spark, sf_dir):
    return c.bundle_statistics(_good(spark, sf_dir))


@query("validate_bundles", with_views(["artifacts"], f"""{_ITEMS},
b AS (SELECT DISTINCT bundle_id FROM o WHERE failure IS NULL), x AS (SELECT * FROM o WHERE failure IS NULL AND doc_id % 41 <> 5),
  y AS (SELECT * FROM o WHERE failure IS NULL AND doc_id % 43 <> 6),
k AS (SELECT bundle_id, count(*) FILTER (WHERE y.item_id IS NULL) AS extra, count(*) FILTER (WHERE x.item_id IS NULL) AS lacking
  FROM (SELECT bundle_id, item_id FROM x) x FULL JOIN (SELECT bundle_id, item_id FROM y) y USING (bundle_id, item_id) GROUP BY 1),
z AS (SELECT bundle_id, sum(strlen(txt)) AS bytes, count(*) AS n FROM x GROUP BY 1)
SELECT bundle_id, 'CONTEXT_TRACEABILITY_MISMATCH' AS code, 'task_id' AS detail FROM b WHERE bundle_id % 10 = 3
UNION ALL SELECT bundle_id, 'CONTEXT_MEMBERSHIP_MISMATCH', extra || '/' || lacking FROM k WHERE extra > 0 OR (lacking > 0 AND bundle_id % 2 = 0)
UNION ALL SELECT x.bundle_id, 'CONTEXT_SENSITIVITY_MISSING', x.item_id FROM x JOIN y USING (item_id) WHERE x.doc_id % 17 = 0
UNION ALL SELECT bundle_id, 'CONTEXT_BUDGET_EXCEEDED', 'max_bytes' FROM z WHERE bytes > 20000 UNION ALL SELECT bundle_id, 'CONTEXT_BUDGET_EXCEEDED', 'max_items' FROM z WHERE n > 18"""))
def _(spark, sf_dir):
    rows = _good(spark, sf_dir)
    bundles = rows.select("bundle_id").distinct().select(
        "bundle_id", F.lit("r").alias("retrieval_id"),
        F.when(F.col("bundle_id") % 10 == 3, "other").otherwise("t").alias("task_id"),
        F.lit("p").alias("project_fingerprint"), F.lit("r").alias("expected_retrieval_id"),
        F.lit("t").alias("expected_task_id"), F.lit("p").alias("expected_project_fingerprint"),
        (F.col("bundle_id") % 2 == 1).alias("has_diagnostics"),
    )
    items = rows.filter("doc_id % 41 <> 5").drop("content_fingerprint", "sensitivity")
    selection = rows.filter("doc_id % 43 <> 6").select("bundle_id", "item_id", "content_fingerprint", "sensitivity")
    limits = bundles.select("bundle_id", F.lit(20_000).alias("max_bytes"), F.lit(18).alias("max_items"))
    return c.validate_bundles(bundles, items, selection, limits)


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_XML = f"""s AS (SELECT bundle_id, string_agg('<context_item id="' || item_id || '" type="' || type || '"><path>' || {_ESC.format('path')} || '</path><source_fingerprint>' || fp || '</source_fingerprint><content trust="untrusted">' || {_ESC.format('txt')} || '</content></context_item>', '' ORDER BY ord) AS x FROM o WHERE failure IS NULL GROUP BY 1),
q AS (SELECT bundle_id, '<context_bundle bundle_id="' || bundle_id || '"><task_id>' || bundle_id || '</task_id><sections>' || x || '</sections></context_bundle>' AS context FROM s)"""


def _prompts(spark, sf_dir):
    rows = _good(spark, sf_dir)
    bundles = rows.select("bundle_id").distinct().withColumn("task_id", F.col("bundle_id"))
    tasks = views.tasks(spark, sf_dir).select("task_id", "task_text")
    return c.assemble_prompts(tasks, c.serialize_bundles(bundles, rows), {"format": "text", "version": 1})


_MESSAGES = f"""{_XML},
p AS (SELECT bundle_id, unnest([0, 1, 2, 3, 4]) AS ord, unnest(['system-operating-rules', 'task-specification',
  'context-usage-rules', 'serialized-context-bundle', 'output-response-contract']) AS section, unnest(['system', 'user', 'system',
  'user', 'user']) AS role,
  unnest(['trusted', 'trusted', 'trusted', 'untrusted', 'trusted']) AS trust, unnest(['{c.RULES}', '{{"original_instruction":"' || task_text || '","task_id":"' || task_id || '"}}', '{c.CONTEXT_RULES}', context, '{{"format":"text","version":1}}']) AS content FROM q JOIN tasks ON task_id = bundle_id)"""


@query(
    "assemble_prompts",
    with_views(
        ["artifacts", "tasks"],
        f"{_ITEMS}, {_MESSAGES} SELECT bundle_id, ord, section, role, trust, sha256(content) AS content_sha256 FROM p",
    ),
)
def _(spark, sf_dir):
    return _prompts(spark, sf_dir).select("bundle_id", "ord", "section", "role", "trust", F.sha2("content", 256).alias("content_sha256"))


@query("measure_prompts", with_views(["artifacts", "tasks"], f"""{_ITEMS}, {_MESSAGES},
w AS (SELECT bundle_id, string_agg('<message section=' || section || ' role=' || role || ' trust=' || trust || '>' || chr(10) ||
  content || chr(10) || '</message>', chr(10) ORDER BY ord) AS t, sum(CASE WHEN trust = 'untrusted' THEN length(content) ELSE 0
  END)::BIGINT AS untrusted_characters, sum(CASE WHEN role = 'system' THEN length(content) ELSE 0 END)::BIGINT AS
  instruction_characters FROM p GROUP BY 1),
z AS (SELECT *, strlen(t)::BIGINT AS byte_count, length(t)::BIGINT AS character_count, (length(t) - length(replace(t, chr(10),
  '')) + 1)::BIGINT AS line_count, greatest(1, (length(t) * 11 + 39) // 40)::BIGINT AS estimated_tokens FROM w)
SELECT bundle_id, byte_count, character_count, line_count, untrusted_characters, instruction_characters, estimated_tokens,
  greatest(8000 - estimated_tokens, 0)::BIGINT AS remaining_capacity,
  array_to_string(list_filter([CASE WHEN byte_count > 20000 THEN 'bytes' END, CASE WHEN estimated_tokens > 8000 THEN 'provider_tokens' END], lambda x: x IS NOT NULL), ',') AS exceeded FROM z"""))
def _(spark, sf_dir):
    return c.measure_prompts(_prompts(spark, sf_dir), {"bytes": 20_000, "provider_tokens": 8_000})


@query("delivery_decision", """
WITH q AS (SELECT o_orderkey AS request_id, o_orderkey % 4 AS p, o_orderkey % 3 AS sens, o_orderkey % 9000 AS bytes, o_orderkey %
  2500 AS tok, o_orderkey % 5 = 0 AS tools FROM orders),
v AS (SELECT *, list_filter([CASE WHEN p = 3 THEN 'unknown_provider' END, CASE WHEN p = 1 AND sens > 0 THEN 'sensitive_remote'
  END, CASE WHEN p < 3 AND bytes > 3000 * (p + 1) THEN 'too_many_bytes' END, CASE WHEN p < 3 AND tok > 2000 THEN 'too_many_tokens'
  END, CASE WHEN p IN (0, 1) AND tools THEN 'missing:tools' END], lambda x: x IS NOT NULL) AS a FROM q)
SELECT request_id, len(a) = 0 AS allowed, array_to_string(list_sort(a), ',') AS violations FROM v""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    requests = views.table(spark, sf_dir, "orders").select(
        k.alias("request_id"), (k % 4).alias("provider_id"), (k % 3).alias("sensitive_items"),
        (k % 9000).alias("bytes"), (k % 2500).alias("tokens"),
        F.when(k % 5 == 0, F.array(F.lit("text"), F.lit("tools"))).otherwise(F.array(F.lit("text"))).alias("required"),
    )
    p = F.col("id")
    profiles = spark.range(3).select(
        p.alias("provider_id"), (p == 1).alias("is_remote"), (3000 * (p + 1)).alias("max_bytes"),
        F.lit(2000).alias("max_tokens"),
        F.when(p == 2, F.array(F.lit("text"), F.lit("tools"))).otherwise(F.array(F.lit("text"))).alias("supported"),
    )
    return c.delivery_decision(requests, profiles)
