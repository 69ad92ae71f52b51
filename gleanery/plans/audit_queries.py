"""Queries on responses, change sets, executions and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as a
from . import views
from .views import with_views

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- Redaction -----------------------------------------------------------------------------------------------------

_MASK = "regexp_replace(regexp_replace(regexp_replace({}, '(?i)\\bauthorization\\s*([:=])\\s*(?:bearer\\s+)?[^\\s,;]+', 'authorization\\1[REDACTED]', 'g'), '(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'), '(?i)\\b(password|token|secret|api[_-]?key|credential)\\s*([:=])\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s,;]+)', '\\1\\2[REDACTED]', 'g')"


@query(
    "redact_secrets",
    f"SELECT doc_id, sha256(r) AS text_sha256, r <> text AS redacted FROM (SELECT doc_id, text, {_MASK.format('text')} AS r FROM documents)",
)
def _(spark, sf_dir):
    rows = a.redact_secrets(views.table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "redacted")


@query(
    "redact_metadata",
    "SELECT event_id, '[REDACTED]' AS api_key, value::INT::VARCHAR AS tokens, event_type AS kind, '[REDACTED]' AS my_secret, '[REDACTED]' AS auth_token FROM events",
)
def _(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(
        "event_id",
        F.create_map(
            F.lit("API-Key"), F.lit("x"), F.lit("tokens"), F.expr("cast(bround(value, 0) as int)").cast("string"),
            F.lit("kind"), F.col("event_type"), F.lit("my.secret"), F.lit("y"), F.lit("Auth_Token"), F.lit("z"),
        ).alias("m"),
    )
    out = a.redact_metadata(rows, "m")
    return out.select(
        "event_id",
        *(
            F.col("m")[k].alias(n) for k, n in (
                ("API-Key", "api_key"), ("tokens", "tokens"), ("kind", "kind"), ("my.secret", "my_secret"),
                ("Auth_Token", "auth_token"),
            )
        ),
    )


@query(
    "merge_diagnostics",
    """SELECT DISTINCT 'EVENT_' || upper(event_type) AS code, ['critical', 'error', 'warning', 'info'][(user_id % 4 + 1)::INT] AS severity, 'u' || user_id AS reference, NULL::INT AS line, 'seen' AS message, user_id % 4 + 1 AS severity_rank FROM events""",
)
def _(spark, sf_dir):
    severity = F.get(F.array(*map(F.lit, a.SEVERITIES)), (F.col("user_id") % 4).cast("int"))
    rows = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("EVENT_"), F.upper("event_type")).alias("code"), severity.alias("severity"),
        F.concat(F.lit("u"), "user_id").alias("reference"), F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"), F.lit("seen").alias("message"),
    )
    return a.merge_diagnostics(rows.filter("reference < 'u5'"), rows).drop("column")


# --- Responses -----------------------------------------------------------------------------------------------------


@query("normalize_responses", """
WITH r AS (SELECT conv_id AS response_id, turn, text AS content FROM conversations WHERE role = 'assistant' UNION ALL SELECT
  -event_id, 0, props FROM events),
s AS (SELECT *, CASE WHEN response_id % 3 = 0 THEN 'interrupted' ELSE 'completed' END AS fs, response_id % 2 = 0 AS structured,
  coalesce(json_valid(content) AND ltrim(content) LIKE '{%', false) AS obj FROM r)
SELECT response_id, turn, CASE WHEN fs = 'completed' AND structured AND NOT obj THEN 'failed' ELSE fs END AS final_state, CASE WHEN fs = 'completed' AND structured AND NOT obj THEN 'malformed' ELSE 'stop' END AS final_reason, NOT (fs = 'completed' AND (NOT structured OR obj)) AS kept_raw FROM s""")
def _(spark, sf_dir):
    said = views.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("response_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("content"),
    )
    rows = said.unionByName(
        views.table(spark, sf_dir, "events").select(
            (-F.col("event_id")).alias("response_id"), F.lit(0).cast("long").alias("turn"),
            F.col("props").alias("content"),
        )
    )
    rows = rows.select(
        "*", F.when(F.col("response_id") % 3 == 0, "interrupted").otherwise("completed").alias("finish_state"),
        F.lit("stop").alias("finish_reason"),
        F.when(F.col("response_id") % 2 == 0, "structured").otherwise("text").alias("response_format"),
    )
    return a.normalize_responses(rows).select("response_id", "turn", "final_state", "final_reason", F.col("raw").isNotNull().alias("kept_raw"))


@query("response_usage", """
SELECT l_orderkey AS response_id, l_linenumber AS turn, CASE WHEN l_orderkey % 17 = 3 THEN 'negative' WHEN l_orderkey % 5 = 1 AND l_orderkey % 7 <> 2
  THEN 'total_mismatch' END AS usage_error FROM lineitem""")
def _(spark, sf_dir):
    """Line items as the token counts of responses: some don't add up, some are below zero, some are unknown."""
    k = F.col("l_orderkey")
    rows = views.table(spark, sf_dir, "lineitem").select(
        k.alias("response_id"), F.col("l_linenumber").alias("turn"), F.lit("completed").alias("finish_state"), F.lit("stop").alias("finish_reason"),
        F.lit("text").alias("response_format"), F.lit("x").alias("content"), F.col("l_partkey").alias("input_tokens"),
        F.when(k % 7 != 2, F.col("l_suppkey")).alias("output_tokens"), (F.col("l_partkey") + F.col("l_suppkey") + F.when(k % 5 == 1, 1).otherwise(0)).alias("total_tokens"),
        F.when(k % 17 == 3, -1).otherwise(1).alias("output_bytes"),
    )
    return a.normalize_responses(rows).select("response_id", "turn", "usage_error")


def _envelopes(spark, sf_dir):
    """An envelope for each order, each with a flaw of its own kind."""
    k = F.col("o_orderkey")
    change = F.struct(
        F.concat(F.lit("src/f_"), k % 50, F.lit(".py")).alias("path"),
        F.get(F.array(*map(F.lit, a.OPERATIONS)), (k % 4).cast("int")).alias("operation"),
        F.when(k % 4 == 3, F.lit("src/new.py")).alias("destination_path"),
        F.when(k % 4 < 2, F.concat(F.lit("line"), k)).alias("payload"),
        F.when(k % 6 == 0, F.concat(F.lit("id"), k)).alias("change_id"),
    )
    extra = F.struct(
        F.when(k % 5 == 1, F.lit("src/f_1.py")).otherwise(F.lit("docs/x.md")).alias("path"),
        F.when(k % 7 == 1, "explode").otherwise("delete").alias("operation"),
        F.lit(None).cast("string").alias("destination_path"), F.lit(None).cast("string").alias("payload"),
        F.lit(None).cast("string").alias("change_id"),
    )
    changes = F.when(k % 10 == 1, F.array(change, extra)).otherwise(F.array(change))
    files = F.array_compact(F.concat(F.transform(changes, lambda c: c["path"]), F.transform(changes, lambda c: c["destination_path"])))
    files = F.when(k % 11 == 2, F.concat(files, files)).when(k % 11 == 3, F.array(F.lit("odd.py"))).otherwise(files)
    body = F.to_json(
        F.struct(
            F.when(k % 13 == 4, "analysis").otherwise("patch").alias("type"),
            F.when(k % 13 == 10, "ed_script").when(k % 13 != 11, "unified_diff").alias("patch_format"),
            F.when(k % 13 == 5, " ").otherwise("done").alias("summary"),
            F.when(k % 13 != 6, files).alias("affected_files"), changes.alias("changes"),
        )
    )
    content = F.when(k % 13 == 7, "not json").when(k % 13 == 8, F.concat(F.lit("["), body, F.lit("]"))).when(
        k % 13 == 9, F.concat(body, F.repeat(F.lit(" "), 3000)),
    ).otherwise(body)
    return views.table(spark, sf_dir, "orders").select(k.alias("proposal_id"), content.alias("content"))


@query("validate_envelopes", """
WITH e AS (SELECT o_orderkey AS k, o_orderkey % 13 AS m, o_orderkey % 11 AS n, o_orderkey % 10 = 1 AS two, o_orderkey % 5 = 1 AS same FROM orders)
SELECT k AS proposal_id, CASE WHEN m = 9 THEN 'ENVELOPE_TOO_LARGE' WHEN m IN (7, 8) THEN 'ENVELOPE_MALFORMED' WHEN m = 6 THEN
  'ENVELOPE_FIELD_MISSING' WHEN m = 4 THEN 'ENVELOPE_TYPE_MISMATCH' WHEN m IN (10, 11) THEN 'ENVELOPE_UNKNOWN_FORMAT' WHEN m = 5 THEN 'ENVELOPE_EMPTY_TEXT'
  WHEN n = 2 OR (n <> 3 AND two AND same AND k % 50 = 1) THEN 'ENVELOPE_DUPLICATE_FILE' WHEN n = 3 THEN 'ENVELOPE_FILES_MISMATCH' END AS code FROM e""")
def _(spark, sf_dir):
    return a.validate_envelopes(
        _envelopes(spark, sf_dir), ["type", "summary", "affected_files", "changes"], "patch", 2_500, ["unified_diff", "structured_changes"],
    ).select("proposal_id", "code")


@query("parse_changes", """
WITH e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 13 NOT IN (7, 8)),
c AS (SELECT k, 'src/f_' || (k % 50) || '.py' AS path, ['create', 'modify', 'delete', 'rename'][(k % 4 + 1)::INT] AS operation, k
  % 10 = 1 AND k % 5 = 1 AND k % 50 = 1 AS dup, k % 6 = 0 AS named FROM e
  UNION ALL SELECT k, CASE WHEN k % 5 = 1 THEN 'src/f_1.py' ELSE 'docs/x.md' END, CASE WHEN k % 7 = 1 THEN 'explode' ELSE 'delete'
  END, k % 5 = 1 AND k % 50 = 1, false FROM e WHERE k % 10 = 1)
SELECT k AS proposal_id, path, operation, CASE WHEN operation = 'explode' THEN 'operation_unknown' WHEN dup THEN 'duplicate_path' END AS error, named FROM c""")
def _(spark, sf_dir):
    return a.parse_changes(_envelopes(spark, sf_dir)).select(
        "proposal_id", "path", "operation", "error", (~F.col("change_id").startswith("change_")).alias("named"),
    )


@query("ground_findings", """
WITH f AS (SELECT o_orderkey AS id, o_custkey AS t, CASE WHEN o_orderkey % 6 = 0 THEN [] WHEN o_orderkey % 6 = 1 THEN ['r' ||
  o_custkey, 'r0x'] ELSE ['r' || o_custkey] END AS ev, o_orderkey % 4 = 1 AS whole FROM orders)
SELECT id AS finding_id, 'FINDING_WITHOUT_EVIDENCE' AS code FROM f WHERE len(ev) = 0 UNION ALL SELECT id, 'FINDING_UNKNOWN_REFERENCE' FROM f WHERE len(ev) = 2 UNION ALL SELECT id, 'FINDING_OVERCLAIMED' FROM f WHERE whole AND t % 3 = 0""")
def _(spark, sf_dir):
    k, t = F.col("o_orderkey"), F.concat(F.lit("r"), "o_custkey")
    orders = views.table(spark, sf_dir, "orders")
    findings = orders.select(
        k.alias("finding_id"), F.col("o_custkey").alias("task_id"),
        F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 6 == 1, F.array(t, F.lit("r0x"))).otherwise(F.array(t)).alias("evidence"),
        F.when(k % 4 == 1, "complete").otherwise("partial").alias("coverage"),
    )
    tasks = orders.select(
        F.col("o_custkey").alias("task_id"), t.alias("reference"),
        F.when(F.col("o_custkey") % 3 == 0, "incomplete").otherwise("complete").alias("status"),
    ).distinct()
    return a.ground_findings(findings, tasks, tasks)


# --- Diffs ---------------------------------------------------------------------------------------------------------


def _patches(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.format_string(
        "--- a/src/f_%s.py\n+++ b/src/f_%s.py\n@@ -1,2 +1,%s @@ x\n context\n-old\n+%s\n", k, k,
        F.when((k % 5 == 0) & (k % 3 != 0) & (k % 4 != 1) & (k % 7 != 0), 9).otherwise(3), "p_name",
    )
    tail = F.when(k % 3 == 0, "+--- not a header\n@@ -9 +10 @@\n-a\n+b\n\\ No newline at end of file").otherwise("+two")
    new = F.format_string("--- /dev/null\n+++ b/new_%s.py\n@@ -0,0 +1 @@\n+only", k)
    return views.table(spark, sf_dir, "part").select(
        k.alias("patch_id"),
        F.when(k % 7 == 0, F.concat(head, tail, F.lit("\n"), new)).when(
            k % 4 == 1, F.replace(F.concat(head, tail), F.lit("-old"), F.lit("--- old")),
        ).otherwise(F.concat(head, tail)).alias("patch"),
    )


@query(
    "diff_lines",
    """SELECT p_partkey AS patch_id, 1 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS files, 1 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS hunks FROM part""",
)
def _(spark, sf_dir):
    lines = a.diff_lines(_patches(spark, sf_dir))
    return lines.groupBy("patch_id").agg(F.max("file").alias("files"), F.max("hunk").alias("hunks"))


@query("diff_stats", """
WITH p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS more, p_partkey % 7 = 0 AS two, NOT (p_partkey % 5 = 0 AND p_partkey % 3 <>
  0 AND p_partkey % 4 <> 1 AND p_partkey % 7 <> 0) AS consistent FROM part)
SELECT k AS patch_id, 1 AS file, 'src/f_' || k || '.py' AS old_path, 'src/f_' || k || '.py' AS new_path, 'modify' AS operation,
  CASE WHEN more THEN 2 ELSE 1 END AS hunks, CASE WHEN more THEN 3 ELSE 2 END AS added, CASE WHEN more THEN 2 ELSE 1 END AS removed, consistent FROM p
UNION ALL SELECT k, 2, '/dev/null', 'new_' || k || '.py', 'create', 1, 1, 0, true FROM p WHERE two""")
def _(spark, sf_dir):
    return a.diff_stats(a.diff_lines(_patches(spark, sf_dir)))


# --- Changes -------------------------------------------------------------------------------------------------------

_ODD = "CASE change_id % 12 WHEN 0 THEN '../x.py' WHEN 1 THEN '/etc/x' WHEN 2 THEN '.git/config' WHEN 3 THEN 'a\\b.py' WHEN 4 THEN '.env' ELSE path END"


@query("audit_paths", with_views(["proposed_changes"], """
c AS (SELECT *, change_id % 12 AS m, operation = 'rename' AS r FROM proposed_changes)
SELECT DISTINCT proposal_id, change_id, unnest(list_filter([CASE WHEN m IN (0, 1) THEN 'PATCH_PATH_OUTSIDE_PROJECT' END, CASE WHEN m IN (2, 4) THEN 'PATCH_PATH_PROTECTED' END, CASE WHEN r AND m > 4 AND path = destination_path THEN 'PATCH_PATH_INVALID_RENAME' END], lambda x: x IS NOT NULL)) AS code FROM c"""))
def _(spark, sf_dir):
    odd = F.expr(_ODD.replace("\\", "\\\\"))
    return a.audit_paths(views.proposed_changes(spark, sf_dir).withColumn("path", odd))


def _source(spark):
    n = F.col("id")
    return spark.range(50).filter("id % 3 <> 0").select(
        F.concat(F.lit("src/f_"), n, F.lit(".py")).alias("path"), F.concat(F.lit("fp"), n).alias("fingerprint"),
    )


_STATE = "s AS (SELECT 'src/f_' || i || '.py' AS path, 'fp' || i AS fingerprint FROM range(50) t(i) WHERE i % 3 <> 0)"
_OPERATIONS = """vo AS (SELECT proposal_id, change_id, unnest(list_filter([CASE WHEN operation = 'create' AND s.path IS NOT NULL THEN 'PATCH_CREATE_EXISTS' END, CASE WHEN operation <> 'create' AND s.path IS NULL THEN 'PATCH_SOURCE_MISSING' END, CASE WHEN operation = 'rename' AND d.path IS NOT NULL THEN 'PATCH_RENAME_TARGET_EXISTS' END,
  CASE WHEN s.path IS NOT NULL AND expected IS NOT NULL AND expected <> s.fingerprint THEN 'PATCH_OLD_FINGERPRINT_MISMATCH' END], lambda x: x IS NOT NULL)) AS code FROM c LEFT JOIN s ON c.path = s.path LEFT JOIN s d ON c.destination_path = d.path)"""


@query(
    "validate_operations",
    with_views(
        ["proposed_changes"],
        f"c AS (SELECT *, CASE WHEN change_id % 5 = 0 THEN 'fp' || (change_id % 50) WHEN change_id % 5 = 1 THEN 'old' END AS expected FROM proposed_changes), {_STATE}, {_OPERATIONS} SELECT * FROM vo",
    ),
)
def _(spark, sf_dir):
    k = F.col("change_id")
    rows = views.proposed_changes(spark, sf_dir).withColumn(
        "expected_old_fingerprint", F.when(k % 5 == 0, F.concat(F.lit("fp"), k % 50)).when(k % 5 == 1, "old"),
    )
    return a.validate_operations(rows, _source(spark))


_CONFLICTS = """cf AS (
  SELECT proposal_id, 'PATCH_CONFLICT_DUPLICATE_CHANGE_ID' AS code, change_id::VARCHAR AS subject FROM c GROUP BY 1, 3 HAVING count(*) > 1
  UNION ALL SELECT proposal_id, CASE WHEN count(DISTINCT operation) = 1 THEN 'PATCH_CONFLICT_DUPLICATE_OPERATION' ELSE
  'PATCH_CONFLICT_INCOMPATIBLE_OPERATIONS' END, path FROM c GROUP BY 1, 3 HAVING count(*) > 1
  UNION ALL SELECT proposal_id, 'PATCH_CONFLICT_RENAME_DESTINATION', destination_path FROM c WHERE operation = 'rename' GROUP BY
  1, 3 HAVING count(*) > 1
  UNION ALL SELECT proposal_id, 'PATCH_CONFLICT_RENAME_DESTINATION', path FROM c WHERE operation <> 'rename' AND (proposal_id, path) IN (SELECT proposal_id, destination_path FROM c WHERE operation = 'rename') AND (proposal_id, path) NOT IN (SELECT proposal_id, path FROM c WHERE operation = 'rename'))"""
_SPARSE = "c AS (SELECT o_custkey AS proposal_id, change_id, operation, path, destination_path FROM proposed_changes JOIN orders ON change_id = o_orderkey)"


@query("detect_conflicts", with_views(["proposed_changes"], f"{_SPARSE}, {_CONFLICTS} SELECT * FROM cf"))
def _(spark, sf_dir):
    return a.detect_conflicts(views.proposed_changes(spark, sf_dir, dense=False))


_CYCLES = """e AS (SELECT proposal_id, path, arg_max(destination_path, change_id) AS nxt FROM c WHERE operation = 'rename' GROUP BY 1, 2),
w AS (SELECT proposal_id, path AS start, nxt, path AS low, 1 AS n FROM e UNION ALL SELECT w.proposal_id, w.start, e.nxt,
  least(w.low, e.path), n + 1 FROM w JOIN e ON e.proposal_id = w.proposal_id AND e.path = w.nxt WHERE w.nxt <> w.start AND n < 60),
cy AS (SELECT DISTINCT proposal_id, low AS first_path, n AS length FROM w WHERE nxt = start)"""


@query(
    "rename_cycles",
    with_views(["proposed_changes"], f"c AS (SELECT * FROM proposed_changes), {_CYCLES} SELECT * FROM cy").replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, sf_dir):
    return a.rename_cycles(views.proposed_changes(spark, sf_dir))


def _evidence(spark, sf_dir):
    """Declared files (for every fifth proposal one of them doesn't fit) and fingerprints (odd for every seventh)."""
    p = F.col("proposal_id")
    files = F.array_compact(F.array("path", "destination_path"))
    told = views.proposed_changes(spark, sf_dir, dense=False).groupBy(p).agg(F.array_distinct(F.flatten(F.collect_list(files))).alias("files"))
    return told.select(
        p,
        F.when(p % 5 == 0, F.concat("files", F.array(F.lit("src/other.py")))).otherwise(F.reverse("files")).alias("affected_files"),
        F.lit("p1").alias("expected_project_fingerprint"),
        F.when(p % 7 == 0, "p2").otherwise("p1").alias("source_project_fingerprint"),
    )


_EVIDENCE = """ev AS (SELECT DISTINCT proposal_id, 'PATCH_CONSISTENCY_AFFECTED_FILES_MISMATCH' AS code FROM c WHERE proposal_id % 5 = 0 UNION SELECT DISTINCT proposal_id, 'PATCH_CONSISTENCY_PROJECT_FINGERPRINT_MISMATCH' FROM c WHERE proposal_id % 7 = 0)"""


@query("mismatched_evidence", with_views(["proposed_changes"], f"{_SPARSE}, {_EVIDENCE} SELECT * FROM ev"))
def _(spark, sf_dir):
    return a.mismatched_evidence(views.proposed_changes(spark, sf_dir, dense=False), _evidence(spark, sf_dir))


@query("proposal_verdicts", with_views(["proposed_changes"], f"""{_SPARSE.replace('destination_path FROM', 'destination_path, NULL::VARCHAR AS expected FROM')}, {_STATE}, {_OPERATIONS}, {_CONFLICTS}, {_CYCLES}, {_EVIDENCE},
k AS (SELECT proposal_id, code FROM vo UNION SELECT proposal_id, code FROM cf UNION SELECT proposal_id,
  'PATCH_CONFLICT_RENAME_CYCLE' FROM cy UNION SELECT proposal_id, 'PATCH_PATH_INVALID_RENAME' FROM c WHERE operation = 'rename'
  AND path = destination_path UNION SELECT * FROM ev),
l AS (SELECT proposal_id, string_agg(code, ',' ORDER BY code) AS codes FROM k GROUP BY 1)
SELECT proposal_id, codes IS NULL AS valid, coalesce(codes, '') AS codes FROM (SELECT DISTINCT proposal_id FROM c) LEFT JOIN l USING (proposal_id)""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf_dir):
    return a.proposal_verdicts(views.proposed_changes(spark, sf_dir, dense=False), _source(spark), _evidence(spark, sf_dir))


_PAYLOAD = "CASE change_id % 4 WHEN 0 THEN 'one' || chr(10) || 'two' WHEN 1 THEN '+++ b/x' || chr(10) || '+new' || chr(10) || '-old' || chr(10) || ' same' END"


@query("review_changes", with_views(["proposed_changes"], f"""c AS (SELECT *, {_PAYLOAD} AS payload FROM proposed_changes),
f AS (SELECT proposal_id, string_agg(p, ',' ORDER BY p) AS affected_files FROM (SELECT proposal_id, path AS p FROM c UNION SELECT
  proposal_id, destination_path FROM c WHERE destination_path IS NOT NULL) GROUP BY 1)
SELECT c.proposal_id, count(*) FILTER (WHERE operation = 'create') AS creates, count(*) FILTER (WHERE operation = 'modify') AS
  modifys, count(*) FILTER (WHERE operation = 'delete') AS deletes, count(*) FILTER (WHERE operation = 'rename') AS renames,
  sum(CASE change_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS added_lines, sum(CASE change_id % 4 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS removed_lines, any_value(affected_files) AS affected_files FROM c JOIN f USING (proposal_id) GROUP BY 1"""))
def _(spark, sf_dir):
    return a.review_changes(views.proposed_changes(spark, sf_dir).withColumn("payload", F.expr(_PAYLOAD.replace("chr(10)", "char(10)"))))


_PRINT = _SPARSE + """, j AS (SELECT proposal_id, string_agg('{"change_id":"' || change_id || '",' || CASE WHEN destination_path IS NULL THEN '' ELSE '"destination_path":"' || destination_path || '",' END || '"operation":"' || operation || '","path":"' || path || '"}', ',' ORDER BY path, change_id) AS j FROM c GROUP BY 1),
fp AS (SELECT proposal_id, 'proposal_sha256_' || sha256('{"proposal_id":"' || proposal_id || '","changes":[' || j || ']}') AS proposal_fingerprint FROM j)"""


@query("fingerprint_proposals", with_views(["proposed_changes"], f"{_PRINT} SELECT * FROM fp"))
def _(spark, sf_dir):
    return a.fingerprint_proposals(views.proposed_changes(spark, sf_dir, dense=False))


@query("revalidate_proposals", with_views(["proposed_changes"], f"""{_SPARSE.replace('destination_path FROM', 'destination_path, NULL::VARCHAR AS expected FROM')}, {_STATE}, {_OPERATIONS}
SELECT DISTINCT proposal_id, code FROM (SELECT proposal_id, code FROM vo UNION ALL SELECT DISTINCT proposal_id, 'PROPOSAL_CHANGED'
  FROM c WHERE proposal_id % 4 = 0 UNION ALL SELECT DISTINCT proposal_id, 'PROJECT_CHANGED' FROM c WHERE proposal_id % 5 = 0 OR proposal_id % 3 = 2
  UNION ALL SELECT proposal_id, 'PATH_NOT_WRITABLE' FROM c WHERE path LIKE '%9.py' OR destination_path LIKE '%9.py' UNION ALL SELECT proposal_id, 'PATCH_PATH_INVALID_RENAME' FROM c WHERE operation = 'rename' AND path = destination_path)"""))
def _(spark, sf_dir):
    rows = views.proposed_changes(spark, sf_dir, dense=False)
    p = F.col("proposal_id")
    stored = a.fingerprint_proposals(rows).select(
        p, F.concat(F.lit("p"), p % 3).alias("project_id"), F.when(p % 4 == 0, "old").otherwise(F.col("proposal_fingerprint")).alias("proposal_fingerprint"),
        F.when(p % 5 == 0, "old").otherwise(F.concat(F.lit("now"), p % 3)).alias("project_fingerprint"),
    )
    projects = spark.range(2).select(F.concat(F.lit("p"), "id").alias("project_id"), F.concat(F.lit("now"), "id").alias("project_fingerprint"))
    writable = spark.range(50).filter("id % 10 <> 9").select(F.concat(F.lit("src/f_"), "id", F.lit(".py")).alias("path"))
    return a.revalidate_proposals(stored, rows, _source(spark), projects, writable)


# --- Executions ----------------------------------------------------------------------------------------------------


@query(
    "latest_executions",
    with_views(["executions"], "SELECT task_id, arg_max(execution_id, (saved_at, execution_id)) AS execution_id FROM executions GROUP BY 1"),
)
def _(spark, sf_dir):
    return a.latest_executions(views.executions(spark, sf_dir)).select("task_id", "execution_id")


@query(
    "list_executions",
    with_views(
        ["executions"],
        "SELECT project_id, execution_id, row_number() OVER (PARTITION BY project_id ORDER BY saved_at DESC, execution_id DESC) AS place FROM executions",
    ),
)
def _(spark, sf_dir):
    return a.list_executions(views.executions(spark, sf_dir)).select("project_id", "execution_id", "place")


_STATUS = ["completed", "paused", "awaiting_approval", "interrupted", "running", "failed"]


def _runs(spark, sf_dir):
    k = F.col("execution_id")
    pick = lambda v, n: F.get(F.array(*map(F.lit, v)), (n % len(v)).cast("int"))
    done = F.slice(F.array(*map(F.lit, a.STAGES)), 1, (F.floor(k / 3) % 7).cast("int"))
    done = F.when(k % 8 == 0, F.reverse(done)).otherwise(done)
    return views.executions(spark, sf_dir).select(
        k, pick(_STATUS, k).alias("status"), pick([*a.STAGES, "apply"], F.floor(k / 5)).alias("stage"),
        done.alias("completed_stages"),
    )


_RUNS = f"""r AS (SELECT execution_id, {_STATUS}[(execution_id % 6 + 1)::INT] AS status, (execution_id // 5) % 7 + 1 AS stg, execution_id // 3 % 7 AS n, execution_id % 8 = 0 AND execution_id // 3 % 7 > 1 AS rev FROM executions)"""


@query(
    "recovery_disposition",
    with_views(
        ["executions"],
        f"{_RUNS} SELECT execution_id, CASE WHEN status IN ('completed', 'failed') THEN 'terminal' WHEN status = 'awaiting_approval' THEN 'awaiting_action' WHEN status IN ('paused', 'interrupted') AND stg NOT IN (6, 7) THEN 'resumable' ELSE 'manual_review' END AS disposition FROM r",
    ),
)
def _(spark, sf_dir):
    return a.recovery_disposition(_runs(spark, sf_dir)).select("execution_id", "disposition")


@query(
    "check_stage_history",
    with_views(
        ["executions"],
        f"{_RUNS} SELECT execution_id, CASE WHEN stg = 7 THEN 'unknown_stage' WHEN rev THEN 'not_a_prefix' WHEN status = 'completed' AND n <> 6 THEN 'completed_too_early' WHEN status <> 'completed' AND n <> 0 AND (stg < n OR stg > n + 1) THEN 'stage_out_of_step' END AS history_error FROM r",
    ),
)
def _(spark, sf_dir):
    return a.check_stage_history(_runs(spark, sf_dir)).select("execution_id", "history_error")
