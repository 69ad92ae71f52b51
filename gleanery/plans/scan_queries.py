"""Queries on scanning and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan
from . import views
from .views import with_views

QUERIES, ORACLE_SQL = {}, {}
RULES = scan.compile_ignore_rules(
    mandatory=[".env.1*"], user_exclude=["docs/page_3*"], user_include=["build_7*/**"],
    project=["/config/", "tests/**/test_9*.py"],
    version_control=["# notes", "", "*.png", "!img_2*.png", "/src/legacy/"],
)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def classified(spark, sf_dir):
    return scan.artifact_fingerprint(scan.classify_artifacts(scan.sniff_content(scan.availability(views.artifacts(spark, sf_dir), 50_000))))


_RAW = "CASE doc_id % 7 WHEN 0 THEN '/' || path WHEN 1 THEN './' || replace(path, '/', '//') WHEN 2 THEN replace(path, '/', chr(92)) WHEN 3 THEN 'C:' || path WHEN 4 THEN 'x/../' || path WHEN 5 THEN './.' ELSE path END"


@query("normalize_paths", with_views(["artifacts"], f"""
r AS (SELECT doc_id, {_RAW} AS raw FROM artifacts),
s AS (SELECT *, list_filter(string_split(replace(raw, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM r),
e AS (SELECT *, CASE WHEN regexp_matches(raw, '^[/\\\\]') THEN 'absolute' WHEN regexp_matches(raw, '^[A-Za-z]:') THEN 'drive' WHEN
  list_contains(parts, '..') THEN 'parent_traversal' WHEN len(parts) = 0 THEN 'empty' END AS path_error FROM s)
SELECT doc_id, CASE WHEN path_error IS NULL THEN array_to_string(parts, '/') END AS canonical_path, path_error FROM e"""))
def _(spark, sf_dir):
    raw = F.expr(_RAW.replace("chr(92)", "char(92)"))
    return scan.normalize_paths(views.artifacts(spark, sf_dir).select("doc_id", raw.alias("path"))).select("doc_id", "canonical_path", "path_error")


# Rules in the order of strength; the first that matches decides, later version-control rules before earlier ones.
_IGNORE = """CASE
  WHEN regexp_matches(path, '^(.*/)?\\.env\\.1[^/]*(/|$)') THEN '.env.1*'
  WHEN regexp_matches(path, '^docs/page_3[^/]*$') THEN 'docs/page_3*'
  WHEN regexp_matches(path, '^build_7[^/]*(/[^/]+)*$') THEN '+build_7*/**'
  WHEN regexp_matches(path, '^tests/([^/]+/)*test_9[^/]*\\.py$') THEN 'tests/**/test_9*.py'
  WHEN regexp_matches(path, '^config/') THEN 'config'
  WHEN regexp_matches(path, '^src/legacy/') THEN 'src/legacy'
  WHEN regexp_matches(path, '^(.*/)?img_2[^/]*\\.png(/|$)') THEN '+img_2*.png'
  WHEN regexp_matches(path, '\\.png(/|$)') THEN '*.png'
  WHEN regexp_matches(path, '(^|/)dist/') THEN 'dist'
  WHEN regexp_matches(path, '(^|/)node_modules/') THEN 'node_modules' END"""
_IGNORED = f"i AS (SELECT doc_id, path, {_IGNORE} AS rule FROM artifacts), d AS (SELECT doc_id, path, CASE WHEN rule IS NULL OR starts_with(rule, '+') THEN 'include' ELSE 'exclude' END AS ignore_action, ltrim(rule, '+') AS ignore_pattern FROM i)"


@query("ignore_decision", with_views(["artifacts"], f"{_IGNORED} SELECT * FROM d"))
def _(spark, sf_dir):
    return scan.ignore_decision(views.artifacts(spark, sf_dir).select("doc_id", "path", "entry_type"), RULES).drop("entry_type")


@query("prune_ignored", with_views(["artifacts"], f"{_IGNORED} SELECT doc_id, path FROM d WHERE ignore_action = 'include'"))
def _(spark, sf_dir):
    return scan.prune_ignored(views.artifacts(spark, sf_dir).select("doc_id", "path", "entry_type"), RULES).select("doc_id", "path")


# The byte behind the sample continues a character.
_CUT = "strlen(content) > 8192 AND substr(hex(encode(content)), 16385, 1) IN ('8', '9', 'A', 'B')"


@query("sniff_content", with_views(["artifacts"], f"""
SELECT doc_id, {_CUT} AS binary_sample, CASE WHEN NOT ({_CUT}) AND strlen(content) > 0 THEN 'utf-8' END AS encoding, false AS generated_sample, false AS sensitive_sample FROM artifacts"""))
def _(spark, sf_dir):
    return scan.sniff_content(views.artifacts(spark, sf_dir)).select("doc_id", "binary_sample", "encoding", "generated_sample", "sensitive_sample")


@query("classify_artifacts", with_views(["artifacts"], f"""
s AS (SELECT doc_id, path, (doc_id // 20) % 10 AS p, size_bytes <= 50000 AND {_CUT} AS cut FROM artifacts),
k AS (SELECT *, CASE WHEN cut OR p = 5 THEN 'binary' ELSE ['source', 'documentation', 'test', 'configuration', 'generated',
  'binary', 'configuration', 'source', 'source', 'build'][(p + 1)::INT] END AS kind FROM s)
SELECT doc_id, path, kind,
  array_to_string(list_sort(list_distinct(list_filter([CASE WHEN kind = 'binary' THEN 'binary' END, CASE WHEN p = 4 THEN
  'generated' END, CASE WHEN p = 6 THEN 'sensitive' END, CASE WHEN kind IN ('test', 'source') THEN 'source' END,
    CASE WHEN kind = 'test' THEN 'test' END, CASE WHEN kind IN ('build', 'configuration') THEN 'configuration' END, CASE WHEN kind
  = 'documentation' THEN 'documentation' END], lambda x: x IS NOT NULL))), ',') AS classifications,
  CASE WHEN p IN (0, 2, 8) THEN 'python' WHEN p IN (4, 7) THEN 'javascript' END AS detected_language,
  array_to_string(list_sort(list_filter([CASE WHEN p <> 9 THEN 'extension:' || regexp_extract(path, '[.][^.]*$') END, CASE WHEN
  cut THEN 'bounded_sample:binary' WHEN p = 5 THEN 'extension:binary' END, CASE WHEN p = 4 THEN 'path:generated_pattern' END,
    CASE WHEN p = 6 THEN 'filename:sensitive_pattern' END, CASE kind WHEN 'test' THEN 'path:test_convention' WHEN 'build' THEN
  'filename:build' WHEN 'configuration' THEN 'filename:configuration' WHEN 'documentation' THEN 'path:documentation'
    WHEN 'source' THEN 'language:' || CASE WHEN p = 7 THEN 'javascript' ELSE 'python' END END], lambda x: x IS NOT NULL)), ',') AS evidence FROM k"""))
def _(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "doc_id", "path", "kind", F.array_join("classifications", ",").alias("classifications"), "detected_language",
        F.array_join("evidence", ",").alias("evidence"),
    )


@query(
    "availability",
    with_views(
        ["artifacts"],
        "SELECT doc_id, CASE WHEN content IS NULL THEN 'unreadable' WHEN size_bytes > 50000 THEN 'skipped' ELSE 'available' END AS availability FROM artifacts",
    ),
)
def _(spark, sf_dir):
    return scan.availability(views.artifacts(spark, sf_dir), 50_000).select("doc_id", "availability")


_FINGERPRINT = "'artifact_sha256_' || sha256('path=' || path || chr(10) || 'entry_type=file' || chr(10) || 'content=sha256:' || sha256(content) || chr(10) || 'modified_time_ns=ignored')"


@query(
    "artifact_fingerprint",
    with_views(["artifacts"], f"SELECT doc_id, 'sha256:' || sha256(content) AS content_fingerprint, {_FINGERPRINT} AS fingerprint FROM artifacts"),
)
def _(spark, sf_dir):
    return scan.artifact_fingerprint(views.artifacts(spark, sf_dir)).select("doc_id", "content_fingerprint", "fingerprint")


_PROJECTS = f"""
c AS (SELECT project_id, path, path || '|file|all|available|' || {_FINGERPRINT} AS v FROM artifacts),
b AS (SELECT project_id, substr(sha256(path), 1, 3) AS k, list(v ORDER BY path, v) AS vs FROM c GROUP BY 1, 2),
h AS (SELECT project_id, k,
  sha256('{{"fingerprint_schema":"v1","fingerprint_type":"block","line_endings":"lf","ordering":"ordered","values":["' ||
  array_to_string(vs, '","') || '"]}}') AS v FROM b),
g AS (SELECT project_id, list(v ORDER BY k, v) AS vs FROM h GROUP BY project_id)
SELECT project_id, 'project_sha256_' || sha256('{{"fingerprint_schema":"v1","fingerprint_type":"project","line_endings":"lf","ordering":"ordered","values":["' || array_to_string(vs, '","') || '"]}}') AS project_fingerprint FROM g"""


def _components(rows):
    return scan.artifact_fingerprint(rows).withColumns(
        {"kind": F.lit("file"), "classifications": F.array(F.lit("all")), "availability": F.lit("available")}
    )


@query("project_fingerprint", with_views(["artifacts"], _PROJECTS))
def _(spark, sf_dir):
    return scan.project_fingerprint(_components(views.artifacts(spark, sf_dir)))


@query("updated_project_fingerprint", with_views(["snapshot_current"], _PROJECTS.replace("FROM artifacts", "FROM snapshot_current")))
def _(spark, sf_dir):
    """The current fingerprint from the block digests of the version before and the files that changed."""
    before, now = (_components(views.snapshot(spark, sf_dir, w)).withColumn("scanner_version", F.lit(views.SCANNER)) for w in ("previous", "current"))
    blocks = scan.update_block_digests(scan.block_digests(before), now, scan.diff_snapshots(before, now))
    return scan.combined_fingerprint(blocks)


@query("scan_statistics", with_views(["artifacts"], f"""{_IGNORED},
a AS (SELECT project_id, size_bytes, ignore_action = 'include' AS inc, content IS NULL AS unreadable, content IS NOT NULL AND
  size_bytes > 50000 AS skipped FROM artifacts JOIN d USING (doc_id)),
g AS (SELECT project_id, count(*) AS discovered, count(*) FILTER (WHERE inc) AS included, count(*) FILTER (WHERE NOT inc) AS
  excluded, count(*) FILTER (WHERE inc AND skipped) AS unsupported,
      count(*) FILTER (WHERE inc AND unreadable) AS unreadable, coalesce(sum(size_bytes) FILTER (WHERE inc), 0)::BIGINT AS bytes,
  0::BIGINT AS reused FROM a GROUP BY project_id)
SELECT *, CASE WHEN included = 0 THEN 'failed' WHEN unreadable > 0 THEN 'incomplete' WHEN unsupported > 0 THEN 'complete_with_warnings' ELSE 'complete' END AS status FROM g"""))
def _(spark, sf_dir):
    return scan.scan_statistics(scan.ignore_decision(scan.availability(views.artifacts(spark, sf_dir), 50_000), RULES))


@query("diff_snapshots", with_views(["snapshot_previous", "snapshot_current"], """
SELECT coalesce(p.project_id, c.project_id) AS project_id, coalesce(p.path, c.path) AS path,
       CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN p.content = c.content THEN 'reused' ELSE 'changed' END AS change
FROM snapshot_previous p FULL JOIN snapshot_current c ON p.project_id = c.project_id AND p.path = c.path"""))
def _(spark, sf_dir):
    before, now = (
        scan.artifact_fingerprint(views.snapshot(spark, sf_dir, w)).withColumn(
            "scanner_version", F.lit(views.SCANNER),
        ) for w in ("previous", "current")
    )
    return scan.diff_snapshots(before, now)
