"""Queries on reports, packets and suites made of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.shared import new_folder
from ..operators import evaluation as e
from ..sources import suites
from ..sources.files import read_files
from ..sources.snapshots import read_latest_snapshot, write_snapshot
from . import views
from .evaluation_queries import _METRICS, JUDGED, _metrics
from .views import with_views

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("context_packets", with_views(["search_units"], """
i AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit_id) AS ord, text FROM search_units)
SELECT doc_id AS task_id, count(*) AS item_count, sum(strlen(text))::BIGINT AS byte_count, sha256(string_agg(text, '|' ORDER BY ord)) AS contents_sha256 FROM i GROUP BY 1"""))
def _(spark, sf_dir):
    """All lines of each document as the items of one bundle."""
    units = views.search_units(spark, sf_dir).withColumn("bundle_id", F.col("doc_id"))
    items = units.select(
        "bundle_id", F.row_number().over(Window.partitionBy("bundle_id").orderBy("unit_id")).alias("ord"), "path",
        F.lit("lexical_content_match").alias("reason"), F.lit(1.0).alias("score"), F.col("text").alias("content"),
    )
    packets = suites.context_packets(items.select(F.col("bundle_id").alias("task_id"), "bundle_id").distinct(), items)
    read = F.from_json("packet", "struct<item_count:bigint,byte_count:bigint,items:array<struct<ord:int,content:string>>>")
    rows = packets.select("task_id", read.alias("p"))
    return rows.select(
        "task_id", "p.item_count", "p.byte_count",
        F.sha2(F.array_join(F.transform("p.items", lambda i: i["content"]), "|"), 256).alias("contents_sha256"),
    )


@query(
    "read_files",
    "SELECT source AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS size_bytes, sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS line_ends FROM documents GROUP BY 1",
)
def _(spark, sf_dir):
    """The documents as text files below a folder for each source, read back as a file tree."""
    root = new_folder(spark)
    views.table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").text(root)
    files = read_files(spark, root).filter(F.col("path").startswith("source="))
    text = F.col("content").cast("string")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return files.groupBy(F.regexp_extract("path", "^source=([^/]*)/", 1).alias("folder")).agg(
        F.sum("size_bytes").alias("size_bytes"), F.sum(ends.cast("long")).alias("line_ends"),
    )


@query("read_latest_snapshot", with_views(["snapshot_previous", "snapshot_current"], """
l AS (SELECT project_id, path, 'current' AS snapshot_id, content FROM snapshot_current UNION ALL SELECT project_id, path,
  'previous', content FROM snapshot_previous WHERE project_id NOT IN (SELECT project_id FROM snapshot_current))
SELECT project_id, path, snapshot_id, sha256(content) AS digest FROM l"""))
def _(spark, sf_dir):
    """Both versions of the artifacts written as snapshots; the newest of each project is read back."""
    root = new_folder(spark)
    for at, which in enumerate(("previous", "current")):
        rows = views.snapshot(spark, sf_dir, which).select(
            "project_id", "path", F.sha2("content", 256).alias("digest"), F.lit(at).alias("created_at"),
        )
        write_snapshot(rows, root, "inventory", which)
    return read_latest_snapshot(spark, root, "inventory").select("project_id", "path", "snapshot_id", "digest")


@query(
    "read_suite",
    with_views(["judgments"], "SELECT 's' || (case_id // 100) AS suite_id, 'c' || case_id AS case_id, path, relevance FROM judgments"),
)
def _(spark, sf_dir):
    """The judgments as JSON suites of up to a hundred cases, a file each, read back by the reader of suites."""
    root = new_folder(spark)
    judgments = views.judgments(spark, sf_dir)
    listed = judgments.groupBy("case_id").agg(
        F.collect_list(F.struct("path", "relevance", F.array().cast("array<string>").alias("symbols"))).alias("judgments")
    )
    case = F.struct(
        F.concat(F.lit("c"), "case_id").alias("case_id"), F.lit("Explain").alias("task_text"),
        F.array(F.lit("made")).alias("tags"), "judgments",
    )
    suite = F.concat(F.lit("s"), F.expr("case_id div 100"))
    made = listed.groupBy(suite.alias("suite_id")).agg(F.lit("1").alias("suite_version"), F.collect_list(case).alias("cases"))
    made.withColumn("folder", F.col("suite_id")).write.partitionBy("folder").json(root)
    cases, judged = suites.read_suite(spark, root)
    return cases.select("suite_id", "case_id").join(judged, "case_id").select("suite_id", "case_id", "path", "relevance")


@query("evaluation_report", with_views(JUDGED, f"""{_METRICS}, ag AS (SELECT strategy_id, count(DISTINCT metric_name) AS metrics FROM mt GROUP BY 1),
dl AS (SELECT b.strategy_id, count(*) AS regressions FROM mt b JOIN mt p USING (case_id, metric_name) WHERE p.strategy_id =
  'primary' AND b.strategy_id <> 'primary' AND p.value < b.value - 1e-12 GROUP BY 1)
SELECT strategy_id, metrics, coalesce(regressions, 0) AS regressions, coalesce(deltas, 0) AS deltas, cases, 'core' AS suite FROM ag LEFT JOIN dl USING (strategy_id)
LEFT JOIN (SELECT b.strategy_id, count(*) AS deltas FROM mt b JOIN mt p USING (case_id, metric_name) WHERE p.strategy_id = 'primary' AND b.strategy_id <> 'primary' GROUP BY 1) USING (strategy_id)
JOIN (SELECT strategy_id, count(DISTINCT case_id) AS cases FROM mt GROUP BY 1) USING (strategy_id)"""))
def _(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    aggregates = e.aggregate_metrics(metrics)
    report = suites.evaluation_report(
        aggregates, e.baseline_deltas(metrics, "primary"),
        aggregates.select("strategy_id", "metric_name", F.lit("missing").alias("failure")).limit(0), metrics, {"suite": "core"},
    )
    size = lambda path: F.coalesce(
        F.size(F.from_json(F.get_json_object("document", path), "array<struct<metric_name:string>>")), F.lit(0),
    ).cast("long")
    return report.select(
        "strategy_id", size("$.aggregates").alias("metrics"), size("$.regressions").alias("regressions"), size("$.deltas").alias("deltas"),
        size("$.cases").alias("cases"), F.get_json_object("document", "$.metadata.suite").alias("suite"),
    )


_FLAWS = [
    "", '"extra":1,', '"task_kind":"dance",', '"tags":["a",1],', '"judgments":[{"path":"p","relevance":"maybe","symbols":[],"note":0},{"path":3}],',
    '"context_budget":{"max_items":null,"max_bytes":2.5,"most":1},', '"context_budget":[],', '"case_id":7,',
]
_CASE = {
    "case_id": '"c"', "context_budget": "{}", "expected_changed_paths": "[]", "expected_evidence": "[]", "fixture_fingerprint": '"f"', "fixture_project_id": '"p"', "judgments": "[]",
    "requested_output": f'"{suites.OUTPUTS[0]}"', "tags": "[]", "task_kind": '"explain"', "task_text": '"t"',
}


@query("suite_faults", """WITH f AS (SELECT o_orderkey AS file, o_orderkey % 10 AS m FROM orders)
SELECT file, code, subject FROM f JOIN (VALUES (1, 'SUITE_UNEXPECTED_FIELD', 'suite.cases[0].extra'), (2, 'SUITE_UNKNOWN_VALUE', 'suite.cases[0].task_kind'),
  (3, 'SUITE_WRONG_TYPE', 'suite.cases[0].tags'), (4, 'SUITE_UNKNOWN_VALUE', 'suite.cases[0].judgments[0].relevance'),
  (4, 'SUITE_UNEXPECTED_FIELD', 'suite.cases[0].judgments[0].note'), (4, 'SUITE_WRONG_TYPE', 'suite.cases[0].judgments[1].path'),
  (4, 'SUITE_MISSING_FIELD', 'suite.cases[0].judgments[1].relevance'), (4, 'SUITE_MISSING_FIELD', 'suite.cases[0].judgments[1].symbols'),
  (5, 'SUITE_WRONG_TYPE', 'suite.cases[0].context_budget.max_bytes'), (5, 'SUITE_UNEXPECTED_FIELD', 'suite.cases[0].context_budget.most'),
  (6, 'SUITE_WRONG_TYPE', 'suite.cases[0].context_budget'), (7, 'SUITE_WRONG_TYPE', 'suite.cases[0].case_id'), (8, 'SUITE_MALFORMED', 'suite'),
  (9, 'SUITE_MISSING_FIELD', 'suite.suite_version'), (9, 'SUITE_WRONG_TYPE', 'suite.cases')) v(m, code, subject) USING (m)""")
def _(spark, sf_dir):
    """Orders as suites of one case, most with a flaw."""
    k = F.col("o_orderkey")

    def case(flaw: str) -> str:
        own = flaw.split('"')[1] if flaw else ""
        return "{" + flaw + ",".join(f'"{n}":{v}' for n, v in _CASE.items() if n != own) + "}"

    texts = [f'{{"suite_id":"s","suite_version":"1","cases":[{case(flaw)}]}}' for flaw in _FLAWS] + ['{"suite_id":"s","suite_id":"s"}', '{"suite_id":"s","cases":{}}']
    text = F.get(F.array(*map(F.lit, texts)), (k % 10).cast("int"))
    return suites.suite_faults(views.table(spark, sf_dir, "orders").select(k.alias("file"), text.alias("text")))


@query("check_suite", """
WITH c AS (SELECT 'c' || (o_orderkey % 9973) AS case_id FROM orders), j AS (SELECT 'c' || (l_orderkey % 500) AS case_id, 'f' ||
  (l_partkey % 700) AS path, CASE WHEN l_partkey % 97 = 0 THEN 'maybe' ELSE 'required' END AS relevance FROM lineitem)
SELECT 'SUITE_DUPLICATE_CASE' AS code, case_id AS subject FROM c GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'SUITE_DUPLICATE_JUDGMENT', case_id || ':' || path FROM j GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'SUITE_UNKNOWN_LEVEL', case_id || ':' || path FROM j WHERE relevance = 'maybe'""")
def _(spark, sf_dir):
    cases = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey") % 9973).alias("case_id"))
    judgments = views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_orderkey") % 500).alias("case_id"),
        F.concat(F.lit("f"), F.col("l_partkey") % 700).alias("path"),
        F.when(F.col("l_partkey") % 97 == 0, "maybe").otherwise("required").alias("relevance"),
    )
    return suites.check_suite(cases, judgments)
