"""Views over the given tables that the registered queries start from, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.search import containing
from ..functions.sets import spread
from ..functions.shared import written
from ..functions.text import fold

#: A path for every document, by (doc_id div 20) mod 10; {} is the id.
PATHS = [
    "src/mod_{}.py", "docs/page_{}.md", "tests/test_{}.py", "config/app_{}.toml", "dist/bundle_{}.min.js", "assets/img_{}.png",
    ".env.{}", "node_modules/p/{}.js", "src/legacy/archive_{}.py", "build_{}/Makefile",
]
SCANNER = "scan-1"
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, project_id, path, entry_type, content (text), size_bytes."""
    docs = table(spark, sf_dir, "documents")
    path = F.get(
        F.array(*(F.concat(F.lit(p.split("{}")[0]), F.col("doc_id"), F.lit(p.split("{}")[1])) for p in PATHS)),
        F.expr("int((doc_id div 20) % 10)"),
    )
    return docs.select(
        "doc_id", F.col("source").alias("project_id"), path.alias("path"), F.lit("file").alias("entry_type"),
        F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"),
    )


def search_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the artifacts: project_id, path, unit_id, line, ord, text."""
    rows = artifacts(spark, sf_dir).select(
        "doc_id", "project_id", "path", F.posexplode(F.split("content", "\n")).alias("n", "text"),
    ).filter("text <> ''")
    return rows.select(
        "doc_id", "project_id", "path", F.format_string("u%08d-%06d", "doc_id", F.col("n") + 1).alias("unit_id"),
        (F.col("n") + 1).alias("line"), "text",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, task_text, keywords: the distinct words of at least seven letters of a benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{7,}"), F.lit(0)))
    rows = items.select(F.col("item_id").alias("task_id"), words.alias("w"))
    return rows.select(
        "task_id", F.concat(F.lit("Explain "), F.array_join("w", " ")).alias("task_text"),
        F.array_distinct(F.transform("w", fold)).alias("keywords"),
    )


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, path, relevance of the documents that an item judges: required are those that hold its whole text."""
    docs = artifacts(spark, sf_dir).select("doc_id", "path", "content")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("phrase"))
    met = containing(docs.select(F.col("doc_id").alias("id"), F.col("content").alias("text")), items).withColumnRenamed("id", "doc_id")
    found = written(
        met.join(items, "phrase").join(docs.select("doc_id", "path"), "doc_id").select("case_id", "path", F.lit("required").alias("relevance"))
    )
    labels = docs.select("doc_id", "path").join(table(spark, sf_dir, "labels"), "doc_id")
    level = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "irrelevant").otherwise("supporting")
    cases = found.select("case_id").distinct()
    spread = labels.join(cases, F.col("doc_id") % 50 == F.col("case_id") % 50).select("case_id", "path", level.alias("relevance"))
    return found.unionByName(spread.join(found.select("case_id", "path"), ["case_id", "path"], "left_anti"))


def edges_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relationship_id, source_reference, target_reference, kind of the links between pages."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n", "target"),
    )
    return pages.select(
        F.format_string("r%08d-%04d", "page_id", "n").alias("relationship_id"),
        F.regexp_extract("url", r"://[^/]*([^?#]*)", 1).alias("source_reference"),
        F.col("target").alias("target_reference"), F.lit("references").alias("kind"),
        F.lit("resolved_internal").alias("resolution"),
    )


def edges_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers depend on orders, orders import parts, parts configure suppliers."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    def link(df, kind, a, ac, b, bc):
        return df.select(
            F.concat(F.lit(f"{a}:"), ac).alias("source_reference"),
            F.concat(F.lit(f"{b}:"), bc).alias("target_reference"), F.lit(kind).alias("kind"),
        ).distinct()
    rows = link(orders, "depends_on", "c", "o_custkey", "o", "o_orderkey")
    rows = rows.unionByName(link(items, "imports", "o", "l_orderkey", "p", "l_partkey")).unionByName(
        link(items, "configures", "p", "l_partkey", "s", "l_suppkey")
    )
    return rows.select(
        F.concat_ws(">", "source_reference", "target_reference").alias("relationship_id"), "*",
        F.lit("resolved_internal").alias("resolution"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: symbol_id, name, qualified_name, kind, artifact_id."""
    part = table(spark, sf_dir, "part")
    plain = lambda c: F.regexp_replace(c, "[ #]", "_")
    return part.select(
        F.concat(F.lit("sym"), "p_partkey").alias("symbol_id"), plain("p_name").alias("name"),
        F.concat_ws(".", plain("p_brand"), plain("p_type"), plain("p_name")).alias("qualified_name"),
        F.lit("function").alias("kind"), F.concat(F.lit("a"), F.col("p_partkey") % 97).alias("artifact_id"),
    )


def snapshot(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Two versions of the artifacts, ``previous`` and ``current``."""
    rows = artifacts(spark, sf_dir)
    if which == "current":
        return rows.filter("doc_id % 11 <> 0")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit(" v0"))).otherwise(F.col("content"))
    return rows.filter("doc_id % 10 <> 0").withColumn("content", changed)


def proposed_changes(spark: SparkSession, sf_dir: str, dense: bool = True) -> DataFrame:
    """Orders as changes: proposal_id, change_id, operation, path, destination_path."""
    orders = table(spark, sf_dir, "orders")
    file = lambda n: F.concat(F.lit("src/f_"), n % 50, F.lit(".py"))
    op = F.get(F.array(*(F.lit(x) for x in ("create", "modify", "delete", "rename"))), (F.col("o_orderkey") % 4).cast("int"))
    proposal = F.col("o_custkey") % 20 if dense else F.col("o_custkey")
    return orders.select(
        proposal.alias("proposal_id"), F.col("o_orderkey").alias("change_id"), op.alias("operation"),
        file(F.col("o_orderkey")).alias("path"),
        F.when(op == "rename", file(F.col("o_orderkey") * 7)).alias("destination_path"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("execution_id"), F.concat(F.lit("p"), F.col("user_id") % 10).alias("project_id"),
        F.col("user_id").alias("task_id"), F.col("event_type").alias("stage"), F.col("ts").alias("saved_at"), "value",
    )


# ---------------------------------------------------------------------------------------------------------------
# The same in SQL.
_PATH_CASES = " ".join(f"WHEN {n} THEN '{p.split('{}')[0]}' || doc_id || '{p.split('{}')[1]}'" for n, p in enumerate(PATHS))
FOLD = "replace(lower({0}), 'ß', 'ss')"
VIEW_SQL = {
    "artifacts": f"SELECT doc_id, source AS project_id, CASE (doc_id // 20) % 10 {_PATH_CASES} END AS path, 'file' AS entry_type, text AS content, strlen(text)::BIGINT AS size_bytes FROM documents",
    "search_units": """SELECT doc_id, project_id, path, printf('u%08d-%06d', doc_id, n + 1) AS unit_id, n + 1 AS line, text
      FROM (SELECT doc_id, project_id, path, unnest(range(len(l))) AS n, unnest(l) AS text FROM (SELECT *, string_split(content, chr(10)) AS l FROM artifacts)) WHERE text <> ''""",
    "tasks": f"""SELECT item_id AS task_id, 'Explain ' || array_to_string(w, ' ') AS task_text, k AS keywords FROM (
      SELECT item_id, w, list_reduce_distinct AS k FROM (SELECT item_id, w, list_transform(w, lambda x: {FOLD.format('x')}) AS
  list_reduce_distinct FROM (
        SELECT item_id, list_transform(list_filter(list_transform(a, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position(a,
  s.x) = s.i), lambda s: s.x) AS w
        FROM (SELECT item_id, regexp_extract_all(text, '\\p{{L}}{{7,}}') AS a FROM benchmark))))""",
    "judgments": """WITH f AS (SELECT item_id AS case_id, path FROM artifacts JOIN benchmark ON contains(content, text)),
      s AS (SELECT DISTINCT c.case_id, a.path, CASE WHEN toxic = 1 OR quality = 0 THEN 'irrelevant' ELSE 'supporting' END AS relevance
            FROM labels l JOIN artifacts a USING (doc_id) JOIN (SELECT DISTINCT case_id FROM f) c ON l.doc_id % 50 = c.case_id % 50)
      SELECT case_id, path, 'required' AS relevance FROM f UNION ALL SELECT * FROM s WHERE (case_id, path) NOT IN (SELECT case_id, path FROM f)""",
    "edges_pages": """SELECT printf('r%08d-%04d', page_id, n) AS relationship_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS source_reference, target AS target_reference, 'references' AS kind, 'resolved_internal' AS resolution
      FROM (SELECT page_id, url, unnest(range(len(t))) AS n, unnest(t) AS target FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS t FROM pages))""",
    "edges_orders": """SELECT source_reference || '>' || target_reference AS relationship_id, *, 'resolved_internal' AS resolution FROM (
      SELECT DISTINCT 'c:' || o_custkey AS source_reference, 'o:' || o_orderkey AS target_reference, 'depends_on' AS kind FROM orders
      UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'imports' FROM lineitem UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'configures' FROM lineitem)""",
    "symbols": """SELECT 'sym' || p_partkey AS symbol_id, regexp_replace(p_name, '[ #]', '_', 'g') AS name,
      regexp_replace(p_brand, '[ #]', '_', 'g') || '.' || regexp_replace(p_type, '[ #]', '_', 'g') || '.' || regexp_replace(p_name, '[ #]', '_', 'g') AS qualified_name, 'function' AS kind, 'a' || (p_partkey % 97) AS artifact_id FROM part""",
    "snapshot_previous": "SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN content || ' v0' ELSE content END AS content) FROM artifacts WHERE doc_id % 10 <> 0",
    "snapshot_current": "SELECT * FROM artifacts WHERE doc_id % 11 <> 0",
    "proposed_changes": """SELECT o_custkey % 20 AS proposal_id, o_orderkey AS change_id, ['create', 'modify', 'delete', 'rename'][(o_orderkey % 4 + 1)::INT] AS operation,
      'src/f_' || (o_orderkey % 50) || '.py' AS path, CASE WHEN o_orderkey % 4 = 3 THEN 'src/f_' || (o_orderkey * 7 % 50) || '.py' END AS destination_path FROM orders""",
    "executions": "SELECT event_id AS execution_id, 'p' || (user_id % 10) AS project_id, user_id AS task_id, event_type AS stage, ts AS saved_at, value FROM events",
}
NEEDS = {"search_units": ["artifacts"], "judgments": ["artifacts"], "snapshot_previous": ["artifacts"], "snapshot_current": ["artifacts"]}


def with_views(names: Iterable[str], body: str) -> str:
    """``body`` (it may begin with further named queries, as ``name AS (...), ... SELECT``) after the SQL of the views."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in wanted) + (
        "\n" if body.lstrip().upper().startswith("SELECT") else ",\n"
    ) + body.strip()
