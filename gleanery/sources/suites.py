"""Evaluation suites as JSON, and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUDGET = "struct<max_estimated_tokens:int,max_characters:int,max_bytes:int,max_artifacts:int,max_excerpts:int,max_item_bytes:int,max_items:int>"
CASE = f"struct<case_id:string,fixture_project_id:string,fixture_fingerprint:string,task_text:string,task_kind:string,requested_output:string,tags:array<string>,expected_evidence:array<string>,expected_changed_paths:array<string>,context_budget:{BUDGET},judgments:array<struct<path:string,relevance:string,symbols:array<string>>>>"
SUITE = f"suite_id string, suite_version string, cases array<{CASE}>"
LEVELS = ["required", "supporting", "irrelevant"]
# Kinds of tasks and of requested outputs.
TASK_KINDS = ["analyze", "explain", "modify", "fix", "refactor", "add", "remove", "test", "document", "unknown"]
OUTPUTS = ["analysis", "patch_proposal", "test_plan", "documentation", "structured_diagnostic"]
#: What each level of a suite must hold; a list names the values a string may have, a question mark what may be missing.
SUITE_FIELDS = {"suite_id": "string", "suite_version": "string", "cases": "array"}
CASE_FIELDS = {
    "case_id": "string", "context_budget": "object", "expected_changed_paths": "strings", "expected_evidence": "strings",
    "fixture_fingerprint": "string", "fixture_project_id": "string", "judgments": "array", "requested_output": OUTPUTS, "tags": "strings",
    "task_kind": TASK_KINDS, "task_text": "string",
}
JUDGMENT_FIELDS = {"path": "string", "relevance": LEVELS, "symbols": "strings"}
BUDGET_FIELDS = {
    f"max_{name}": "integer?" for name in ("estimated_tokens", "characters", "bytes", "artifacts", "excerpts", "item_bytes", "items")
}


def read_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases (with a budget each) and judgments (case_id, path, relevance, symbols) of JSON suites; malformed files fail."""
    raw = spark.read.schema(SUITE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    cases = raw.select("suite_id", "suite_version", F.explode("cases").alias("c")).select("suite_id", "suite_version", "c.*")
    judgments = cases.select("case_id", F.explode("judgments").alias("j")).select("case_id", "j.*")
    return cases.drop("judgments"), judgments


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of JSON files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def _kind(value: Column) -> Column:
    """string, array, object, null, integer or other: what a variant holds."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), "null").when(name == "STRING", "string").when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object").when(name == "BIGINT", "integer").otherwise("other")
    )


def _faults(nodes: DataFrame, fields: dict[str, str | list[str]]) -> DataFrame:
    """(file, code, subject) of nodes (file, at, v): fields that are missing, not expected, of a wrong type, or of an unknown value."""
    held = nodes.withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))
    object_ = F.col("m").isNotNull()
    keys = F.coalesce(F.map_keys("m"), F.array().cast("array<string>"))
    names = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
    at = lambda code, name: F.struct(F.lit(code).alias("code"), F.concat("at", F.lit("."), name).alias("subject"))
    required = [n for n, kind in fields.items() if kind != "integer?"]
    lists = [
        F.when(object_, F.transform(F.array_except(names(required), keys), lambda n: at("SUITE_MISSING_FIELD", n))),
        F.transform(F.array_except(keys, names(fields)), lambda n: at("SUITE_UNEXPECTED_FIELD", n)),
        F.when(~object_, F.array(F.struct(F.lit("SUITE_WRONG_TYPE").alias("code"), F.col("at").alias("subject")))),
    ]
    for name, kind in fields.items():
        value = F.try_element_at("m", F.lit(name))
        found, known = _kind(value), F.array_contains(keys, name)
        texts = F.try_variant_get(value, "$", "array<variant>")
        right = {
            "strings": (found == "array") & F.forall(F.coalesce(texts, F.array().cast("array<variant>")), lambda t: _kind(t) == "string"), "integer?": found.isin("integer", "null"),
        }.get(kind if isinstance(kind, str) else "", found == (kind if isinstance(kind, str) else "string"))
        lists.append(F.when(object_ & known & ~right, F.array(at("SUITE_WRONG_TYPE", F.lit(name)))))
        if isinstance(kind, list):
            odd = (found == "string") & ~F.try_variant_get(value, "$", "string").isin(kind)
            lists.append(F.when(object_ & odd, F.array(at("SUITE_UNKNOWN_VALUE", F.lit(name)))))
    empty = F.array().cast("array<struct<code:string,subject:string>>")
    return held.select("file", F.explode(F.concat(*(F.coalesce(one, empty) for one in lists))).alias("f")).select("file", "f.*")


def suite_faults(documents: DataFrame) -> DataFrame:
    """(file, code, subject) of JSON suites (file, text) that differ from the schema, at every level.

    Codes: SUITE_MALFORMED (no JSON, or a key twice in an object), SUITE_MISSING_FIELD, SUITE_UNEXPECTED_FIELD,
    SUITE_WRONG_TYPE, SUITE_UNKNOWN_VALUE. Subjects are places like ``suite.cases[0].judgments[2].path``. Documents are read as
    variants, so nothing that a fixed schema would drop passes in silence. Limits of a budget may be missing or null.
    """
    whole = documents.select("file", F.lit("suite").alias("at"), F.try_parse_json("text").alias("v"))
    broken = whole.filter("v is null").select("file", F.lit("SUITE_MALFORMED").alias("code"), F.col("at").alias("subject"))
    suites = whole.filter("v is not null")

    def below(nodes: DataFrame, field: str) -> DataFrame:
        items = F.posexplode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("n", "item")
        return nodes.select("file", "at", items).select("file", F.concat("at", F.lit(f".{field}["), "n", F.lit("]")).alias("at"), F.col("item").alias("v"))

    cases = below(suites, "cases")
    budgets = cases.select("file", F.concat("at", F.lit(".context_budget")).alias("at"), F.try_variant_get("v", "$.context_budget", "variant").alias("v"))
    budgets = budgets.filter(_kind(F.col("v")) == "object")
    levels = [(suites, SUITE_FIELDS), (cases, CASE_FIELDS), (below(cases, "judgments"), JUDGMENT_FIELDS), (budgets, BUDGET_FIELDS)]
    out = broken
    for nodes, fields in levels:
        out = out.unionByName(_faults(nodes, fields))
    return out


def check_suite(cases: DataFrame, judgments: DataFrame) -> DataFrame:
    """(code, subject) of repeated cases, paths judged twice in a case, and unknown levels."""
    twice = cases.groupBy("case_id").count().filter("count > 1").select(
        F.lit("SUITE_DUPLICATE_CASE").alias("code"), F.col("case_id").alias("subject"),
    )
    again = judgments.groupBy("case_id", "path").count().filter("count > 1").select(
        F.lit("SUITE_DUPLICATE_JUDGMENT").alias("code"), F.concat_ws(":", "case_id", "path").alias("subject"),
    )
    level = judgments.filter(~F.col("relevance").isin(LEVELS)).select(
        F.lit("SUITE_UNKNOWN_LEVEL").alias("code"), F.concat_ws(":", "case_id", "path").alias("subject"),
    )
    return twice.unionByName(again).unionByName(level)


def evaluation_report(
    aggregates: DataFrame, deltas: DataFrame, failures: DataFrame, metrics: DataFrame | None = None, metadata: dict[str, str] | None = None,
) -> DataFrame:
    """(strategy_id, document): the result of each strategy as JSON.

    The document holds metadata, aggregates, all deltas of the primary strategy against this one, regressions (those
    below 0), failures, and the metrics of each case. ``deltas`` has baseline_id, case_id, metric_name, delta; ``failures``
    strategy_id, metric_name, failure; ``metrics`` strategy_id, case_id, metric_name, value.
    """

    def listed(df: DataFrame, key: str, item, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("strategy_id")).agg(F.array_sort(F.collect_list(item)).alias(name))

    change = F.struct("case_id", "metric_name", F.round("delta", 6).alias("delta"))
    parts = [
        listed(deltas, "baseline_id", change, "deltas"), listed(deltas.filter(F.round("delta", 12) < 0), "baseline_id", change, "regressions"),
        listed(failures, "strategy_id", F.struct("metric_name", "failure"), "failures"),
    ]
    names = ["aggregates", "deltas", "regressions", "failures"]
    if metrics is not None:
        value = F.struct("metric_name", F.round("value", 6).alias("value"))
        each = metrics.groupBy("strategy_id", "case_id").agg(F.array_sort(F.collect_list(value)).alias("metrics"))
        parts.append(listed(each, "strategy_id", F.struct("case_id", "metrics"), "cases"))
        names.append("cases")
    rows = listed(aggregates, "strategy_id", F.struct("metric_name", "cases", F.round("mean", 6).alias("mean")), "aggregates")
    for part in parts:
        rows = rows.join(part, "strategy_id", "left")
    if metadata:
        rows = rows.withColumn("metadata", F.create_map(*(F.lit(x) for pair in sorted(metadata.items()) for x in pair)))
        names.insert(0, "metadata")
    return rows.select("strategy_id", F.to_json(F.struct("strategy_id", *names)).alias("document"))


def report_markdown(aggregates: DataFrame, failures: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """(strategy_id, markdown) with a table of means, a list of failures, and one of regressions (``deltas`` below 0)."""
    line = F.format_string("| %s | %d | %.6f |", "metric_name", "cases", "mean")
    rows = aggregates.groupBy("strategy_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))

    def with_list(rows: DataFrame, df: DataFrame, key: str, item, name: str) -> DataFrame:
        found = df.groupBy(F.col(key).alias("strategy_id")).agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias(name))
        return rows.join(found, "strategy_id", "left").withColumn(name, F.coalesce(F.concat(F.lit(f"\n\n{name}:\n\n"), name), F.lit("")))

    rows = with_list(rows, failures, "strategy_id", F.format_string("- %s: %s", "metric_name", "failure"), "Failures")
    text = [F.lit("## "), "strategy_id", F.lit("\n\n| metric | cases | mean |\n| --- | --- | --- |\n"), "t", "Failures"]
    if deltas is not None:
        worse = deltas.filter(F.round("delta", 12) < 0)
        rows = with_list(rows, worse, "baseline_id", F.format_string("- %s, %s: %.6f", F.col("case_id").cast("string"), "metric_name", "delta"), "Regressions")
        text.append("Regressions")
    return rows.select("strategy_id", F.concat(*text).alias("markdown"))


def context_packets(bundles: DataFrame, items: DataFrame) -> DataFrame:
    """(task_id, packet): a bundle's items in their order with content, score and reason, and totals, as JSON.

    ``bundles`` (task_id, bundle_id), ``items`` (bundle_id, ord, path, reason, score, content).
    """
    entry = F.struct("ord", "path", "reason", "score", "content")
    packed = items.groupBy("bundle_id").agg(
        F.array_sort(F.collect_list(entry)).alias("items"), F.count(F.lit(1)).alias("item_count"),
        F.sum(F.octet_length("content")).alias("byte_count"),
    )
    rows = bundles.join(packed, "bundle_id", "left")
    return rows.select("task_id", F.to_json(F.struct("task_id", "bundle_id", "item_count", "byte_count", "items")).alias("packet"))
