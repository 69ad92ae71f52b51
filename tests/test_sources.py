import json

from pyspark.sql import functions as F

from gleanery.operators.context import materialize
from gleanery.operators.index import text_units, update_index
from gleanery.operators.scan import content_fingerprint
from gleanery.sources.files import read_files
from gleanery.sources.snapshots import read_latest_snapshot, read_snapshot, read_snapshots, write_snapshot
from gleanery.sources.suites import check_suite, read_documents, read_suite, report_markdown, suite_faults
from gleanery.streaming.incremental import current_units, follow_versions


def test_read_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.py").write_text("one")
    (tmp_path / "a" / "b" / "y.py").write_text("three")
    rows = {r.path: r for r in read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x.py", "a/b/y.py"} and rows["a/b/y.py"].size_bytes == 5 and bytes(rows["x.py"].content) == b"one"
    assert [r.path for r in read_files(spark, str(tmp_path), max_depth=1).collect()] == ["x.py"]


def test_snapshots(spark, tmp_path):
    for n in (1, 2):
        write_snapshot(spark.createDataFrame([("p", f"v{n}", n), *([("q", "only", 1)] if n == 1 else [])], "project_id string, value string, created_at int"), str(tmp_path), "files", f"s{n}")
    assert sorted(r.value for r in read_latest_snapshot(spark, str(tmp_path), "files").collect()) == ["only", "v2"]


def test_only_committed_and_newest_partitions_are_read(spark, tmp_path):
    root, schema = str(tmp_path), "project_id string, value string, created_at timestamp"
    import datetime

    at = lambda n: datetime.datetime(2026, 1, n)
    for n in (1, 2, 3):
        write_snapshot(spark.createDataFrame([(f"p{k}", f"v{n}", at(n)) for k in range(4) if n < 3 or k < 2], schema), root, "files", f"00{n}")
    # A write that failed before its log entry, and one that is repeated.
    half = spark.createDataFrame([("p3", "half", at(9))], schema).withColumns({"snapshot_id": F.lit("009"), "version": F.lit("x")})
    half.write.mode("append").partitionBy("project_id", "snapshot_id", "version").parquet(f"{root}/files")
    write_snapshot(spark.createDataFrame([("p2", "again", at(2))], schema), root, "files", "002")
    write_snapshot(spark.createDataFrame([], schema), root, "files", "010")
    latest = read_latest_snapshot(spark, root, "files")
    assert sorted((r.project_id, r.value) for r in latest.collect()) == [("p0", "v3"), ("p1", "v3"), ("p2", "again"), ("p3", "v2")]
    assert sorted(r.value for r in read_snapshot(spark, root, "files", "002").collect()) == ["again", "v2", "v2", "v2"]
    assert read_snapshots(spark, root, "files").count() == 10
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_read_suite(spark, tmp_path):
    case = {"case_id": "c1", "task_text": "t", "tags": ["x"], "context_budget": {"max_items": 3}, "judgments": [{"path": "a", "relevance": "required", "symbols": []}, {"path": "a", "relevance": "odd"}]}
    (tmp_path / "s.json").write_text(json.dumps({"suite_id": "s", "suite_version": "1", "cases": [case]}))
    cases, judgments = read_suite(spark, str(tmp_path / "s.json"))
    assert cases.first().context_budget.max_items == 3 and judgments.count() == 2
    assert sorted(r.code for r in check_suite(cases, judgments).collect()) == ["SUITE_DUPLICATE_JUDGMENT", "SUITE_UNKNOWN_LEVEL"]


def test_report_markdown(spark):
    a = spark.createDataFrame([("s", "ndcg", 2, 0.5)], "strategy_id string, metric_name string, cases long, mean double")
    f = spark.createDataFrame([("s", "ndcg", "below_minimum")], "strategy_id string, metric_name string, failure string")
    assert "| ndcg | 2 | 0.500000 |" in report_markdown(a, f).first().markdown
    d = spark.createDataFrame([("s", 7, "ndcg", -0.25), ("s", 8, "ndcg", 0.5)], "baseline_id string, case_id long, metric_name string, delta double")
    text = report_markdown(a, f, d).first().markdown
    assert text.endswith("Failures:\n\n- ndcg: below_minimum\n\nRegressions:\n\n- 7, ndcg: -0.250000")


def test_suite_files_with_faults(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"suite_id": "s", "suite_version": "1", "cases": [3], "more": null}')
    (tmp_path / "broken.json").write_text("{")
    out = suite_faults(read_documents(spark, str(tmp_path))).collect()
    assert sorted((r.file.rsplit("/", 1)[-1], r.code, r.subject) for r in out) == [("bad.json", "SUITE_UNEXPECTED_FIELD", "suite.more"), ("bad.json", "SUITE_WRONG_TYPE", "suite.cases[0]"), ("broken.json", "SUITE_MALFORMED", "suite")]


def test_text_units_and_spans(spark):
    text = "first\r\nsecond line\n\n" + "é" * 5
    contents = spark.createDataFrame([("p", "a.txt", text.encode()), ("p", "bad", b"\xff\xff")], "project_id string, path string, content binary")
    units = text_units(contents, max_unit_bytes=6).orderBy("ord").collect()
    assert [(r.start_line, r.start_column, r.end_column, r.text) for r in units] == [(1, 1, 5, "first"), (2, 1, 6, "second"), (2, 7, 11, " line"), (4, 1, 3, "ééé"), (4, 4, 5, "éé")]
    items = spark.createDataFrame([("p", "a.txt", r.start_line, r.start_column, r.end_line, r.end_column) for r in units], "project_id string, path string, start_line int, start_column int, end_line int, end_column int")
    held = materialize(items.join(contents.select("path", content_fingerprint(F.col("content")).alias("content_fingerprint")), "path"), contents)
    assert sorted(r.content for r in held.collect()) == sorted(r.text for r in units)


def test_incremental_equals_full(spark):
    a = spark.createDataFrame([("p", "a", "x\ny"), ("p", "b", "old"), ("p", "gone", "z")], "project_id string, path string, content string")
    b = spark.createDataFrame([("p", "a", "x\ny"), ("p", "b", "new\nlines"), ("p", "c", "w")], "project_id string, path string, content string")
    build = lambda df: text_units(df).select("project_id", "path", "ord", "text")
    keyed = lambda df: build(df).join(df.select("project_id", "path", content_fingerprint(F.col("content")).alias("content_fingerprint")), ["project_id", "path"])
    columns = ["project_id", "path", "ord", "text", "content_fingerprint"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(update_index(keyed(a), b, build)) == rows(keyed(b)) == rows(update_index(keyed(a), b, build, ("1", "2")))


def test_stream_of_versions(spark, tmp_path):
    schema = "project_id string, path string, content string, created_at long"
    versions = str(tmp_path / "in")
    for n in (1, 2):
        spark.createDataFrame([("p", "a", f"text {n}", n), *([("p", "b", "stays", 1)] if n == 1 else [])], schema).coalesce(1).write.mode("append").parquet(versions)
        follow_versions(spark.readStream.schema(schema).parquet(versions), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    units = read_snapshots(spark, str(tmp_path / "out"), "units")
    assert sorted(r.text for r in current_units(units).collect()) == ["stays", "text 2"]
