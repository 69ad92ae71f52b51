import pytest

from gleanery.operators import scan


def decide(spark, rules, paths, allow=True):
    rows = spark.createDataFrame([(p.rstrip("/"), "directory" if p.endswith("/") else "file") for p in paths], "path string, entry_type string")
    return {r.path: r.ignore_action for r in scan.ignore_decision(rows, rules, allow).collect()}


def test_last_rule_of_a_source_wins(spark):
    rules = scan.compile_ignore_rules(version_control=["*.log", "!keep.log"], defaults=False)
    assert decide(spark, rules, ["a.log", "keep.log", "x/keep.log"]) == {"a.log": "exclude", "keep.log": "include", "x/keep.log": "include"}
    assert decide(spark, rules, ["keep.log"], allow=False) == {"keep.log": "exclude"}


def test_stronger_source_wins(spark):
    rules = scan.compile_ignore_rules(mandatory=["secret.txt"], user_include=["secret.txt", "build/"], defaults=True)
    assert decide(spark, rules, ["secret.txt", "build/x.py", "dist/x.py", "src/x.py"]) == {"secret.txt": "exclude", "build/x.py": "include", "dist/x.py": "exclude", "src/x.py": "include"}


def test_anchors_and_segments(spark):
    rules = scan.compile_ignore_rules(project=["/docs", "a/**/z", "tmp/", "b/[!x]?.py"], defaults=False)
    got = decide(spark, rules, ["docs/", "docs/x", "sub/docs", "a/z", "a/b/c/z", "tmp", "tmp/", "q/tmp/x", "b/yy.py", "b/xy.py"])
    assert got["docs"] == "exclude" and got["docs/x"] == "include" and got["sub/docs"] == "include"
    assert got["a/z"] == got["a/b/c/z"] == got["q/tmp/x"] == got["b/yy.py"] == "exclude" and got["b/xy.py"] == "include"


def test_excluded_directories_hide_what_is_below(spark):
    files = spark.createDataFrame([("docs/x", "file"), ("docs/in/y", "file"), ("z", "file")], "path string, entry_type string")
    rules = scan.compile_ignore_rules(project=["/docs"], defaults=False)
    assert [r.path for r in scan.prune_ignored(files, rules).collect()] == ["z"]
    kept = scan.compile_ignore_rules(project=["/docs"], user_include=["nothing"], defaults=False)
    assert scan.prune_ignored(files, kept).count() == 3


@pytest.mark.parametrize("bad", ["", "//x", "C:x", "a/../b", "/"])
def test_patterns_outside_the_project_are_rejected(bad):
    with pytest.raises(ValueError):
        scan.compile_ignore_rules(project=[bad])


def test_sniffing(spark):
    rows = [("utf8", b"plain"), ("empty", b""), ("nul", b"a\x00b"), ("bad", b"\xff\xffx"), ("bom", b"\xef\xbb\xbfhi"), ("wide", "hé".encode("utf-16")), ("odd", b"\xff\xfea"), ("ctrl", b"\x01\x02abc"), ("gen", b"# @Generated"), ("key", b"-----BEGIN RSA PRIVATE KEY-----"), ("cut", b"a" * 8191 + "é".encode())]
    out = {r.name: r for r in scan.sniff_content(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert {n for n, r in out.items() if r.binary_sample} == {"nul", "bad", "odd", "ctrl", "cut"}
    assert out["bom"].encoding == "utf-8-sig" and out["wide"].encoding == "utf-16-le" and out["utf8"].encoding == "utf-8" and out["empty"].encoding is None
    assert out["gen"].generated_sample and out["key"].sensitive_sample and not out["utf8"].generated_sample


def test_classification(spark):
    names = ["src/a.py", "README", "tests/x.py", "a_test.go", "pyproject.toml", "Dockerfile", ".env", ".env.local", "x.min.js", "img.png", "weird", "docs/guide", "my_token.txt", "dist/a.py"]
    rows = spark.createDataFrame([(n, "file", b"x") for n in names] + [("d", "directory", None)], "path string, entry_type string, content binary")
    kinds = {r.path: (r.kind, r.classifications) for r in scan.classify_artifacts(scan.sniff_content(rows)).collect()}
    assert kinds["src/a.py"] == ("source", ["source"]) and kinds["README"][0] == "documentation" and kinds["tests/x.py"] == ("test", ["source", "test"]) and kinds["a_test.go"][0] == "test"
    assert kinds["pyproject.toml"][0] == "manifest" and kinds["Dockerfile"][0] == "build" and kinds[".env"] == ("configuration", ["configuration", "sensitive"]) and kinds[".env.local"][0] == "configuration"
    assert kinds["x.min.js"][0] == "generated" and kinds["img.png"][0] == "binary" and kinds["weird"] == ("unknown", ["unknown"]) and kinds["docs/guide"][0] == "documentation"
    assert kinds["my_token.txt"] == ("documentation", ["documentation", "sensitive"]) and kinds["dist/a.py"] == ("generated", ["generated"]) and kinds["d"] == ("directory", ["unknown"])


def test_project_fingerprint_ignores_row_order(spark):
    rows = [("p", f"f{i}", "source", ["source"], "available", f"h{i}") for i in range(20)]
    schema = "project_id string, path string, kind string, classifications array<string>, availability string, fingerprint string"
    a = scan.project_fingerprint(spark.createDataFrame(rows, schema)).collect()
    b = scan.project_fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3)).collect()
    assert a == b
    assert scan.project_fingerprint(spark.createDataFrame(rows[1:], schema)).collect() != a
