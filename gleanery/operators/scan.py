"""Scan of file tables: paths, ignore rules, content sniffing, classification, fingerprints, snapshot differences."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfc

# ---------------------------------------------------------------------------------------------------------------
# Names, extensions and patterns that decide a file's kind.
SOURCE_EXTENSIONS = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".go": "go", ".h": "c", ".hpp": "cpp",
    ".html": "html", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".php": "php",
    ".py": "python", ".rb": "ruby", ".rs": "rust", ".sh": "shell", ".sql": "sql", ".swift": "swift",
    ".ts": "typescript", ".tsx": "typescript", ".vue": "vue",
}
DOCUMENTATION_EXTENSIONS = [".adoc", ".md", ".mdx", ".rst", ".txt"]
CONFIGURATION_EXTENSIONS = [".cfg", ".conf", ".ini", ".json", ".toml", ".xml", ".yaml", ".yml"]
BINARY_EXTENSIONS = [
    ".7z", ".a", ".avi", ".bin", ".class", ".dll", ".dylib", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpeg", ".jpg",
    ".mov", ".mp3", ".mp4", ".o", ".pdf", ".png", ".pyc", ".so", ".tar", ".wasm", ".webp", ".woff", ".woff2", ".zip",
]
MANIFEST_NAMES = [
    "cargo.lock", "cargo.toml", "composer.json", "composer.lock", "go.mod", "go.sum", "package-lock.json", "package.json",
    "pnpm-lock.yaml", "poetry.lock", "pyproject.toml", "requirements.txt", "uv.lock", "yarn.lock",
]
BUILD_NAMES = ["build.gradle", "build.gradle.kts", "cmakelists.txt", "dockerfile", "justfile", "makefile", "meson.build"]
CONFIGURATION_NAMES = [
    ".editorconfig", ".gitattributes", ".gitignore", ".pre-commit-config.yaml", "docker-compose.yaml", "docker-compose.yml",
    "tox.ini", "tsconfig.json",
]
SENSITIVE_PATTERNS = [
    ".env", ".env.*", "*.key", "*.p12", "*.pfx", "*.pem", "*credentials*", "*private_key*", "*secret*", "*token*", "id_dsa",
    "id_ed25519", "id_rsa",
]
GENERATED_PATTERNS = ["*.bundle.css", "*.bundle.js", "*.generated.*", "*.g.cs", "*.min.css", "*.min.js", "bundle.css", "bundle.js"]
GENERATED_DIRECTORIES = ["build", "dist", "generated", "out", "target"]
TEST_DIRECTORIES = ["spec", "specs", "test", "tests"]
DOCUMENTATION_DIRECTORIES = ["doc", "docs"]
DEFAULT_EXCLUSIONS = [
    ".git/", ".hg/", ".svn/", "node_modules/", "vendor/", ".venv/", "venv/", "env/", "__pycache__/", ".hypothesis/",
    ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", ".tox/", ".nox/", ".coverage", "coverage/", "htmlcov/", "dist/",
    "build/", "target/", "out/", ".cache/", ".idea/", ".vscode/", ".worktrees/",
]
#: Sources of ignore rules, the strongest first.
RULE_SOURCES = ["mandatory", "user_exclude", "user_include", "project", "version_control", "default"]
GENERATED_MARKS = ["@generated", "code generated", "do not edit"]
SAMPLE_BYTES = 8192
# ---------------------------------------------------------------------------------------------------------------


def normalize_paths(df: DataFrame, col: str = "path", decomposed: bool = False) -> DataFrame:
    """Adds ``canonical_path`` and ``path_error`` (null, or why the path is rejected).

    Backslashes count as slashes; empty and ``.`` segments go. Rejected are NUL, leading slashes, drive letters,
    ``..`` and what is empty by then. ``decomposed`` composes the characters first, in Python.
    """
    raw = F.col(col)
    segments = F.filter(F.split(F.translate(nfc(raw) if decomposed else raw, "\\", "/"), "/"), lambda s: ~s.isin("", "."))
    error = (
        F.when(raw.isNull(), "missing")
        .when(raw.contains("\x00"), "nul")
        .when(raw.rlike(r"^[/\\]"), "absolute")
        .when(raw.rlike(r"^[A-Za-z]:"), "drive")
        .when(F.array_contains(segments, ".."), "parent_traversal")
        .when(F.size(segments) == 0, "empty")
    )
    return df.withColumns({"canonical_path": F.when(error.isNull(), F.array_join(segments, "/")), "path_error": error})


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    source: str
    action: str
    ord: int
    base_path: str = ""
    directory_only: bool = False
    anchored: bool = False

    @property
    def precedence(self) -> int:
        return RULE_SOURCES.index(self.source)

    def regex(self, directory: bool) -> str:
        """A pattern for whole paths of directories, or of files."""
        base = re.escape(self.base_path) + "/" if self.base_path else ""
        below = "(/|$)" if directory else "/"
        if "/" not in self.pattern and not self.anchored:
            return f"^{base}(.*/)?{glob(self.pattern)}" + (below if self.directory_only else "(/|$)")
        return f"^{base}{_segments(self.pattern.split('/'))}" + (below if self.directory_only else "$")


def glob(pattern: str) -> str:
    """A shell pattern within one path segment as a regular expression."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        close = pattern.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            inner = pattern[at + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\").replace("[", "\\[") + "]"
            at = close
        else:
            out += re.escape(c)
        at += 1
    return out


def _segments(parts: list[str]) -> str:
    """Path segments with ``**`` for any number of them."""
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part != "**":
            out += glob(part) + ("" if last else "/")
        elif not last:
            out += "(?:[^/]+/)*"
        else:
            out = out.removesuffix("/") + "(?:/[^/]+)*" if out else "[^/]+(?:/[^/]+)*"
    return out


def compile_ignore_rules(
    mandatory: Iterable[str] = (), user_exclude: Iterable[str] = (), user_include: Iterable[str] = (), project: Iterable[str] = (), version_control: Iterable[str] = (), defaults: bool = True, base_path: str = ""
) -> list[IgnoreRule]:
    """Rules in their order. ``version_control`` holds lines of an ignore file: blank lines and ``#`` are skipped, ``!`` includes."""
    given = [
        ("mandatory", mandatory), ("user_exclude", user_exclude), ("user_include", user_include), ("project", project),
        ("version_control", version_control), ("default", DEFAULT_EXCLUSIONS if defaults else ()),
    ]
    rules: list[IgnoreRule] = []
    for source, patterns in given:
        for pattern in patterns:
            text = pattern.strip()
            include = source == "user_include"
            if source == "version_control":
                if not text or text.startswith("#"):
                    continue
                include, text = text.startswith("!"), text.removeprefix("!")
            if not text or "\x00" in text or re.match(r"^([A-Za-z]:|//|\\\\)", text) or ".." in re.split(r"[/\\]", text):
                raise ValueError(f"not a pattern of project paths: {pattern!r}")
            parts = [p for p in text.replace("\\", "/").strip("/").split("/") if p not in ("", ".")]
            if not parts:
                raise ValueError(f"nothing to match: {pattern!r}")
            rules.append(
                IgnoreRule(
                    "/".join(parts), source, "include" if include else "exclude", len(rules),
                    base_path if source == "version_control" else "", text[-1] in "/\\", text[0] in "/\\",
                )
            )
    return rules


def _decision(rules: list[IgnoreRule], path: Column, directory: Column) -> Column:
    """The rule that wins: struct (precedence, later first, action, pattern), null if none matches."""
    tries = [
        F.when(
            F.when(directory, path.rlike(r.regex(True))).otherwise(path.rlike(r.regex(False))),
            F.struct(
                F.lit(r.precedence).alias("precedence"), F.lit(-r.ord).alias("late"), F.lit(r.action).alias("action"),
                F.lit(r.pattern).alias("pattern"),
            ),
        )
        for r in rules
    ]
    return F.array_min(F.array_compact(F.array(*tries)))


def ignore_decision(files: DataFrame, rules: list[IgnoreRule], allow_include: bool = True) -> DataFrame:
    """Adds ``ignore_action`` (include or exclude) and ``ignore_pattern``, the rule that decided.

    Among matching rules the strongest source wins, then the last rule; without a match a file is included.
    ``files`` has path and entry_type. Rules are literals of the plan: no join, no shuffle.
    """
    used = [r for r in rules if allow_include or r.action == "exclude"]
    if not used:
        return files.withColumns({"ignore_action": F.lit("include"), "ignore_pattern": F.lit(None).cast("string")})
    rows = files.withColumn("__won", _decision(used, F.col("path"), F.col("entry_type") == "directory"))
    rows = rows.withColumns({"ignore_action": F.coalesce("__won.action", F.lit("include")), "ignore_pattern": F.col("__won.pattern")})
    return rows.drop("__won")


def prune_ignored(files: DataFrame, rules: list[IgnoreRule], allow_include: bool = True) -> DataFrame:
    """The files that are included and lie in no excluded directory that can be pruned.

    An excluded directory is pruned unless an include rule is stronger, or as strong and later, than the rule that
    excludes it. The directories above a path are tested in the row itself.
    """
    used = [r for r in rules if allow_include or r.action == "exclude"]
    includes = [(r.precedence, -r.ord) for r in used if r.action == "include"]
    kept = ignore_decision(files, rules, allow_include).filter("ignore_action = 'include'")
    if not used:
        return kept
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    def prunes(directory: Column) -> Column:
        won = _decision(used, directory, F.lit(True))
        overruled = F.lit(False)
        for precedence, late in includes:
            overruled = overruled | (F.lit(precedence) < won["precedence"]) | ((F.lit(precedence) == won["precedence"]) & (F.lit(late) < won["late"]))
        return F.coalesce((won["action"] == "exclude") & ~overruled, F.lit(False))
    return kept.filter(~F.exists(above, prunes))


@F.pandas_udf(T.StringType())
def _utf16(samples: pd.Series) -> pd.Series:
    """Text of samples with a UTF-16 mark; null where they don't decode."""

    def decode(sample: bytes | None) -> str | None:
        try:
            return None if sample is None else sample.decode("utf-16-le" if sample[:2] == b"\xff\xfe" else "utf-16-be")
        except UnicodeDecodeError:
            return None

    return samples.map(decode)


def sniff_content(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds binary_sample, encoding, generated_sample, sensitive_sample from the first 8,192 bytes.

    A sample is binary if it holds NUL or isn't valid in its encoding (also where the cut splits a character), or if
    more than a tenth are control characters. Only samples with a UTF-16 mark are decoded in Python.
    """
    sample = F.substring(F.col(content_col).cast("binary"), 1, SAMPLE_BYTES)
    head = F.hex(F.substring(sample, 1, 3))
    mark = F.when(
        head.startswith("FFFE"), "utf-16-le",
    ).when(head.startswith("FEFF"), "utf-16-be").when(head == "EFBBBF", "utf-8-sig").otherwise("utf-8")
    rows = files.withColumns({"__sample": sample, "__mark": mark})
    wide = F.col("__mark").startswith("utf-16")
    rows = rows.withColumn("__wide", _utf16(F.when(wide, F.col("__sample"))))
    text = F.col("__sample").cast("string")
    plain = F.when(
        F.is_valid_utf8(text) & ((F.col("__mark") == "utf-8-sig") | ~F.contains(text, F.lit("\x00"))),
        F.regexp_replace(text, "^\\x{FEFF}", ""),
    )
    rows = rows.withColumn("__text", F.when(wide, F.col("__wide")).otherwise(plain))
    empty = F.coalesce(F.octet_length("__sample"), F.lit(0)) == 0
    controls = F.regexp_count("__text", F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"))
    binary = ~empty & (F.col("__text").isNull() | (controls / F.greatest(F.length("__text"), F.lit(1)) > 0.10))
    low = F.lower("__text")
    generated = F.lit(False)
    for mark_text in GENERATED_MARKS:
        generated = generated | low.contains(mark_text)
    known = ~empty & ~binary
    return rows.withColumns({
        "binary_sample": F.coalesce(binary, F.lit(False)),
        "encoding": F.when(known, F.col("__mark")),
        "generated_sample": F.coalesce(known & generated, F.lit(False)),
        "sensitive_sample": F.coalesce(known & low.contains("-----begin") & low.contains("private key-----"), F.lit(False)),
    }).drop("__sample", "__mark", "__wide", "__text")


def _any_glob(patterns: list[str]) -> str:
    return "^(" + "|".join(glob(p) for p in patterns) + ")$"


def classify_artifacts(files: DataFrame) -> DataFrame:
    """Adds kind, classifications, detected_language and evidence to files with path, entry_type and the sniffed columns."""
    parts = F.transform(F.split("path", "/"), lambda p: F.lower(p))
    rows = files.withColumns({"__name": F.element_at(parts, -1), "__dirs": F.slice(parts, 1, F.size(parts) - 1)})
    name, dirs = F.col("__name"), F.col("__dirs")
    rows = rows.withColumns({"__ext": F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1), "__stem": F.regexp_replace(name, r"\.[^.]*$", "")})
    ext, stem = F.col("__ext"), F.col("__stem")
    language = F.try_element_at(F.create_map(*(F.lit(x) for pair in SOURCE_EXTENSIONS.items() for x in pair)), ext)
    within = lambda names: F.arrays_overlap(dirs, F.array(*(F.lit(n) for n in names)))
    binary = ext.isin(BINARY_EXTENSIONS) | F.col("binary_sample")
    generated = within(GENERATED_DIRECTORIES) | name.rlike(_any_glob(GENERATED_PATTERNS)) | F.col("generated_sample")
    sensitive = name.rlike(_any_glob(SENSITIVE_PATTERNS)) | F.col("sensitive_sample")
    test = within(TEST_DIRECTORIES) | stem.startswith("test_") | stem.endswith("_test") | stem.endswith(".test") | stem.endswith(".spec")
    configuration = name.isin(CONFIGURATION_NAMES) | ext.isin(CONFIGURATION_EXTENSIONS) | (name == ".env") | name.startswith(".env.")
    documentation = name.rlike("^(readme|changelog|license)") | ext.isin(DOCUMENTATION_EXTENSIONS) | within(DOCUMENTATION_DIRECTORIES)
    kind = (
        F.when(F.col("entry_type") == "directory", "directory").when(binary, "binary").when(generated, "generated").when(test, "test")
        .when(name.isin(MANIFEST_NAMES), "manifest").when(name.isin(BUILD_NAMES), "build").when(configuration, "configuration")
        .when(documentation, "documentation").when(language.isNotNull(), "source").otherwise("unknown")
    )
    rows = rows.withColumn("kind", kind)
    kind, file = F.col("kind"), F.col("kind") != "directory"
    label = lambda when, text: F.when(when, F.lit(text))
    labels = F.array_compact(F.array(
        label(file & binary, "binary"), label(
            kind.isin("manifest", "build", "configuration"), "configuration",
        ), label(kind == "documentation", "documentation"),
        label(file & generated, "generated"), label(file & sensitive, "sensitive"), label(
            kind.isin("test", "source"), "source",
        ), label(kind == "test", "test"),
        label(kind.isin("unknown", "directory"), "unknown"),
    ))
    evidence = F.array_compact(F.array(
        label(~file, "entry_type:directory"),
        F.when(file & (ext != ""), F.concat(F.lit("extension:"), ext)),
        F.when(file & binary, F.when(F.col("binary_sample"), "bounded_sample:binary").otherwise("extension:binary")),
        F.when(file & generated, F.when(F.col("generated_sample"), "bounded_sample:generated").otherwise("path:generated_pattern")),
        F.when(file & sensitive, F.when(F.col("sensitive_sample"), "bounded_sample:private_key").otherwise("filename:sensitive_pattern")),
        label(kind == "test", "path:test_convention"), label(kind == "manifest", "filename:manifest"), label(kind == "build", "filename:build"),
        label(kind == "configuration", "filename:configuration"), label(kind == "documentation", "path:documentation"),
        F.when(kind == "source", F.concat(F.lit("language:"), language)), label(kind == "unknown", "classification:unknown"),
    ))
    rows = rows.withColumns({
        "classifications": F.array_sort(labels),
        "detected_language": F.when(file, language),
        "encoding": F.when(file & ~binary, F.col("encoding")),
        "evidence": F.array_sort(evidence),
    })
    return rows.drop("__name", "__dirs", "__ext", "__stem")


def availability(files: DataFrame, max_file_size: int) -> DataFrame:
    """Adds ``availability``: unreadable without content, skipped above the size limit, else available.

    Unreadable and skipped files lose their content, so that they are classified by path only.
    """
    state = F.when(F.col("content").isNull(), "unreadable").when(F.col("size_bytes") > max_file_size, "skipped").otherwise("available")
    return files.withColumn("availability", state).withColumn("content", F.when(F.col("availability") == "available", F.col("content")))


def content_fingerprint(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def artifact_fingerprint(files: DataFrame, include_timestamp: bool = False) -> DataFrame:
    """Adds content_fingerprint and ``fingerprint``, the digest of path, entry type, content and (perhaps) time."""
    modified = F.col("modified_time_ns").cast("string") if include_timestamp else F.lit("ignored")
    rows = files.withColumn("content_fingerprint", content_fingerprint(F.col("content")))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("path="), F.col("path")),
        F.concat(F.lit("entry_type="), F.col("entry_type")),
        F.concat(F.lit("content="), F.coalesce("content_fingerprint", F.lit("none"))),
        F.concat(F.lit("modified_time_ns="), modified),
    )
    return rows.withColumn("fingerprint", F.concat(F.lit("artifact_sha256_"), F.sha2(text, 256)))


def _component() -> Column:
    text = F.concat_ws("|", "path", "kind", F.array_join("classifications", ","), "availability", "fingerprint")
    return F.regexp_replace(text, "\r\n?", "\n")


def _block_of(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, BLOCK_DIGITS)


def _payload_digest(kind: str, rows: Column, ordering: str, schema: str) -> Column:
    """The digest of the values of rows (k, v), in their order, in a fixed JSON payload."""
    payload = F.struct(
        F.lit(schema).alias("fingerprint_schema"), F.lit(kind).alias("fingerprint_type"), F.lit("lf").alias("line_endings"),
        F.lit(ordering).alias("ordering"), F.transform(F.array_sort(rows), lambda s: s["v"]).alias("values"),
    )
    return F.sha2(F.to_json(payload), 256)


def block_digests(artifacts: DataFrame, ordering: str = "ordered", schema: str = "v1") -> DataFrame:
    """(project_id, k, v): the digest of each block of a project's components; k is the block's key.

    Components fall into blocks by the digest of their path (of themselves, if unordered). A block's digest is
    that of its components in the order of path (sorted, if unordered). Line ends become line feeds.
    """
    component = _component()
    rows = artifacts.select("project_id", component.alias("v"), (F.col("path") if ordering == "ordered" else component).alias("k"))
    listed = _payload_digest("block", F.collect_list(F.struct("k", "v")), ordering, schema)
    return rows.groupBy("project_id", _block_of(F.col("k")).alias("block")).agg(listed.alias("v")).select("project_id", F.col("block").alias("k"), "v")


def update_block_digests(blocks: DataFrame, artifacts: DataFrame, changes: DataFrame, schema: str = "v1") -> DataFrame:
    """The :func:`block_digests` (ordered) of ``artifacts``, the current ones, from those of the version before.

    ``changes`` (project_id, path, change) come from :func:`diff_snapshots`. Only blocks with a path that isn't reused are
    hashed again; artifacts of other blocks go no further than the key of their block. Blocks left empty vanish.
    """
    keys = ["project_id", "k"]
    touched = changes.filter("change <> 'reused'").select("project_id", _block_of(F.col("path")).alias("k")).distinct()
    rows = artifacts.withColumn("k", _block_of(F.col("path"))).join(touched, keys, "left_semi").drop("k")
    return blocks.join(touched, keys, "left_anti").unionByName(block_digests(rows, "ordered", schema))


def combined_fingerprint(blocks: DataFrame, ordering: str = "ordered", schema: str = "v1") -> DataFrame:
    """(project_id, project_fingerprint): the digest of a project's block digests in the order of blocks."""
    digest = _payload_digest("project", F.collect_list(F.struct("k", "v")), ordering, schema)
    return blocks.groupBy("project_id").agg(F.concat(F.lit("project_sha256_"), digest).alias("project_fingerprint"))


def project_fingerprint(artifacts: DataFrame, ordering: str = "ordered", schema: str = "v1") -> DataFrame:
    """(project_id, project_fingerprint): the digest of all artifact components of a project in fixed JSON payloads.

    It is the digest of block digests (:func:`block_digests`), so no task gathers a project, however many files it has; kept
    ones can be brought up to date by the changed files alone (:func:`update_block_digests`).
    """
    return combined_fingerprint(block_digests(artifacts, ordering, schema), ordering, schema)


#: Hexadecimal digits that choose a component's block: 4,096 blocks of a project.
BLOCK_DIGITS = 3


def scan_statistics(files: DataFrame) -> DataFrame:
    """Counts and status per project, of files with ignore_action, availability, kind, size_bytes (and reused, if there)."""
    included = F.col("ignore_action") == "include"
    reused = F.count_if(included & F.col("reused")) if "reused" in files.columns else F.lit(0)
    counts = files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(included).alias("included"),
        F.count_if(~included).alias("excluded"),
        F.count_if(included & (F.col("availability") == "skipped")).alias("unsupported"),
        F.count_if(included & (F.col("availability") == "unreadable")).alias("unreadable"),
        F.sum(F.when(included, F.col("size_bytes")).otherwise(0)).alias("bytes"),
        reused.cast("long").alias("reused"),
    )
    status = F.when(F.col("included") == 0, "failed").when(F.col("unreadable") > 0, "incomplete").when(
        F.col("unsupported") > 0, "complete_with_warnings",
    ).otherwise("complete")
    return counts.withColumn("status", status)


def diff_snapshots(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(project_id, path, change): reused, changed, added or deleted, by fingerprint and scanner version.

    Both tables have project_id, path, fingerprint and scanner_version; no content is shuffled.
    """
    keys = ["project_id", "path"]
    before = previous.select(*keys, F.struct("fingerprint", "scanner_version").alias("was"))
    after = current.select(*keys, F.struct("fingerprint", "scanner_version").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(
        F.col("was").eqNullSafe(F.col("now")), "reused",
    ).otherwise("changed")
    return before.join(after, keys, "full_outer").select(*keys, change.alias("change"))
