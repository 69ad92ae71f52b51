"""Index tables: routing, text units, look-ups, statistics, incremental updates and checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.search import containing
from ..functions.text import LINE_END, fold
from .scan import content_fingerprint

MAX_CONTENT, MAX_UNIT = 1_000_000, 4_096


def route_artifacts(artifacts: DataFrame, contents: DataFrame, allow_sensitive: bool = False, max_content_bytes: int = MAX_CONTENT) -> DataFrame:
    """Adds strategy, state, diagnostic and content_bytes to artifacts (project_id, path, ignore_action, kind, classifications, content_fingerprint).

    ``contents`` has project_id, path, content; only its digest and size take part in the join.
    """
    sized = contents.select(
        "project_id", "path", content_fingerprint(F.col("content")).alias("__seen"),
        F.octet_length(F.col("content").cast("binary")).alias("__bytes"),
    )
    rows = artifacts.join(sized, ["project_id", "path"], "left")
    has = lambda label: F.array_contains("classifications", label)
    route = (
        F.when(
            F.col("ignore_action") != "include", "skipped:not_included",
        ).when(has("binary"), "skipped:binary").when(F.col("kind") == "directory", "metadata:directory")
        .when(has("sensitive") & ~F.lit(allow_sensitive), "skipped:sensitive").when(F.col("__seen").isNull(), "failed:missing_content")
        .when(
            F.col("__seen") != F.col("content_fingerprint"), "failed:fingerprint_mismatch",
        ).when(F.col("__bytes") > max_content_bytes, "metadata:too_large")
        .when(F.col("detected_language") == "python", "indexed:python").otherwise("indexed:generic")
    )
    parts = F.split(route, ":")
    return rows.withColumns(
        {"state": parts[0], "strategy": F.when(parts[0] == "indexed", parts[1]), "diagnostic": F.when(parts[0] != "indexed", parts[1])}
    ).withColumnRenamed("__bytes", "content_bytes").drop("__seen")


_UNIT = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])


def _pieces(line: str, most: int) -> Iterator[tuple[int, str]]:
    """Pieces of at most ``most`` bytes with where they start, cut between characters."""
    start, size = 0, 0
    for at, c in enumerate(line):
        width = len(c.encode("utf-8", "surrogatepass"))
        if size + width > most and at > start:
            yield start, line[start:at]
            start, size = at, 0
        size += width
    yield start, line[start:]


@F.pandas_udf(T.ArrayType(_UNIT))
def _cut_lines(files: pd.Series, limit: pd.Series) -> pd.Series:
    """The units of files some of whose lines are longer than ``limit`` bytes."""

    def cut(lines: list[str] | None, most: int) -> list[dict] | None:
        if lines is None:
            return None
        return [{"n": n, "start": start, "text": text} for n, line in enumerate(lines) if line for start, text in _pieces(line, most)]

    return pd.Series([cut(*x) for x in zip(files, limit, strict=True)])


def _valid_prefix(content: Column, limit: int) -> Column:
    """The longest valid text of at most ``limit`` bytes; null if the content isn't UTF-8."""
    whole = content.cast("binary")
    heads = [F.substring(whole, 1, limit - k).cast("string") for k in range(4)]
    cut = F.coalesce(*(F.when(F.is_valid_utf8(h), h) for h in heads))
    return F.when(F.octet_length(whole) > limit, cut).otherwise(F.when(F.is_valid_utf8(whole.cast("string")), whole.cast("string")))


def text_units(contents: DataFrame, max_content_bytes: int = MAX_CONTENT, max_unit_bytes: int = MAX_UNIT) -> DataFrame:
    """(project_id, path, ord, start_line, start_column, end_line, end_column, text): a unit for each non-empty line.

    Lines longer than ``max_unit_bytes`` are cut between characters (files with such a line in Python). A file's units are
    numbered where it is read: no row moves. Lines and columns count
    from one, ends included; ``ord`` numbers the units of a file from 0. Content that isn't UTF-8 has no units; longer
    content is read up to its longest valid prefix.
    """
    rows = contents.select("project_id", "path", F.split(_valid_prefix(F.col("content"), max_content_bytes), LINE_END).alias("lines"))
    long = F.exists("lines", lambda line: F.octet_length(line) > max_unit_bytes)
    rows = rows.withColumn("long", long).withColumn("cut", _cut_lines(F.when(F.col("long"), F.col("lines")), F.lit(max_unit_bytes)))
    plain = F.transform("lines", lambda line, n: F.struct(n.alias("n"), F.lit(0).alias("start"), line.alias("text")))
    units = F.when(F.col("long"), F.col("cut")).otherwise(F.filter(plain, lambda unit: unit["text"] != ""))
    pieces = rows.select("project_id", "path", F.posexplode(units).alias("ord", "unit"))
    line, start = F.col("unit.n") + 1, F.col("unit.start") + 1
    return pieces.select(
        "project_id", "path", "ord", line.alias("start_line"), start.alias("start_column"), line.alias("end_line"),
        (start + F.length("unit.text") - 1).alias("end_column"), F.col("unit.text").alias("text"),
    )


def text_diagnostics(contents: DataFrame, max_content_bytes: int = MAX_CONTENT) -> DataFrame:
    """(project_id, path, code) of contents that aren't UTF-8 or are cut."""
    prefix = _valid_prefix(F.col("content"), max_content_bytes)
    code = F.when(prefix.isNull(), "INDEX_INVALID_ENCODING").when(
        F.octet_length(F.col("content").cast("binary")) > max_content_bytes, "INDEX_TRUNCATED",
    )
    return contents.filter("content is not null").select("project_id", "path", code.alias("code")).filter("code is not null")


def index_statistics(
    routed: DataFrame, units: DataFrame | None = None, symbols: DataFrame | None = None, edges: DataFrame | None = None,
) -> DataFrame:
    """Counts and status of the index per project. Each table is counted before it is joined.

    ``indexed_bytes`` sums content_bytes of what is indexed; ``fallbacks`` and ``reused`` count indexed files with the flag ``fallback``
    (kept as plain text, as it doesn't parse) or ``reused`` (taken from the index before), where ``routed`` has them.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in routed.columns else F.lit(False)
    size = F.col("content_bytes") if "content_bytes" in routed.columns else F.lit(0)
    indexed = F.col("state") == "indexed"
    state = lambda s: F.count_if(F.col("state") == s)
    out = routed.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("evaluated"), state("indexed").alias("indexed"), state("skipped").alias("skipped"),
        state("metadata").alias("metadata_only"), state("failed").alias("failures"),
        F.coalesce(F.sum(F.when(indexed, size)), F.lit(0)).cast("long").alias("indexed_bytes"),
        F.count_if(indexed & flag("fallback")).alias("fallbacks"), F.count_if(indexed & flag("reused")).alias("reused"),
    )
    for name, table in (("units", units), ("symbols", symbols), ("edges", edges)):
        if table is not None:
            out = out.join(
                table.groupBy("project_id").agg(F.count(F.lit(1)).alias(name)), "project_id", "left",
            ).withColumn(name, F.coalesce(name, F.lit(0)))
    status = F.when(F.col("evaluated") == F.col("failures"), "failed").when(F.col("failures") > 0, "incomplete").otherwise("complete")
    return out.withColumn("status", status)


def update_index(previous: DataFrame, current: DataFrame, build, versions: tuple[str, str] = ("1", "1")) -> DataFrame:
    """The units of ``current`` contents: those of unchanged files from ``previous``, the rest built by ``build``.

    ``previous`` holds units with project_id, path and content_fingerprint; ``current`` contents with the same keys and
    content. If the versions differ, all are built. Equal to building everything: edges are kept unresolved and are
    resolved after the update, so links into changed files don't get lost.
    """
    keys = ["project_id", "path", "content_fingerprint"]
    now = current.withColumn("content_fingerprint", content_fingerprint(F.col("content")))
    if versions[0] != versions[1]:
        return build(now).join(now.select(*keys), keys[:2])
    held = previous.join(now.select(*keys), keys, "left_semi")
    fresh = now.join(previous.select(*keys).distinct(), keys, "left_anti")
    made = build(fresh).join(fresh.select(*keys), keys[:2])
    return held.unionByName(made.select(*held.columns))


def find_artifacts(artifacts: DataFrame, references: DataFrame) -> DataFrame:
    """Artifacts that a reference (column ``reference``) names by id or by path."""
    by_id = references.join(artifacts, references["reference"] == artifacts["artifact_id"])
    by_path = references.join(artifacts, references["reference"] == artifacts["path"])
    return by_id.unionByName(by_path).distinct()


def find_symbols(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols whose folded name or qualified name equals that of ``names`` (column ``wanted``)."""
    asked = names.select("wanted", fold(F.col("wanted")).alias("key")).distinct()
    keyed = symbols.select("*", F.explode(F.array_distinct(F.array(fold(F.col("name")), fold(F.col("qualified_name"))))).alias("key"))
    return asked.join(keyed, "key").drop("key")


def find_text(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, unit columns) where the folded query is part of the unit's folded text.

    Units hold unit_id (unique). Queries meet units by a token (:func:`gleanery.functions.search.containing`).
    """
    asked = queries.select("query").distinct().withColumn("phrase", fold(F.col("query")))
    found = containing(units.select(F.col("unit_id").alias("id"), fold(F.col("text")).alias("text")), asked)
    return found.withColumnRenamed("id", "unit_id").join(asked, "phrase").join(units, "unit_id").select("query", *units.columns)


def find_relationships(edges: DataFrame, references: DataFrame) -> DataFrame:
    """Edges with a reference (column ``reference``) at either end."""
    ends = [references.join(edges, F.col("reference") == F.col(end)) for end in ("source_reference", "target_reference")]
    return ends[0].unionByName(ends[1]).distinct()


def stale_indexes(indexes: DataFrame, inventories: DataFrame) -> DataFrame:
    """Projects whose index has another inventory_id or project_fingerprint than their inventory, or none."""
    keys = ["inventory_id", "project_fingerprint"]
    rows = inventories.select("project_id", F.struct(*keys).alias("now")).join(
        indexes.select("project_id", F.struct(*keys).alias("was")), "project_id", "left",
    )
    return rows.filter(~F.col("now").eqNullSafe(F.col("was"))).select("project_id")


def check_index(artifacts: DataFrame, symbols: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, table, id) of rows that break the index: repeated ids, unknown artifacts, ends before starts."""

    def repeated(df: DataFrame, name: str, key: str) -> DataFrame:
        rows = df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return rows.select(F.lit("DUPLICATE_ID").alias("code"), F.lit(name).alias("table"), "id")

    def orphans(df: DataFrame, name: str, key: str) -> DataFrame:
        rows = df.join(artifacts.select("artifact_id").distinct(), "artifact_id", "left_anti")
        return rows.select(F.lit("UNKNOWN_ARTIFACT").alias("code"), F.lit(name).alias("table"), F.col(key).cast("string").alias("id"))

    found = [
        repeated(artifacts, "artifacts", "artifact_id"), repeated(symbols, "symbols", "symbol_id"),
        repeated(units, "units", "unit_id"), repeated(edges, "edges", "relationship_id"),
        orphans(symbols, "symbols", "symbol_id"), orphans(units, "units", "unit_id"),
    ]
    if {"start_line", "end_line", "start_column", "end_column"} <= set(units.columns):
        bad = units.filter(F.struct("end_line", "end_column") < F.struct("start_line", "start_column"))
        found.append(bad.select(F.lit("INVALID_LOCATION").alias("code"), F.lit("units").alias("table"), F.col("unit_id").cast("string").alias("id")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def snapshots_equivalent(left: DataFrame, right: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(project_id, equivalent): whether both hold the same rows in ``columns``, as often."""
    cols = ["project_id", *[c for c in columns if c != "project_id"]]
    a, b = left.select(*cols), right.select(*cols)
    odd = a.exceptAll(b).unionAll(b.exceptAll(a)).select("project_id").distinct().withColumn("odd", F.lit(True))
    projects = a.select("project_id").union(b.select("project_id")).distinct()
    return projects.join(odd, "project_id", "left").select("project_id", F.col("odd").isNull().alias("equivalent"))
