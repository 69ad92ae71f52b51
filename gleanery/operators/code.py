"""Python sources as tables: definitions, imports, references, symbols, edges and units; edges resolved by name."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written
from ..functions.text import uuid5

MAX_UNIT = 4096
PARSED = "project_id string, path string, tag string, seq int, name string, qualified string, parent string, kind string, target string, start_line int, start_column int, end_line int, end_column int, text string, parent_seq int"
#: Files whose facts are held at a time.
FILES = 500


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def _rows(path: str, text: str) -> list[dict]:
    """Facts of one file: definitions, imports and name loads, each with the scope it stands in; or one error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [{"tag": "error", "name": type(error).__name__, "start_line": getattr(error, "lineno", None) or 1}]
    module, lines, out = module_name(path), text.splitlines(), []

    def column(line: int, offset: int) -> int:
        """Characters before a byte offset of a line."""
        return len(lines[line - 1].encode()[:offset].decode("utf-8", "replace")) if line <= len(lines) else offset

    def span(node: ast.AST, first: int | None = None) -> dict:
        start, end = first or node.lineno, node.end_lineno
        start_column = 0 if first and first != node.lineno else column(node.lineno, node.col_offset)
        return {"start_line": start, "start_column": start_column + 1, "end_line": end, "end_column": max(1, column(end, node.end_col_offset))}

    def visit(node: ast.AST, scope: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{scope}.{child.name}"
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                body = "\n".join(lines[first - 1 : child.end_lineno])
                out.append(
                    {"tag": "definition", "name": child.name, "qualified": name, "parent": scope, "kind": kind, "text": body, **span(child, first)}
                )
                visit(child, name, kind == "class")
                continue
            if isinstance(child, ast.Import):
                for alias in child.names:
                    out.append(
                        {
                            "tag": "import", "name": alias.asname or alias.name, "parent": scope, "target": alias.name,
                            "text": "\n".join(lines[child.lineno - 1 : child.end_lineno]), **span(child),
                        }
                    )
            elif isinstance(child, ast.ImportFrom):
                for alias in child.names:
                    target = "." * child.level + ".".join(p for p in (child.module, alias.name) if p)
                    out.append(
                        {
                            "tag": "import", "name": alias.asname or alias.name, "parent": scope, "target": target,
                            "text": "\n".join(lines[child.lineno - 1 : child.end_lineno]), **span(child),
                        }
                    )
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load):
                out.append({"tag": "reference", "name": child.id, "parent": scope, "target": child.id, **span(child)})
            visit(child, scope, in_class and not isinstance(child, ast.Lambda))

    visit(tree, module, False)
    out.insert(
        0,
        {
            "tag": "module", "name": module.rsplit(".", 1)[-1], "qualified": module, "kind": "module", "start_line": 1,
            "start_column": 1, "end_line": max(1, len(lines)), "end_column": 1,
        },
    )
    last = {r["qualified"]: n for n, r in enumerate(out) if "qualified" in r}
    for r in out:
        r["parent_seq"] = last.get(r.get("parent"))
    return out


def parse_python(contents: DataFrame) -> DataFrame:
    """Tagged facts (module, definition, import, reference, error) of the Python files in contents (project_id, path, content).

    Names in decorators, defaults and annotations count inside the definition's own scope. A file that doesn't parse
    gives one error and nothing else. Lines and columns count characters from one. ``parent_seq`` is the fact that the
    parent's name stands for: of repeated qualified names the last definition of the file.
    """
    names = [f.split()[0] for f in PARSED.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), FILES):
                rows = []
                for project, path, text in batch.iloc[at : at + FILES].itertuples(index=False, name=None):
                    rows += [{"project_id": project, "path": path, "seq": n, **r} for n, r in enumerate(_rows(path, text or ""))]
                frame = pd.DataFrame(rows, columns=names)
                for c in ("seq", "start_line", "start_column", "end_line", "end_column", "parent_seq"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    python = contents.filter(F.col("path").endswith(".py")).select("project_id", "path", F.col("content").cast("string"))
    return python.mapInPandas(parse, PARSED)


def _symbol_id(namespace: str, qualified: str = "qualified", seq: str = "seq") -> Column:
    return uuid5(namespace, F.concat_ws(":", "project_id", "path", qualified, F.col(seq).cast("string")))


def _parent_id(namespace: str) -> Column:
    return F.when(F.col("parent_seq").isNotNull(), _symbol_id(namespace, "parent", "parent_seq"))


def python_symbols(parsed: DataFrame, namespace: str) -> DataFrame:
    """Symbols of modules and definitions with their parent; of repeated qualified names the last definition is the parent."""
    own = parsed.filter(F.col("tag").isin("module", "definition"))
    return own.select(
        "project_id", "path", _symbol_id(namespace).alias("symbol_id"), "name", "kind", F.col("qualified").alias("qualified_name"),
        _parent_id(namespace).alias("parent_symbol_id"), "start_line", "start_column", "end_line", "end_column", F.lit("python").alias("language"),
    )


def python_edges(parsed: DataFrame, symbols: DataFrame, namespace: str) -> DataFrame:
    """Raw edges: contains and defines (resolved) to each definition, imports and depends_on to modules, references to names."""
    rows = parsed.filter(F.col("tag").isin("definition", "import", "reference") & F.col("parent_seq").isNotNull())
    rows = rows.withColumns({"own": _symbol_id(namespace), "source_reference": _parent_id(namespace)})
    kinds = F.when(
        F.col("tag") == "definition", F.array(F.lit("contains"), F.lit("defines")),
    ).when(F.col("tag") == "import", F.array(F.lit("imports"), F.lit("depends_on"))).otherwise(F.array(F.lit("references")))
    target = F.when(F.col("tag") == "definition", F.col("own")).when(
        F.col("tag") == "import", F.concat(F.lit("python-module:"), "target"),
    ).otherwise(F.concat(F.lit("python-name:"), "target"))
    rows = rows.select(
        "project_id", "path", "seq", "source_reference", target.alias("target_reference"),
        F.explode(kinds).alias("kind"),
        F.when(F.col("tag") == "definition", "resolved_internal").otherwise("unresolved").alias("resolution"),
        "start_line",
    )
    return rows.withColumn(
        "relationship_id",
        uuid5(namespace, F.concat_ws(":", "project_id", "path", "kind", F.col("seq").cast("string"), "target_reference")),
    )


def python_units(parsed: DataFrame, max_unit_bytes: int = MAX_UNIT) -> DataFrame:
    """(project_id, path, ord, kind, start_line, text): a summary of the module, the definitions' bodies, the import lines.

    Bodies over the limit are given line by line.
    """
    count = lambda tag: F.count_if(F.col("tag") == tag).cast("string")
    summary = parsed.groupBy("project_id", "path").agg(
        F.max(F.when(F.col("tag") == "module", F.col("qualified"))).alias("m"), count("definition").alias("d"),
        count("import").alias("i"),
    ).filter("m is not null")
    summary = summary.select(
        "project_id", "path", F.lit(-1).alias("seq"), F.lit("module_summary").alias("kind"),
        F.lit(1).alias("start_line"),
        F.concat(F.lit("module "), "m", F.lit("; definitions="), "d", F.lit("; imports="), "i").alias("text"),
    )
    imports = parsed.filter("tag = 'import'").groupBy("project_id", "path", "start_line").agg(F.min("seq").alias("seq"), F.first("text").alias("text")).select(
        "project_id", "path", "seq", F.lit("import_block").alias("kind"), "start_line", "text",
    )
    bodies = parsed.filter("tag = 'definition'").select("project_id", "path", "seq", F.lit("symbol_definition").alias("kind"), "start_line", "text")
    rows = summary.unionByName(bodies).unionByName(imports)
    whole = F.array(F.col("text"))
    rows = rows.select(
        "project_id", "path", "seq", "kind", "start_line",
        F.posexplode(F.when(F.octet_length("text") > max_unit_bytes, F.split("text", "\n")).otherwise(whole)).alias("k", "text"),
    ).filter("text <> ''")
    number = F.row_number().over(Window.partitionBy("project_id", "path").orderBy("seq", "k")) - 1
    return rows.select("project_id", "path", number.alias("ord"), "kind", (F.col("start_line") + F.col("k")).alias("start_line"), "text")


def _suffixes(symbols: DataFrame) -> DataFrame:
    """(project_id, key, symbol_id, module): every dotted suffix of every qualified name."""
    parts = F.split("qualified_name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    return symbols.select("project_id", F.explode(suffixes).alias("key"), "symbol_id", (F.col("kind") == "module").cast("long").alias("module"))


def _least(module_only: bool = False) -> Column:
    return F.min(F.when(F.col("module") == 1, F.col("symbol_id")) if module_only else F.col("symbol_id"))


def suffix_counts(symbols: DataFrame) -> DataFrame:
    """(project_id, key, n, s, mn, ms): how many symbols, and modules, a dotted suffix names, and the least of them."""
    return _suffixes(symbols).groupBy("project_id", "key").agg(
        F.count(F.lit(1)).alias("n"), _least().alias("s"), F.sum("module").alias("mn"), _least(True).alias("ms"),
    )


def change_counts(counts: DataFrame, symbols: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``counts`` of :func:`suffix_counts` after symbols came and went, and the suffixes (project_id, key) that this touches.

    Counts are changed by the suffixes of ``added`` and ``removed`` alone. Only for touched suffixes that name a single
    symbol or module is that one looked up among ``symbols``, the current ones; of others it isn't known (nor needed).
    """
    keys = ["project_id", "key"]
    delta = _suffixes(added).withColumn("d", F.lit(1)).unionByName(_suffixes(removed).withColumn("d", F.lit(-1)))
    delta = written(delta.groupBy(*keys).agg(F.sum("d").alias("dn"), F.sum(F.col("d") * F.col("module")).alias("dmn")))
    moved = counts.join(delta, keys, "full_outer").select(
        *keys, (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"), "s",
        (F.coalesce("mn", F.lit(0)) + F.coalesce("dmn", F.lit(0))).alias("mn"), "ms", F.col("dn").isNotNull().alias("touched"),
    )
    moved = written(moved.filter("n > 0"))
    single = moved.filter("touched and (n = 1 or mn = 1)").select(*keys)
    found = _suffixes(symbols).join(single, keys, "left_semi").groupBy(*keys).agg(_least().alias("one"), _least(True).alias("one_module"))
    now = moved.join(found, keys, "left")
    known = lambda old, new: F.when(F.col("touched"), F.col(new)).otherwise(F.col(old)).alias(old)
    return now.select(*keys, "n", known("s", "one"), "mn", known("ms", "one_module")), delta.select(*keys)


def _keyed(edges: DataFrame) -> DataFrame:
    target = F.regexp_replace(F.regexp_replace("target_reference", "^python-(module|name):", ""), r"^\.+", "")
    return edges.withColumn("key", target).withColumn("module_key", F.when(F.col("key").contains("."), F.regexp_replace("key", r"\.[^.]*$", "")))


def _resolved(edges: DataFrame, counts: DataFrame) -> DataFrame:
    names = counts.select("project_id", "key", "n", "s")
    modules = counts.filter("mn > 0").select("project_id", F.col("key").alias("module_key"), "mn", "ms")
    rows = edges.join(names, ["project_id", "key"], "left").join(modules, ["project_id", "module_key"], "left")
    matches = F.coalesce("n", "mn", F.lit(0))
    resolution = F.when(matches == 1, "resolved_internal").when(matches > 1, "ambiguous").otherwise("unresolved")
    one = F.when(F.col("n").isNotNull(), F.col("s")).otherwise(F.col("ms"))
    return rows.withColumns({"matches": matches, "resolution": resolution, "target_symbol": F.when(matches == 1, one)}).drop("n", "s", "mn", "ms")


def resolve_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds target_symbol, matches and resolution to edges (relationship_id, project_id, target_reference).

    The target (without scheme and leading dots) matches a qualified name that equals it or ends with it behind a dot.
    If none does and the target has dots, its last part is dropped and modules are matched. One match is
    resolved_internal, several are ambiguous, none is unresolved. All dotted suffixes of a name are keys of an
    equality join, counted per key before it, so popular names don't multiply rows.
    """
    return _resolved(_keyed(edges.drop("resolution")), suffix_counts(symbols)).drop("key", "module_key")


def update_edges(resolved: DataFrame, gone: DataFrame, fresh: DataFrame, counts: DataFrame, touched: DataFrame) -> DataFrame:
    """The edges of a new version from those of the one before: equal to resolving all of them.

    ``resolved`` are edges of :func:`resolve_edges` with a path, ``gone`` the files (project_id, path) whose edges leave, ``fresh``
    the unresolved edges of new and changed files; ``counts`` and ``touched`` come from :func:`change_counts`. Only fresh
    edges and those whose target (or its module) is a touched suffix are resolved again.
    """
    kept = _keyed(resolved.join(gone.select("project_id", "path").distinct(), ["project_id", "path"], "left_anti"))
    by_name = touched.select("project_id", "key", F.lit(True).alias("named"))
    by_module = touched.select("project_id", F.col("key").alias("module_key"), F.lit(True).alias("held"))
    kept = kept.join(by_name, ["project_id", "key"], "left").join(by_module, ["project_id", "module_key"], "left")
    again = F.coalesce("named", "held", F.lit(False))
    still = kept.filter(~again).drop("named", "held")
    raw = kept.filter(again).drop("named", "held", "matches", "resolution", "target_symbol")
    now = _resolved(raw.unionByName(_keyed(fresh.drop("resolution")).select(*raw.columns)), counts)
    return still.unionByName(now.select(*still.columns)).drop("key", "module_key")


def update_code(
    symbols: DataFrame, edges: DataFrame, counts: DataFrame, changed: DataFrame, namespace: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, resolved edges and suffix counts after the files of ``changed`` (project_id, path, content) took their new content.

    Null content deletes a file. Unchanged files aren't parsed. Edges whose target is known when they are made (contains,
    defines) keep it. Each result is written.
    """
    files = changed.select("project_id", "path").distinct()
    parsed = written(parse_python(changed.filter("content is not null")))
    added = written(python_symbols(parsed, namespace))
    keys = ["project_id", "path"]
    removed = symbols.join(files, keys, "left_semi")
    symbols = written(symbols.join(files, keys, "left_anti").unionByName(added.select(*symbols.columns)))
    counts, touched = change_counts(counts, symbols, added, removed)
    counts = written(counts)
    fresh = python_edges(parsed, added, namespace)
    fixed = fresh.filter("resolution = 'resolved_internal'").withColumns({"matches": F.lit(1).cast("long"), "target_symbol": F.col("target_reference")})
    own = F.col("kind").isin("contains", "defines")
    rest = update_edges(edges.filter(~own), files, fresh.filter("resolution <> 'resolved_internal'"), counts, touched)
    kept = edges.filter(own).join(files, keys, "left_anti").unionByName(fixed.select(*edges.columns))
    return symbols, written(kept.unionByName(rest.select(*edges.columns))), counts


#: Empty tables that :func:`update_code` starts from.
SYMBOLS = "project_id string, path string, symbol_id string, name string, kind string, qualified_name string, parent_symbol_id string, start_line int, start_column int, end_line int, end_column int, language string"
EDGES = "project_id string, path string, seq int, source_reference string, target_reference string, kind string, resolution string, start_line int, relationship_id string, matches long, target_symbol string"
COUNTS = "project_id string, key string, n long, s string, mn long, ms string"
