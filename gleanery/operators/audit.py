"""Audits of responses, change sets and executions; redaction; diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed
from .scan import normalize_paths

# Words that mark secrets, severities, stages of an execution, operations of a change.
MASK = "[REDACTED]"
SENSITIVE_KEYS = ["api_key", "apikey", "authorization", "credential", "password", "private_key", "secret"]
TOKEN_KEYS = ["access_token", "auth_token", "refresh_token", "token"]
AUTHORIZATION = r"(?i)\bauthorization\s*([:=])\s*(?:bearer\s+)?[^\s,;]+"
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+"
ASSIGNMENT = r"""(?i)\b(password|token|secret|api[_-]?key|credential)\s*([:=])\s*(?:"[^"]*"|'[^']*'|[^\s,;]+)"""
LOCAL_PATH = r"""(?<![\w/])(?:/(?:home|Users|root|tmp|var|opt|mnt)/[^\s"'<>]+|[A-Za-z]:\\[^\s"'<>]+)"""
SEVERITIES = ["critical", "error", "warning", "info"]
STAGES = ["scan", "index", "retrieve", "build", "invoke", "validate"]
OPERATIONS = ["create", "modify", "delete", "rename"]
PROTECTED = [".git", ".env", "secrets"]
TERMINAL = ["completed", "failed", "cancelled"]


# --- Redaction -------------------------------------------------------------------------------------------------


def redact_text(text: Column, rules: str = "diagnostic") -> Column:
    """Masked text. Rules: ``diagnostic`` (authorization, bearer, assignments), ``prompt`` (assignments and bearer), ``report`` (diagnostic and local paths)."""
    out = text
    if rules != "prompt":
        out = F.regexp_replace(out, AUTHORIZATION, f"authorization$1{MASK}")
    out = F.regexp_replace(out, BEARER, f"Bearer {MASK}")
    out = F.regexp_replace(out, ASSIGNMENT, f"$1$2{MASK}")
    return F.regexp_replace(out, LOCAL_PATH, "<local-path>") if rules == "report" else out


def redact_secrets(df: DataFrame, cols: Sequence[str], rules: str = "diagnostic", sensitive: Column | None = None) -> DataFrame:
    """Masks the columns and adds ``redacted``: whether any changed. Rows that are ``sensitive`` are masked whole."""
    new = {c: redact_text(F.col(c), rules) for c in cols}
    if sensitive is not None:
        new = {c: F.when(sensitive & F.col(c).isNotNull(), MASK).otherwise(v) for c, v in new.items()}
    rows = df.withColumns({f"__{c}": v for c, v in new.items()})
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = rows.withColumn("redacted", changed)
    return rows.withColumns({c: F.col(f"__{c}") for c in cols}).drop(*(f"__{c}" for c in cols))


def redact_metadata(df: DataFrame, map_col: str) -> DataFrame:
    """Masks the values of sensitive keys: a listed word as a whole, or with a prefix or suffix set off by an underscore."""
    words = "|".join(SENSITIVE_KEYS)
    pattern = f"^({words}|{'|'.join(TOKEN_KEYS)})$|^({words})_|_({words})$"
    normal = lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return df.withColumn(map_col, F.transform_values(map_col, lambda k, v: F.when(normal(k).rlike(pattern), F.lit(MASK)).otherwise(v)))


def merge_diagnostics(*tables: DataFrame) -> DataFrame:
    """The distinct diagnostics (code, severity, reference, line, column, message) with severity_rank and place, the worst first."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = rows.distinct().withColumn("severity_rank", rank)
    return rows.orderBy(
        "severity_rank", "code", F.col("reference").asc_nulls_first(), F.col("line").asc_nulls_first(),
        F.col("column").asc_nulls_first(), "message",
    )


# --- Responses -------------------------------------------------------------------------------------------------


def _is_object(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), F.lit(False))


def normalize_responses(responses: DataFrame, retention: str = "on_incomplete") -> DataFrame:
    """Adds final_state, final_reason, raw and usage_error: a completed structured response that is no JSON object has failed.

    ``retention`` of the raw content: never, on_incomplete or always. ``usage_error`` of the counts that there are
    (input_tokens, output_tokens, total_tokens, input_bytes, output_bytes): negative, or total_mismatch where all
    three of tokens are known and don't add up; null if neither holds.
    """
    bad = (F.col("finish_state") == "completed") & (F.col("response_format") == "structured") & ~_is_object(F.col("content"))
    rows = responses.withColumns(
        {
            "final_state": F.when(bad, "failed").otherwise(F.col("finish_state")),
            "final_reason": F.when(bad, "malformed").otherwise(F.col("finish_reason")),
        }
    )
    count = lambda name: (F.col(name) if name in responses.columns else F.lit(None)).cast("long")
    below = F.lit(False)
    for name in ("input_tokens", "output_tokens", "total_tokens", "input_bytes", "output_bytes"):
        below = below | F.coalesce(count(name) < 0, F.lit(False))
    odd = count("input_tokens") + count("output_tokens") != count("total_tokens")
    rows = rows.withColumn("usage_error", F.when(below, "negative").when(odd, "total_mismatch"))
    keep = F.lit(retention == "always") | (F.lit(retention == "on_incomplete") & (F.col("final_state") != "completed"))
    return rows.withColumn("raw", F.when(keep, F.col("content")))


def validate_envelopes(
    envelopes: DataFrame, required: Sequence[str], kind: str, max_bytes: int, formats: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``code``, the first rule that an envelope (column ``content``) breaks; null if it is valid.

    The order: size, JSON object, required fields, type, patch format (a string of ``formats``, if given), empty summary, repeated affected files, affected files other
    than those of the changes.
    """
    schema = "struct<type:string,patch_format:string,summary:string,affected_files:array<string>,changes:array<struct<path:string,operation:string,destination_path:string,payload:string,change_id:string>>>"
    rows = envelopes.withColumns({"__o": _is_object(F.col("content")), "__e": F.from_json("content", schema)})
    missing = F.lit(False)
    for name in required:
        missing = missing | F.get_json_object("content", f"$.{name}").isNull()
    files, changes = F.coalesce("__e.affected_files", F.array().cast("array<string>")), F.coalesce(
        F.col("__e.changes"),
        F.array().cast("array<struct<path:string,operation:string,destination_path:string,payload:string,change_id:string>>"),
    )
    touched = F.array_compact(F.concat(F.transform(changes, lambda c: c["path"]), F.transform(changes, lambda c: c["destination_path"])))
    # A value that is no string isn't one of the formats, whatever it reads as.
    string = F.schema_of_variant(F.try_variant_get(F.try_parse_json("content"), "$.patch_format", "variant")) == "STRING"
    known = F.coalesce(string & F.col("__e.patch_format").isin(list(formats or [])), F.lit(False))
    unknown = F.lit(formats is not None) & ~known
    code = (
        F.when(F.octet_length("content") > max_bytes, "ENVELOPE_TOO_LARGE").when(~F.col("__o"), "ENVELOPE_MALFORMED").when(missing, "ENVELOPE_FIELD_MISSING").when(
            ~F.col("__e.type").eqNullSafe(F.lit(kind)), "ENVELOPE_TYPE_MISMATCH",
        )
        .when(unknown, "ENVELOPE_UNKNOWN_FORMAT")
        .when(F.trim(F.coalesce("__e.summary", F.lit(""))) == "", "ENVELOPE_EMPTY_TEXT").when(
            F.size(files) != F.size(F.array_distinct(files)), "ENVELOPE_DUPLICATE_FILE",
        )
        .when(F.array_sort(files) != F.array_sort(F.array_distinct(touched)), "ENVELOPE_FILES_MISMATCH")
    )
    return rows.withColumn("code", code).drop("__o", "__e")


def ground_findings(findings: DataFrame, references: DataFrame, retrieval: DataFrame) -> DataFrame:
    """(finding_id, code) of findings (finding_id, task_id, evidence array, coverage) that stand on nothing.

    No evidence, a reference not in the task's bundle (task_id, reference), or a claim of completeness on an
    incomplete retrieval (task_id, status).
    """
    none = findings.filter(
        F.size(F.coalesce("evidence", F.array().cast("array<string>"))) == 0
    ).select("finding_id", F.lit("FINDING_WITHOUT_EVIDENCE").alias("code"))
    cited = findings.select("finding_id", "task_id", F.explode("evidence").alias("reference")).distinct()
    unknown = cited.join(
        references.select("task_id", "reference").distinct(), ["task_id", "reference"], "left_anti",
    ).select("finding_id", F.lit("FINDING_UNKNOWN_REFERENCE").alias("code")).distinct()
    claims = findings.filter("coverage = 'complete'").join(
        retrieval.filter("status = 'incomplete'").select("task_id").distinct(), "task_id", "left_semi",
    ).select("finding_id", F.lit("FINDING_OVERCLAIMED").alias("code"))
    return none.unionByName(unknown).unionByName(claims)


# --- Changes ---------------------------------------------------------------------------------------------------


def parse_changes(envelopes: DataFrame) -> DataFrame:
    """(proposal_id, change_id, path, operation, destination_path, payload, error) of the changes in envelopes (proposal_id, content)."""
    schema = "struct<changes:array<struct<path:string,operation:string,destination_path:string,payload:string,change_id:string>>>"
    rows = envelopes.select("proposal_id", F.posexplode(F.from_json("content", schema)["changes"]).alias("n", "c")).select("proposal_id", "n", "c.*")
    made = F.concat(
        F.lit("change_"),
        F.substring(F.sha2(F.concat_ws("\n", F.col("n").cast("string"), "operation", "path", F.coalesce("destination_path", F.lit(""))), 256), 1, 16),
    )
    repeated = F.count(F.lit(1)).over(Window.partitionBy("proposal_id", "path")) > 1
    error = (
        F.when(F.col("path").isNull() | (F.trim("path") == ""), "path_missing").when(
            F.col("operation").isNull() | ~F.col("operation").isin(OPERATIONS), "operation_unknown",
        )
        .when((F.col("operation") == "rename") & F.col("destination_path").isNull(), "destination_missing").when(
            (F.col("operation") != "rename") & F.col("destination_path").isNotNull(), "destination_unexpected",
        )
        .when(
            F.col("operation").isin("create", "modify") & F.col("payload").isNull(), "payload_missing",
        ).when((F.col("operation") == "delete") & F.col("payload").isNotNull(), "payload_unexpected").when(repeated, "duplicate_path")
    )
    return rows.select(
        "proposal_id", F.coalesce("change_id", made).alias("change_id"), "path", "operation", "destination_path",
        "payload", error.alias("error"),
    )


#: The head of a hunk; the groups are the numbers of old and new lines, 1 where they aren't given.
HUNK = r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"


def _declared(group: int) -> Column:
    digits = F.nullif(F.regexp_extract("line", HUNK, group), F.lit(""))
    return F.coalesce(F.try_to_number(digits, F.lit("999999999")).cast("long"), F.lit(1))


def diff_lines(patches: DataFrame) -> DataFrame:
    """(patch_id, n, file, hunk, kind, line) of unified diffs (patch_id, patch).

    Kinds: old_file, new_file, hunk, context, add, remove, no_newline, other. ``file`` and ``hunk`` count headers so
    far. Within an unfinished hunk every line is content, one like ``--- `` too.

    What a line is depends on how many old and new lines its hunk still lacks. That state needs no walk over the lines:
    behind each head the old and the new lines so far are running sums, and up to the place where both reach what the head
    declares they count content only. Lines of one patch are sorted in one task, which can spill; each is moved once.
    """
    rows = patches.select("patch_id", F.posexplode(F.split("patch", "\n")).alias("n", "line"))
    rows = rows.withColumn("head", F.col("line").rlike(HUNK))
    order = Window.partitionBy("patch_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    first = F.substr("line", F.lit(1), F.lit(1))
    old, new = ~F.col("head") & ~first.isin("+", "\\"), ~F.col("head") & ~first.isin("-", "\\")
    upto = lambda flag: F.sum(flag.cast("long")).over(order)
    rows = rows.withColumns({"heads": upto(F.col("head")), "old_upto": upto(old), "new_upto": upto(new)})
    at_head = lambda value: F.max_by(F.when(F.col("head"), value), F.when(F.col("head"), F.col("n"))).over(order)
    state = F.struct(
        (F.col("old_upto") + _declared(1)).alias("old_end"), (F.col("new_upto") + _declared(2)).alias("new_end"),
    )
    rows = rows.withColumn("end", at_head(state))
    # Lines before this one: the sums without its own share.
    before = lambda total, own: F.col(total) - own.cast("long")
    lacking = (F.col("heads") > 0) & ~F.col("head") & ((before("old_upto", old) < F.col("end.old_end")) | (before("new_upto", new) < F.col("end.new_end")))
    surplus = F.col("heads") > 0  # lines behind a hunk that is complete make it inconsistent
    kind = (
        F.when(F.col("head"), "hunk").when(lacking & (first == "+"), "add").when(lacking & (first == "-"), "remove").when(first == "\\", "no_newline")
        .when(lacking, "context").when(F.col("line").startswith("--- "), "old_file").when(F.col("line").startswith("+++ "), "new_file")
        .when(surplus & (first == "+"), "add").when(surplus & (first == "-"), "remove").when(surplus & (first == " "), "context").otherwise("other")
    )
    rows = rows.withColumn("kind", kind)
    count = lambda name: F.sum((F.col("kind") == name).cast("int")).over(order)
    return rows.select("patch_id", "n", count("old_file").alias("file"), count("hunk").alias("hunk"), "kind", "line")


def diff_stats(lines: DataFrame) -> DataFrame:
    """(patch_id, file, old_path, new_path, operation, hunks, added, removed, consistent) per file of :func:`diff_lines`.

    ``consistent`` says that every hunk has as many old and new lines as its header declares.
    """
    is_kind = lambda kind: F.col("kind") == kind
    hunks = lines.filter("hunk > 0").groupBy("patch_id", "file", "hunk").agg(
        F.max(F.when(is_kind("hunk"), _declared(1))).alias("old"), F.max(F.when(is_kind("hunk"), _declared(2))).alias("new"),
        F.count_if(
            F.col("kind").isin("context", "remove")
        ).alias("has_old"), F.count_if(F.col("kind").isin("context", "add")).alias("has_new"), F.max(is_kind("hunk")).alias("own"),
    ).filter("own")
    good = hunks.groupBy("patch_id", "file").agg(
        F.bool_and((F.col("old") == F.col("has_old")) & (F.col("new") == F.col("has_new"))).alias("consistent")
    )
    path = lambda kind: F.max(F.when(is_kind(kind), F.regexp_replace(F.substr("line", F.lit(5)), r"^[ab]/", "")))
    files = lines.filter("file > 0").groupBy("patch_id", "file").agg(
        path("old_file").alias("old_path"), path("new_file").alias("new_path"),
        F.count_if(is_kind("hunk")).alias("hunks"), F.count_if(is_kind("add")).alias("added"),
        F.count_if(is_kind("remove")).alias("removed"),
    )
    operation = F.when(F.col("old_path") == "/dev/null", "create").when(F.col("new_path") == "/dev/null", "delete").otherwise("modify")
    return files.join(good, ["patch_id", "file"], "left").select(
        "patch_id", "file", "old_path", "new_path", operation.alias("operation"), "hunks", "added", "removed",
        F.coalesce("consistent", F.lit(True)).alias("consistent"),
    )


def audit_paths(changes: DataFrame, protected: Sequence[str] = PROTECTED) -> DataFrame:
    """(proposal_id, change_id, code) of changes with unsafe paths, or a destination that doesn't fit the operation."""
    device = lambda c: F.col(c).rlike(r"^(\\\\|//)|(?i)^(con|prn|aux|nul|com\d|lpt\d)(\.|$)")
    rows = normalize_paths(changes, "path").withColumnsRenamed({"canonical_path": "__p", "path_error": "__pe"})
    rows = normalize_paths(rows, "destination_path").withColumnsRenamed({"canonical_path": "__d", "path_error": "__de"})
    inside = lambda c: F.exists(F.array(*map(F.lit, protected)), lambda p: (F.col(c) == p) | F.startswith(F.col(c), F.concat(p, F.lit("/"))))
    rename = F.col("operation") == "rename"
    codes = F.array_compact(F.array(
        F.when(device("path") | device("destination_path"), "PATCH_PATH_UNSUPPORTED"),
        F.when(F.col("__pe").isNotNull() | (F.col("destination_path").isNotNull() & F.col("__de").isNotNull()), "PATCH_PATH_OUTSIDE_PROJECT"),
        F.when(inside("__p") | inside("__d"), "PATCH_PATH_PROTECTED"),
        F.when(rename & (F.col("destination_path").isNull() | F.col("__p").eqNullSafe(F.col("__d"))), "PATCH_PATH_INVALID_RENAME"),
        F.when(~rename & F.col("destination_path").isNotNull(), "PATCH_PATH_INVALID_RENAME"),
    ))
    return rows.select("proposal_id", "change_id", F.explode(codes).alias("code")).distinct()


def validate_operations(changes: DataFrame, source: DataFrame) -> DataFrame:
    """(proposal_id, change_id, code) against the files of the source state (path, fingerprint)."""
    files = source.select("path", F.col("fingerprint").alias("__f"), F.lit(True).alias("__has"))
    targets = source.select(F.col("path").alias("destination_path"), F.lit(True).alias("__taken"))
    rows = changes.join(files, "path", "left").join(targets, "destination_path", "left")
    expected = F.col("expected_old_fingerprint") if "expected_old_fingerprint" in changes.columns else F.lit(None)
    has = F.coalesce("__has", F.lit(False))
    codes = F.array_compact(F.array(
        F.when((F.col("operation") == "create") & has, "PATCH_CREATE_EXISTS"), F.when(
            (F.col("operation") != "create") & ~has, "PATCH_SOURCE_MISSING",
        ),
        F.when(
            (F.col("operation") == "rename") & F.coalesce("__taken", F.lit(False)), "PATCH_RENAME_TARGET_EXISTS",
        ), F.when(has & expected.isNotNull() & ~expected.eqNullSafe(F.col("__f")), "PATCH_OLD_FINGERPRINT_MISMATCH"),
    ))
    return rows.select("proposal_id", "change_id", F.explode(codes).alias("code"))


def detect_conflicts(changes: DataFrame) -> DataFrame:
    """(proposal_id, code, subject) of changes that contradict each other within a proposal."""
    ids = changes.groupBy("proposal_id", F.col("change_id").cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "proposal_id", F.lit("PATCH_CONFLICT_DUPLICATE_CHANGE_ID").alias("code"), "subject",
    )
    paths = changes.groupBy("proposal_id", F.col("path").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("operation").alias("kinds"),
    ).filter("n > 1")
    paths = paths.select(
        "proposal_id",
        F.when(F.col("kinds") == 1, "PATCH_CONFLICT_DUPLICATE_OPERATION").otherwise("PATCH_CONFLICT_INCOMPATIBLE_OPERATIONS").alias("code"),
        "subject",
    )
    renames = changes.filter("operation = 'rename'")
    targets = renames.groupBy("proposal_id", F.col("destination_path").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    shared = targets.filter("n > 1").select("proposal_id", F.lit("PATCH_CONFLICT_RENAME_DESTINATION").alias("code"), "subject")
    direct = changes.filter("operation <> 'rename'").select("proposal_id", F.col("path").alias("subject"), F.col("change_id")).join(
        targets.select("proposal_id", "subject"), ["proposal_id", "subject"], "left_semi",
    )
    direct = direct.join(
        renames.select("proposal_id", F.col("path").alias("subject")).distinct(), ["proposal_id", "subject"],
        "left_anti",
    ).select("proposal_id", F.lit("PATCH_CONFLICT_RENAME_DESTINATION").alias("code"), "subject")
    return ids.unionByName(paths).unionByName(shared).unionByName(direct)


def mismatched_evidence(changes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(proposal_id, code) where declared affected files or the project fingerprint (evidence) don't fit the changes."""
    touched = changes.select(
        "proposal_id", F.explode(F.array_compact(F.array("path", "destination_path"))).alias("path"),
    ).groupBy("proposal_id").agg(F.array_sort(F.collect_set("path")).alias("touched"))
    rows = evidence.join(touched, "proposal_id", "left")
    codes = F.array_compact(F.array(
        F.when(
            ~F.array_sort(F.array_distinct("affected_files")).eqNullSafe(F.coalesce("touched", F.array().cast("array<string>"))),
            "PATCH_CONSISTENCY_AFFECTED_FILES_MISMATCH",
        ),
        F.when(
            ~F.col("expected_project_fingerprint").eqNullSafe(F.col("source_project_fingerprint")),
            "PATCH_CONSISTENCY_PROJECT_FINGERPRINT_MISMATCH",
        ),
    ))
    return rows.select("proposal_id", F.explode(codes).alias("code"))


def rename_cycles(changes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(proposal_id, first_path, length) of every cycle of renames; of renames with one source the last counts.

    Each path has one successor, so nodes jump twice as far each round and keep the least path met: after
    log2(nodes) rounds a node that still has somewhere to go runs into a cycle; those that come back to themselves
    lie on it. Rounds end when the largest proposal is covered.
    """
    steps = changes.filter("operation = 'rename'").groupBy("proposal_id", "path").agg(F.max_by("destination_path", "change_id").alias("to"))
    steps = checkpointed(steps)
    size = steps.groupBy("proposal_id").count().agg(F.max("count")).first()[0] or 0
    jump = steps
    # Drop paths whose successor leads out of the renames, half as many steps each round.
    for _ in range(min(most_rounds, max(1, int(size).bit_length()))):
        beyond = jump.select("proposal_id", F.col("path").alias("to"), F.col("to").alias("further"))
        jump = checkpointed(jump.join(beyond, ["proposal_id", "to"]).select("proposal_id", "path", F.col("further").alias("to")))
    # By now every jump ends on a cycle: the paths reached are exactly those on cycles.
    on_cycle = jump.select("proposal_id", F.col("to").alias("path")).distinct()
    ring = checkpointed(steps.join(on_cycle, ["proposal_id", "path"]).select("proposal_id", "path", "to", F.col("path").alias("least")))
    for _ in range(min(most_rounds, max(1, int(size).bit_length()))):
        ahead = ring.select("proposal_id", F.col("path").alias("to"), F.col("to").alias("further"), F.col("least").alias("other"))
        ring = checkpointed(
            ring.join(ahead, ["proposal_id", "to"]).select(
                "proposal_id", "path", F.col("further").alias("to"), F.least("least", "other").alias("least"),
            )
        )
    return ring.groupBy("proposal_id", F.col("least").alias("first_path")).agg(F.count(F.lit(1)).alias("length"))


def proposal_verdicts(changes: DataFrame, source: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(proposal_id, valid, codes): a proposal is valid if no audit of paths, operations, conflicts or cycles objects.

    With ``evidence`` (:func:`mismatched_evidence`), declared files and fingerprints have to fit too.
    """
    codes = audit_paths(changes).select("proposal_id", "code").unionByName(validate_operations(changes, source).select("proposal_id", "code"))
    codes = codes.unionByName(detect_conflicts(changes).select("proposal_id", "code")).unionByName(
        rename_cycles(changes).select("proposal_id", F.lit("PATCH_CONFLICT_RENAME_CYCLE").alias("code"))
    )
    if evidence is not None:
        codes = codes.unionByName(mismatched_evidence(changes, evidence))
    listed = codes.distinct().groupBy("proposal_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return changes.select("proposal_id").distinct().join(listed, "proposal_id", "left").select(
        "proposal_id", F.col("codes").isNull().alias("valid"), F.coalesce("codes", F.lit("")).alias("codes"),
    )


def review_changes(changes: DataFrame) -> DataFrame:
    """Operation counts, affected files, and added and removed lines per proposal (changes with payload).

    Lines count by their marks (not those of file headers); a payload without marks is all added.
    """
    lines = F.split(F.coalesce("payload", F.lit("")), "\n")
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    removed = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    unmarked = (added == 0) & (removed == 0) & (F.coalesce("payload", F.lit("")) != "")
    rows = changes.withColumns({"__a": F.when(unmarked, F.size(lines)).otherwise(added), "__r": removed})
    count = lambda op: F.count_if(F.col("operation") == op).alias(f"{op}s")
    files = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array("path", "destination_path")))))), ",")
    return rows.groupBy("proposal_id").agg(
        *(count(op) for op in OPERATIONS), F.sum("__a").alias("added_lines"), F.sum("__r").alias("removed_lines"),
        files.alias("affected_files"),
    )


def fingerprint_proposals(changes: DataFrame) -> DataFrame:
    """(proposal_id, proposal_fingerprint) over the changes of a proposal as canonical JSON, in the order of path and id."""
    item = F.to_json(F.struct(F.col("change_id").cast("string").alias("change_id"), "destination_path", "operation", "path"))
    listed = changes.groupBy("proposal_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "change_id", item.alias("j")))), lambda s: s["j"]), ",").alias("j")
    )
    payload = F.concat(F.lit('{"proposal_id":"'), F.col("proposal_id").cast("string"), F.lit('","changes":['), F.col("j"), F.lit("]}"))
    return listed.select("proposal_id", F.concat(F.lit("proposal_sha256_"), F.sha2(payload, 256)).alias("proposal_fingerprint"))


def revalidate_proposals(
    stored: DataFrame, changes: DataFrame, source: DataFrame, projects: DataFrame, writable: DataFrame | None = None,
) -> DataFrame:
    """(proposal_id, code) before use: stored fingerprints against those of now, paths and operations again.

    ``stored`` has proposal_id, project_id, proposal_fingerprint and project_fingerprint; ``projects`` the current
    project_fingerprint of each project_id. A project that is no longer known has changed.
    """
    now = fingerprint_proposals(changes).withColumnRenamed("proposal_fingerprint", "__now")
    current = projects.select("project_id", F.col("project_fingerprint").alias("__project"))
    rows = stored.join(now, "proposal_id", "left").join(current, "project_id", "left")
    codes = F.array_compact(
        F.array(
            F.when(~F.col("proposal_fingerprint").eqNullSafe(F.col("__now")), "PROPOSAL_CHANGED"),
            F.when(~F.col("project_fingerprint").eqNullSafe(F.col("__project")), "PROJECT_CHANGED"),
        )
    )
    out = rows.select("proposal_id", F.explode(codes).alias("code")).unionByName(audit_paths(changes).select("proposal_id", "code")).unionByName(
        validate_operations(changes, source).select("proposal_id", "code")
    )
    if writable is not None:
        outside = changes.select(
            "proposal_id", F.explode(F.array_compact(F.array("path", "destination_path"))).alias("path"),
        ).join(writable.select("path").distinct(), "path", "left_anti")
        out = out.unionByName(outside.select("proposal_id", F.lit("PATH_NOT_WRITABLE").alias("code")))
    return out.distinct()


# --- Executions ------------------------------------------------------------------------------------------------


def latest_executions(executions: DataFrame, key: str = "task_id") -> DataFrame:
    """The newest execution of each key (by saved_at, then id)."""
    newest = F.max_by(F.struct(*executions.columns), F.struct("saved_at", "execution_id")).alias("e")
    return executions.groupBy(F.col(key).alias("__k")).agg(newest).select("e.*")


def list_executions(executions: DataFrame) -> DataFrame:
    """Executions with ``place``, the newest of a project first."""
    order = Window.partitionBy("project_id").orderBy(F.desc("saved_at"), F.desc("execution_id"))
    return executions.withColumn("place", F.row_number().over(order))


def recovery_disposition(executions: DataFrame) -> DataFrame:
    """Adds ``disposition``: terminal, awaiting_action, resumable (stopped or paused before a change was applied) or manual_review."""
    status = F.col("status")
    disposition = F.when(status.isin(TERMINAL), "terminal").when(status == "awaiting_approval", "awaiting_action").when(
        status.isin("paused", "interrupted") & ~F.col("stage").isin("apply", "validate"), "resumable",
    ).otherwise("manual_review")
    return executions.withColumn("disposition", disposition)


def check_stage_history(executions: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Adds ``history_error``: completed stages must be the first of the order, and fit the stage and status."""
    done = F.col("completed_stages")
    prefix = F.slice(F.array(*map(F.lit, stages)), 1, F.size(done))
    at = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    error = (
        F.when(at == 0, "unknown_stage").when(~prefix.eqNullSafe(done), "not_a_prefix").when(
            (F.col("status") == "completed") & (F.size(done) != len(stages)), "completed_too_early",
        )
        .when((F.col("status") != "completed") & ~F.size(done).isin(0) & ((at < F.size(done)) | (at > F.size(done) + 1)), "stage_out_of_step")
    )
    return executions.withColumn("history_error", error)
