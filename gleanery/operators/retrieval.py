"""Retrieval: candidates by references, words, structure and dependencies; scoring and selection."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import TextIndex, candidates, containing, marked_texts, text_index, token_key, verified
from ..functions.sets import in_blocks
from ..functions.shared import checkpointed, written
from ..functions.text import TOKEN, fold, quoted, token_estimate
from .budget import SIZES, USAGE, folded, greedy

# ---------------------------------------------------------------------------------------------------------------
# Weights of edges, score components and candidate types; reasons; words of current and past behaviour.
EDGE_WEIGHTS = {
    "imports": 0.95, "depends_on": 1.0, "extends": 0.9, "implements": 0.9, "calls": 0.8, "references": 0.7,
    "configures": 0.85, "tests": 0.8, "documents": 0.6,
}
SCORE_WEIGHTS = {
    "explicit_reference": 1.0, "path_match": 0.9, "symbol_match": 0.9, "lexical_relevance": 0.7, "structural_relevance": 0.7,
    "dependency_distance": 0.6, "artifact_priority": 0.4, "sensitivity_penalty": 1.0, "generated_penalty": 0.5,
}
COMPONENTS = list(SCORE_WEIGHTS)
PENALTIES = ["sensitivity_penalty", "generated_penalty"]
TYPE_PRIORITY = {
    "full_artifact": 1.0, "symbol_definition": 0.95, "structural_unit": 0.9, "source_excerpt": 0.85,
    "test_artifact": 0.75, "configuration_block": 0.8, "manifest_section": 0.75, "documentation_section": 0.6,
}
MANDATORY_REASONS = [
    "explicit_path_reference", "explicit_symbol_reference", "error_location_reference", "exact_path_match",
    "exact_symbol_match", "required_context", "user_provided_context",
]
CURRENT_TERMS = ["active", "current", "production", "runtime"]
HISTORICAL_MARKS = ["archive", "deprecated", "historical", "legacy"]
BROAD_TERMS = ["codebase", "project", "repository"]
BOOST_KINDS = ["calls", "configures", "depends_on", "imports", "references"]
CLOSURE_KINDS = ["imports", "depends_on", "extends", "implements", "configures"]
# ---------------------------------------------------------------------------------------------------------------

# --- Explicit references ---------------------------------------------------------------------------------------


def resolve_explicit(terms: DataFrame, artifacts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, kind, reference, outcome, matches, target) of path, filename and symbol terms.

    A path is found as written, else by folding; a file name by the folded last segment, unless a path of the task ends
    with it; a symbol by folded name or qualified name, unless it looks like a file. One match is selected, several
    are ambiguous (deferred), none is not_found. ``target`` is the artifact_id or symbol_id, null unless selected.
    Matches are counted per name before terms are joined to them.
    """
    named = terms.filter(F.col("kind").isin("path", "filename", "symbol")).select(
        "task_id", "kind", F.col("original").alias("reference"), F.col("normalized").alias("key"),
    )
    tails = named.filter("kind = 'path'").select(
        "task_id", F.lit("filename").alias("kind"), F.element_at(F.split("key", "/"), -1).alias("key"),
    ).distinct()
    files = artifacts.select("artifact_id", "path", fold(F.col("path")).alias("folded"))
    named = named.join(tails, ["task_id", "kind", "key"], "left_anti")
    named = named.filter(~((F.col("kind") == "symbol") & F.col("key").rlike(r"(/|\.(py|md|toml|json|js|ts|txt|ya?ml|cfg|ini)$)")))
    keyed = symbols.select("symbol_id", F.explode(F.array_distinct(F.array(fold(F.col("name")), fold(F.col("qualified_name"))))).alias("key"))

    def counted(rows: DataFrame, target: str, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.countDistinct(target).alias("matches"), F.min(target).alias("target"))

    # One row per key on the right, counted before the join, so that a name that many files share doesn't fan out.
    last = F.element_at(F.split("folded", "/"), -1)
    known = counted(files.withColumn("key", F.col("folded")), "artifact_id", "key").withColumn("kind", F.lit("path"))
    known = known.unionByName(counted(files.withColumn("key", last), "artifact_id", "key").withColumn("kind", F.lit("filename")))
    known = known.unionByName(counted(keyed, "symbol_id", "key").withColumn("kind", F.lit("symbol")))
    exact = counted(files.withColumn("reference", F.col("path")), "artifact_id", "reference").withColumn("kind", F.lit("path"))
    exact = exact.select("kind", "reference", F.struct("matches", "target").alias("exact"))
    found = named.join(known, ["kind", "key"]).join(exact, ["kind", "reference"], "left")
    found = found.select("task_id", "kind", "reference", F.coalesce("exact", F.struct("matches", "target")).alias("m")).distinct()
    out = named.select("task_id", "kind", "reference").distinct().join(found, ["task_id", "kind", "reference"], "left")
    matches = F.coalesce("m.matches", F.lit(0))
    outcome = F.when(matches == 0, "not_found").when(matches == 1, "selected").otherwise("ambiguous")
    return out.select(
        "task_id", "kind", "reference", outcome.alias("outcome"), matches.alias("matches"),
        F.when(matches == 1, F.col("m.target")).alias("target"),
    )


# --- Lexical ranking -------------------------------------------------------------------------------------------


#: What a quoted phrase, a term in the path and the frequency add to a score at most.
PHRASE, PATH, FREQUENCY = 0.25, 0.15, 0.25


def _first(rows: DataFrame, k: int | None) -> DataFrame:
    """Ranked by score and unit within each task; with ``k`` only so many, cut in each task of Spark before they are shuffled."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "unit_id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def lexical_rank(tasks: DataFrame, units: DataFrame, k: int | None = None, index: TextIndex | None = None) -> DataFrame:
    """(task_id, unit_id, score, rank): units by overlap of terms, frequency, quoted phrases and path; the first ``k`` of a task.

    score = overlap + 0.25 min(frequency, 1) + 0.25 phrase + 0.15 path, to 8 digits; overlap is the share of the
    task's distinct terms among the unit's tokens (a term of several words is no token, but counts in the share).
    Tasks have task_id, terms (folded, distinct) and task_text; units have unit_id, path, text. Ties go by unit_id.

    Overlap and frequency come from the index of the units' tokens alone (``index``, of their folded texts, if there is one
    already), without tokens that no task asks for. With ``k``, the k-th best of these sums bounds what can
    still come in: phrase and path add 0.40 at most, so units further below it meet neither phrases, paths nor a rank. The bound is a
    top-k that merges partial ones; units without any token of a task are looked at only where 0.40 reaches it.
    """
    texts = units.select(F.col("unit_id").alias("id"), fold(F.col("text")).alias("text"))
    index = index or text_index(texts)
    keys = ["task_id", "unit_id"]
    asked = tasks.select("task_id", F.size("terms").alias("n_terms"), F.explode(F.array_distinct("terms")).alias("term"))
    keyed = asked.select("task_id", "n_terms", token_key(F.col("term")).alias("token"))
    tf = index.occurrences.select("id", "n_tokens", "token").join(keyed.select("token").distinct(), "token", "left_semi")
    tf = tf.groupBy("id", "n_tokens", "token").agg(F.count(F.lit(1)).alias("tf"))
    hits = tf.join(keyed, "token").groupBy("task_id", F.col("id").alias("unit_id"), "n_terms", "n_tokens").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("occurrences"),
    )
    frequency = F.col("occurrences") / F.greatest("n_tokens", F.lit(1))
    base = F.col("matched") / F.col("n_terms") + F.least(frequency, F.lit(1.0)) * FREQUENCY
    hits = written(hits.select(*keys, base.alias("base")))
    others = None  # tasks whose first k may hold units without any of their tokens
    if k is not None:
        edge = _first(hits.withColumnRenamed("base", "score"), k).filter(F.col("rank") == k).select("task_id", (F.col("score") - PHRASE - PATH - 1e-6).alias("edge"))
        edge = written(edge)
        hits = hits.join(edge, "task_id", "left").filter(F.col("edge").isNull() | (F.col("base") >= F.col("edge"))).drop("edge")
        hits = written(hits)
        others = tasks.select("task_id").join(edge.filter("edge > 0"), "task_id", "left_anti")

    def wanted(found: DataFrame) -> DataFrame:
        """Of rows with task_id and unit_id: those that the bound leaves."""
        if others is None:
            return found
        marked = found.join(hits.select(*keys, F.lit(True).alias("__hit")), keys, "left").join(others.withColumn("__open", F.lit(True)), "task_id", "left")
        return marked.filter(F.coalesce("__hit", "__open", F.lit(False))).drop("__hit", "__open")

    places = written(units.select("unit_id", "path"))
    paths = places.select("path").distinct().select(F.col("path").alias("id"), fold(F.col("path")).alias("text"))
    by_path = containing(paths, asked.select(F.col("term").alias("phrase")).distinct())
    by_path = by_path.select(F.col("id").alias("path"), F.col("phrase").alias("term")).join(asked, "term").select("task_id", "path").distinct()
    if others is None:
        by_path = by_path.join(places, "path").select(*keys)
    else:
        some = hits.select(*keys).join(places, "unit_id").join(by_path, ["task_id", "path"], "left_semi").select(*keys)
        by_path = some.unionByName(by_path.join(others, "task_id", "left_semi").join(places, "path").select(*keys)).distinct()
    phrases = tasks.select("task_id", F.explode(F.transform(quoted(F.col("task_text")), fold)).alias("phrase"))
    spoken = phrases.filter(F.col("phrase").rlike(TOKEN))
    # Where every task has its k-th best, only the units that are left are searched.
    some = hits.select(F.col("unit_id").alias("id")).distinct() if others is not None and others.isEmpty() else None
    maybe = wanted(candidates(index, spoken, some).join(phrases, "phrase").select("task_id", F.col("id").alias("unit_id"), "phrase", "sure"))
    by_phrase = verified(maybe.withColumnRenamed("unit_id", "id"), texts).select("task_id", F.col("id").alias("unit_id"))
    marks = phrases.filter(~F.col("phrase").rlike(TOKEN)).select("phrase")
    by_mark = marked_texts(texts, marks).join(phrases, "phrase").select("task_id", F.col("id").alias("unit_id"))
    by_phrase = by_phrase.unionByName(wanted(by_mark)).distinct()
    found = hits.join(by_path.withColumn("in_path", F.lit(True)), keys, "full_outer").join(by_phrase.withColumn("in_phrase", F.lit(True)), keys, "full_outer")
    score = F.coalesce("base", F.lit(0.0)) + F.when(F.col("in_phrase"), PHRASE).otherwise(0.0) + F.when(F.col("in_path"), PATH).otherwise(0.0)
    return _first(found.select(*keys, F.round(score, 8).alias("score")), k)


# --- Structure -------------------------------------------------------------------------------------------------


def structural_candidates(roots: DataFrame, symbols: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, unit_id, role, weight, seq) from the symbols that tasks name (task_id, name).

    The units of a root symbol are definitions (weight 1.0); those of all symbols above it scope, and the units of edges
    of kind imports out of any of them imports (0.8). The first role of a unit stays, in the order definition, scope,
    imports; ``seq`` numbers a task's units by role, place and id. Units have unit_id, ord and symbol_ids.
    """
    by_name = symbols.select(fold(F.col("name")).alias("key"), F.col("symbol_id"), F.col("parent_symbol_id"))
    front = roots.select(
        "task_id", fold(F.col("name")).alias("key"),
    ).join(by_name, "key").select("task_id", "symbol_id", "parent_symbol_id").distinct()
    chain = front.select("task_id", "symbol_id", F.lit(0).alias("role"))
    parents = symbols.select(F.col("symbol_id"), F.col("parent_symbol_id"))
    while True:
        up = front.filter("parent_symbol_id is not null").select("task_id", F.col("parent_symbol_id").alias("symbol_id")).distinct()
        front = checkpointed(
            up.join(chain, ["task_id", "symbol_id"], "left_anti").join(parents, "symbol_id").select("task_id", "symbol_id", "parent_symbol_id")
        )
        if front.isEmpty():
            break
        chain = chain.unionByName(front.select("task_id", "symbol_id", F.lit(1).alias("role")))
    imported = edges.filter("kind = 'imports'").select(F.col("source_reference").alias("symbol_id"), F.col("unit_id"))
    held = units.select("unit_id", F.explode("symbol_ids").alias("symbol_id"))
    rows = chain.join(held, "symbol_id").select("task_id", "unit_id", "role").unionByName(
        chain.join(imported, "symbol_id").select("task_id", "unit_id", F.lit(2).alias("role"))
    )
    best = rows.groupBy("task_id", "unit_id").agg(F.min("role").alias("r")).join(units.select("unit_id", "ord"), "unit_id")
    seq = F.row_number().over(Window.partitionBy("task_id").orderBy("r", "ord", "unit_id"))
    role = F.get(F.array(F.lit("definition"), F.lit("scope"), F.lit("imports")), F.col("r"))
    return best.select("task_id", "unit_id", role.alias("role"), F.when(F.col("r") == 0, 1.0).otherwise(0.8).alias("weight"), seq.alias("seq"))


def _usable(edges: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    return edges.filter((F.col("resolution") == "resolved_internal") & F.col("kind").isin(list(weights)))


def _walk(seeds: DataFrame, edges: DataFrame, max_depth: int, max_fan_out: int, decay: float, weights: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    """The seeds, and the first visit of every node behind them: task_id, node, seed, trail, total, path, kind, depth.

    ``trail`` orders nodes of a depth as a queue would: by the trail of what led there, then the edge's place.
    """
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    place = F.row_number().over(Window.partitionBy("source_reference").orderBy("kind", "target_reference", "relationship_id"))
    out = _usable(edges, weights).withColumn("place", place).filter(F.col("place") <= max_fan_out).select(
        "source_reference", "target_reference", "kind", "place", weight[F.col("kind")].alias("edge_weight"),
    )
    start = seeds.groupBy("task_id", "reference").agg(F.min("pos").alias("pos"))
    start = start.select("task_id", F.col("reference").alias("node"), F.array(F.col("pos").cast("int")).alias("trail"))
    front = start.select("task_id", "node", F.col("node").alias("seed"), "trail", F.lit(1.0).alias("total"), F.array("node").alias("path"))
    visited = start.select("task_id", "node")
    found = None
    for depth in range(max_depth):
        step = front.join(out, F.col("node") == F.col("source_reference"))
        total = F.round(F.col("total") * F.col("edge_weight") * (decay if depth else 1.0), 8)
        step = step.select(
            "task_id", F.col("target_reference").alias("node"), "seed",
            F.concat("trail", F.array("place")).alias("trail"), total.alias("total"),
            F.concat("path", F.array("target_reference")).alias("path"), "kind",
        )
        step = step.join(visited, ["task_id", "node"], "left_anti")
        firsts = step.groupBy("task_id", "node").agg(
            F.min_by(F.struct("seed", "trail", "total", "path", "kind"), "trail").alias("s")
        ).select("task_id", "node", "s.*")
        firsts = checkpointed(firsts.withColumn("depth", F.lit(depth + 1)))
        found = firsts if found is None else found.unionByName(firsts)
        visited = visited.unionByName(firsts.select("task_id", "node"))
        front = firsts.drop("kind", "depth")
    return start, found


def _numbered(found: DataFrame, entities: DataFrame, max_candidates: int) -> DataFrame:
    known = found.join(entities.select(F.col("reference").alias("node")).distinct(), "node", "left_semi")
    order = Window.partitionBy("task_id").orderBy("depth", "trail")
    return known.withColumn("seq", F.row_number().over(order)).filter(F.col("seq") <= max_candidates)


def dependency_traversal(
    seeds: DataFrame, edges: DataFrame, entities: DataFrame, max_depth: int = 2, max_candidates: int = 50, max_fan_out: int = 20, decay: float = 0.8, weights: Mapping[str, float] = EDGE_WEIGHTS
) -> DataFrame:
    """(task_id, target, seed, depth, kind, weight, path, seq): what resolved edges reach from the seeds (task_id, reference, pos).

    Breadth first with all seeds of a task sharing what was visited. The edges of a node come by kind, target and id, and
    ``max_fan_out`` of them count, whether their targets were visited or not. The weight of a step is the edge's, times
    ``decay`` behind the first step, times what led there, to 8 digits. Only targets in ``entities`` (reference)
    are returned, the first ``max_candidates`` of a task; others are walked through.

    A hop is a join of the frontier with the pruned edges and a first-visit aggregate; no row is looped over. The
    fan-out limit is applied to the edges before any join, so a hub costs no more than its limit.
    """
    ranked = _numbered(_walk(seeds, edges, max_depth, max_fan_out, decay, weights)[1], entities, max_candidates)
    return ranked.select(
        "task_id", F.col("node").alias("target"), "seed", "depth", "kind", F.col("total").alias("weight"),
        F.array_join("path", ">").alias("path"), "seq",
    )


def traversal_limits(
    seeds: DataFrame, edges: DataFrame, entities: DataFrame, max_depth: int = 2, max_candidates: int = 50, max_fan_out: int = 20, weights: Mapping[str, float] = EDGE_WEIGHTS
) -> DataFrame:
    """(task_id, depth_limited, fan_out_limited, candidate_limited, codes): which limits cut a task's traversal short.

    A queue of nodes in the order of their visits ends at the parent of the last candidate allowed, or with its last node. Of
    the nodes it comes to, one at ``max_depth`` with edges is a depth limit, one above with more than ``max_fan_out`` edges
    a fan-out limit; nodes that wait when the last candidate is found are a candidate limit. ``codes`` are
    RETRIEVAL_RELATIONSHIP_LIMIT (depth or candidates) and RETRIEVAL_HIGH_FAN_OUT. Each task of the seeds has a row.
    """
    start, found = _walk(seeds, edges, max_depth, max_fan_out, 1.0, weights)
    degree = _usable(edges, weights).groupBy(F.col("source_reference").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
    place = F.struct("depth", "trail")
    last = _numbered(found, entities, max_candidates).filter(F.col("seq") == max_candidates).select(
        "task_id", place.alias("last"), F.struct((F.col("depth") - 1).alias("depth"), F.slice("trail", F.lit(1), F.size("trail") - 1).alias("trail")).alias("parent"),
    )
    nodes = start.withColumn("depth", F.lit(0)).unionByName(found.select("task_id", "node", "trail", "depth"))
    nodes = nodes.withColumn("at", place).join(degree, "node", "left").join(last, "task_id", "left")
    ended, many = F.col("last").isNotNull(), F.coalesce("edges", F.lit(0))
    flags = nodes.groupBy("task_id").agg(
        F.bool_or(~ended & (F.col("depth") == max_depth) & (many > 0)).alias("depth_limited"),
        F.bool_or((~ended | (F.col("at") <= F.col("parent"))) & (F.col("depth") < max_depth) & (many > max_fan_out)).alias("fan_out_limited"),
        F.coalesce(F.bool_or(ended & (F.col("at") > F.col("parent")) & (F.col("at") < F.col("last"))), F.lit(False)).alias("candidate_limited"),
    )
    codes = F.array_compact(
        F.array(F.when(F.col("depth_limited") | F.col("candidate_limited"), "RETRIEVAL_RELATIONSHIP_LIMIT"), F.when(F.col("fan_out_limited"), "RETRIEVAL_HIGH_FAN_OUT"))
    )
    return flags.withColumn("codes", codes)


def dependency_closure(
    primary: DataFrame, traversal: DataFrame, eligible: DataFrame, max_additions: int = 20, least_weight: float = 0.5,
) -> DataFrame:
    """(task_id, target, weight, place, outcome): dependencies that the selected items cannot do without.

    ``primary`` holds (task_id, reference) of what is selected. Kept are targets whose last edge is of a structural kind,
    with enough weight, from a selected seed, and not selected themselves. Ineligible ones (not in ``eligible``) and
    those beyond ``max_additions`` leave the closure incomplete; the rest are mandatory.
    """
    rows = traversal.filter(F.col("kind").isin(CLOSURE_KINDS) & (F.col("weight") >= least_weight))
    rows = rows.join(primary.select("task_id", F.col("reference").alias("seed")).distinct(), ["task_id", "seed"], "left_semi")
    rows = rows.join(primary.select("task_id", F.col("reference").alias("target")).distinct(), ["task_id", "target"], "left_anti")
    rows = rows.join(
        eligible.select(F.col("reference").alias("target"), F.lit(True).alias("ok")).distinct(), "target", "left",
    ).withColumn("ok", F.coalesce("ok", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("task_id", "ok").orderBy(F.desc("weight"), "target"))
    outcome = F.when(~F.col("ok"), "ineligible").when(F.col("place") > max_additions, "over_limit").otherwise("mandatory")
    return rows.withColumn("place", place).select("task_id", "target", "weight", "place", outcome.alias("outcome"))


# --- Eligibility and scores ------------------------------------------------------------------------------------


def filter_eligibility(
    candidates: DataFrame, indexed: DataFrame, records: DataFrame, allow_sensitive: bool = False,
    generated: str = "deprioritize",
) -> DataFrame:
    """Adds eligibility and reason, and evidence of a penalty for generated files.

    ``indexed`` has artifact_id; ``records`` artifact_id, classifications, availability. ``generated`` is keep,
    deprioritize or exclude.
    """
    rows = candidates.join(indexed.select("artifact_id", F.lit(True).alias("__indexed")).distinct(), "artifact_id", "left")
    rows = rows.join(
        records.select("artifact_id", F.col("classifications").alias("__labels"), F.col("availability").alias("__state")),
        "artifact_id", "left",
    )
    has = lambda label: F.coalesce(F.array_contains("__labels", label), F.lit(False))
    reason = (
        F.when(F.col("__indexed").isNull(), "unavailable:not_indexed").when(F.col("__labels").isNull(), "eligible:no_record").when(
            has("sensitive") & ~F.lit(allow_sensitive), "prohibited:sensitive",
        )
        .when(has("binary"), "unavailable:binary").when(
            F.coalesce(F.col("__state"), F.lit("available")) != "available",
            F.concat(F.lit("unavailable:"), F.col("__state")),
        )
        .when(has("generated") & (F.lit(generated) == "exclude"), "ineligible:generated").when(
            has("generated") & (F.lit(generated) == "deprioritize"), "eligible:generated_penalty",
        ).otherwise("eligible:clean")
    )
    rows = rows.withColumn("__reason", F.split(reason, ":"))
    penalty = F.array(
        F.struct(
            F.lit("generated-penalty").alias("type"), F.lit("eligibility").alias("source"),
            F.lit("Generated file.").alias("detail"), F.lit(1.0).alias("weight"),
        )
    )
    evidence = F.when(F.col("__reason")[1] == "generated_penalty", F.concat("evidence", penalty)).otherwise(F.col("evidence"))
    return rows.withColumns(
        {"eligibility": F.col("__reason")[0], "eligibility_reason": F.col("__reason")[1], "evidence": evidence}
    ).drop("__indexed", "__labels", "__state", "__reason")


def component_of(evidence_type: Column) -> Column:
    """Score component of an evidence type, by the first rule that holds: "path" comes before "dependency"."""
    v = F.lower(evidence_type)
    return (
        F.when(
            v.startswith("explicit-"), "explicit_reference",
        ).when(v.contains("path"), "path_match").when(v.contains("symbol"), "symbol_match").when(v.contains("lexical"), "lexical_relevance")
        .when(v.contains("structural"), "structural_relevance").when(
            v.contains("dependency") | v.contains("relationship"), "dependency_distance",
        ).when(v.contains("generated"), "generated_penalty")
        .when(v.contains("sensitive") | v.contains("security"), "sensitivity_penalty")
    )


def score_candidates(candidates: DataFrame, weights: Mapping[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """(task_id, candidate_id, raw_score, normalized_score, rank) of candidates with type, evidence, reason and eligibility.

    A component is the largest weight of its evidence, between 0 and 1; reasons set some to 1; penalties are
    subtracted. Raw scores are scaled to the least and largest of the task, which are aggregated first.
    """
    each = F.filter(
        F.transform(
            "evidence", lambda e: F.struct(
                component_of(e["type"]).alias("c"),
                F.least(F.greatest(F.coalesce(e["weight"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("v"),
            )
        ), lambda e: e["c"].isNotNull()
    )
    rows = candidates.withColumn("__e", each)
    top = lambda name: F.coalesce(F.array_max(F.transform(F.filter("__e", lambda e: e["c"] == name), lambda e: e["v"])), F.lit(0.0))
    priority = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TYPE_PRIORITY.items() for x in pair)), F.col("type")), F.lit(0.5))
    reason = F.coalesce("reason", F.lit(""))
    value = {name: top(name) for name in COMPONENTS}
    value["explicit_reference"] = F.when(
        reason.isin("explicit_path_reference", "explicit_symbol_reference"), 1.0,
    ).otherwise(value["explicit_reference"])
    value["path_match"] = F.when(reason.isin("exact_path_match", "partial_path_match"), 1.0).otherwise(value["path_match"])
    value["symbol_match"] = F.when(reason == "exact_symbol_match", 1.0).otherwise(value["symbol_match"])
    value["artifact_priority"] = priority
    value["sensitivity_penalty"] = F.when(
        (F.col("eligibility") == "prohibited") | (reason == "security_prohibited"), 1.0,
    ).otherwise(value["sensitivity_penalty"])
    raw = F.lit(0.0)
    for name in COMPONENTS:
        raw = raw + value[name] * (-weights[name] if name in PENALTIES else weights[name])
    rows = rows.select("task_id", "candidate_id", F.round(raw, 8).alias("raw_score"))
    ends = rows.groupBy("task_id").agg(F.min("raw_score").alias("low"), F.max("raw_score").alias("high"))
    rows = rows.join(ends, "task_id")
    scaled = F.when(F.col("high") == F.col("low"), F.when(F.col("raw_score") > 0, 1.0).otherwise(0.0)).otherwise(
        F.round(F.try_divide(F.col("raw_score") - F.col("low"), F.col("high") - F.col("low")), 8)
    )
    rows = rows.select("task_id", "candidate_id", "raw_score", scaled.alias("normalized_score"))
    return rows.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("normalized_score"), F.desc("raw_score"), "candidate_id")),
    )


def _openly(candidates: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with rank, ``mandatory`` and ``open``; and those that are open, as :func:`folded` takes them."""
    characters = F.coalesce("characters", "bytes") if "characters" in candidates.columns else F.col("bytes")
    rows = candidates.join(scores.select("task_id", "candidate_id", "rank"), ["task_id", "candidate_id"])
    rows = rows.withColumns(
        {
            "mandatory": F.coalesce(F.col("reason").isin(MANDATORY_REASONS), F.lit(False)),
            "open": (F.col("eligibility") == "eligible") & ~F.coalesce("deferred", F.lit(False)),
        }
    )
    tried = rows.filter("open").select(
        "task_id", F.struct((~F.col("mandatory")).alias("later"), "rank").alias("pos"), "candidate_id", "artifact_id",
        F.col("bytes").cast("long").alias("bytes"), characters.cast("long").alias("characters"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        (F.col("type") != "full_artifact").alias("is_excerpt"),
    )
    return rows, tried


def _selection(rows: DataFrame, taken: DataFrame) -> DataFrame:
    out = rows.join(taken.filter("candidate_id is not null").select("task_id", "candidate_id", "selected_rank"), ["task_id", "candidate_id"], "left")
    outcome = F.when(
        ~F.col("open"), F.when(F.col("eligibility") != "eligible", F.col("eligibility")).otherwise("deferred"),
    ).when(F.col("selected_rank").isNotNull(), "selected").otherwise("budget_exceeded")
    return out.select("task_id", "candidate_id", outcome.alias("outcome"), "selected_rank", "mandatory")


def select_under_budget(candidates: DataFrame, scores: DataFrame, budgets: DataFrame, reserved: dict[str, int] | None = None) -> DataFrame:
    """(task_id, candidate_id, outcome, selected_rank, mandatory): mandatory candidates first, then by rank, under all limits.

    Ineligible and deferred candidates pass through. Candidates have artifact_id, type, reason, eligibility, deferred,
    bytes, tokens and (perhaps) characters.
    """
    rows, tried = _openly(candidates, scores)
    return _selection(rows, folded(tried, budgets, reserved))


def plan_under_budget(
    candidates: DataFrame, scores: DataFrame, budgets: DataFrame, reserved: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The selection of :func:`select_under_budget`, and a row for each task of ``budgets``, from one pass over the candidates.

    The latter: task_id, what is used (tokens, characters, bytes, items, artifacts, excerpts; reserved capacity doesn't
    count), reservation_overflow (more is reserved than the budget has), mandatory_overflow (a mandatory candidate that
    is eligible didn't fit) and code, RETRIEVAL_BUDGET_EXCEEDED if either holds. Tasks without candidates use nothing.
    """
    reserved = reserved or {}
    rows, tried = _openly(candidates, scores)
    taken = written(folded(tried, budgets, reserved))
    selection = written(_selection(rows, taken))
    left = selection.groupBy("task_id").agg(F.bool_or(F.col("mandatory") & (F.col("outcome") == "budget_exceeded")).alias("mandatory_overflow"))
    over = F.lit(False)
    for limit, size in SIZES.items():
        if limit in budgets.columns:
            over = over | F.coalesce(F.lit(reserved.get(size, 0)) > F.col(limit), F.lit(False))
    usage = budgets.select("task_id", over.alias("reservation_overflow")).join(
        taken.filter("candidate_id is null").select("task_id", *USAGE), "task_id", "left",
    ).join(left, "task_id", "left")
    overflow = F.coalesce("mandatory_overflow", F.lit(False))
    usage = usage.select(
        "task_id", *(F.coalesce(u, F.lit(0)).cast("long").alias(u) for u in USAGE), "reservation_overflow", overflow.alias("mandatory_overflow"),
        F.when(F.col("reservation_overflow") | overflow, "RETRIEVAL_BUDGET_EXCEEDED").alias("code"),
    )
    return selection, usage


# --- The simple retriever --------------------------------------------------------------------------------------


#: Tasks that are sent to the rows at a time.
MOST_TASKS = 5_000


def _by_task(tasks: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row with every task of its project, or of the whole table where tasks have no project.

    Tasks are sent to the rows in blocks of about ``MOST_TASKS``.
    """
    together = lambda block: rows.join(block, "project_id") if "project_id" in tasks.columns else rows.crossJoin(block)
    return in_blocks(tasks, MOST_TASKS, together)


def _touched(tasks: DataFrame, rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """(task_id, candidate_id, a list of hits for each of ``fields``, explicit_path_match) of rows that a term touches.

    ``rows`` have candidate_id, path and the columns that ``fields`` names, folded (the keys are the names of the lists).
    The distinct terms of all tasks are looked up in the distinct values of a field once
    (:func:`gleanery.functions.search.containing`), and hits are joined to the tasks that ask for them.
    """
    own = [c for c in ("project_id",) if c in tasks.columns]
    asked = tasks.select("task_id", *own, F.posexplode("search_terms").alias("pos", "phrase"))
    terms = asked.select("phrase").distinct()
    hits = []
    for field, column in fields.items():
        if column == "__text":
            met = containing(
                rows.select(F.col("candidate_id").alias("id"), F.col(column).alias("text")), terms,
            ).withColumnRenamed("id", "candidate_id")
            met = met.join(rows.select("candidate_id", *own), "candidate_id") if own else met
        else:
            values = rows.select(F.col(column).alias("id")).distinct()
            met = containing(values.select("id", F.col("id").alias("text")), terms).join(
                rows.select("candidate_id", *own, F.col(column).alias("id")), "id",
            )
        hits.append(met.join(asked, ["phrase", *own]).select("task_id", "candidate_id", F.lit(field).alias("field"), "pos", "phrase"))
    if "explicit_paths" in tasks.columns:
        named = tasks.select("task_id", *own, F.explode("explicit_paths").alias("__path")).join(
            rows.select("candidate_id", *own, "__path"), ["__path", *own],
        )
        hits.append(named.select("task_id", "candidate_id", F.lit("named").alias("field"), F.lit(0).alias("pos"), F.col("__path").alias("phrase")))
    both = reduce(DataFrame.unionByName, hits)
    listed = lambda field: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("pos", "phrase")))), lambda x: x["phrase"]
    ).alias(field)
    return both.groupBy("task_id", "candidate_id").agg(*map(listed, fields), F.bool_or(F.col("field") == "named").alias("explicit_path_match"))


def score_units(tasks: DataFrame, units: DataFrame) -> DataFrame:
    """(task_id, candidate_id, ...) of units that a term touches: 3 points a term in the path, 1 a term in the text.

    Tasks have task_id and search_terms (and explicit_paths, folded); units unit_id (unique), path, text. Units without
    a hit are left out unless their path is named.
    """
    own = [c for c in ("project_id",) if c in units.columns]
    rows = units.select(
        F.col("unit_id").alias("candidate_id"), *own, "path", fold(F.col("path")).alias("__path"),
        fold(F.col("text")).alias("__text"),
    )
    sizes = units.select(
        F.col("unit_id").alias("candidate_id"), "path", F.octet_length("text").cast("long").alias("bytes"),
        F.length("text").cast("long").alias("characters"),
    )
    out = _touched(
        tasks, rows, {"path_hits": "__path", "content_hits": "__text"},
    ).join(sizes, "candidate_id").join(tasks.select("task_id", "search_terms"), "task_id")
    out = out.withColumns(
        {"type": F.lit("source_excerpt"), "score": 3 * F.size("path_hits") + F.size("content_hits"), "name_hits": F.array().cast("array<string>")}
    )
    return out.select(*SCORED)


def score_symbols(tasks: DataFrame, symbols: DataFrame, units: DataFrame) -> DataFrame:
    """As :func:`score_units` for symbols: 3 points a term in the path, 6 in the name, 1 in the signature.

    Symbols have symbol_id (unique), name, path and (perhaps) signature; their size is that of all units of the file.
    """
    own = [c for c in ("project_id",) if c in symbols.columns]
    signature = F.coalesce("signature", F.lit("")) if "signature" in symbols.columns else F.lit("")
    rows = symbols.select(
        F.col("symbol_id").alias("candidate_id"), *own, "path", fold(F.col("path")).alias("__path"),
        fold(F.col("name")).alias("__name"), fold(signature).alias("__sig"),
    )
    files = units.groupBy("path").agg(F.sum(F.octet_length("text")).alias("bytes"))
    characters = F.length(F.when(signature != "", signature).otherwise(F.col("name"))).cast("long")
    sizes = symbols.select(F.col("symbol_id").alias("candidate_id"), "path", characters.alias("characters")).join(files, "path", "left")
    out = _touched(
        tasks, rows, {"path_hits": "__path", "name_hits": "__name", "content_hits": "__sig"},
    ).join(sizes, "candidate_id").join(tasks.select("task_id", "search_terms"), "task_id")
    out = out.withColumns(
        {
            "type": F.lit("symbol_definition"), "bytes": F.coalesce("bytes", F.lit(0)),
            "score": 3 * F.size("path_hits") + 6 * F.size("name_hits") + F.size("content_hits"),
        }
    )
    return written(out.select(*SCORED))


#: Columns of scored candidates.
SCORED = [
    "task_id", "candidate_id", "type", "path", "bytes", "characters", "score", "path_hits", "name_hits", "content_hits",
    "explicit_path_match", "search_terms",
]


def suppress_historical(scored: DataFrame, units: DataFrame) -> DataFrame:
    """Scores of files with marks of the past become 0 (kept as historical_penalty) where the task asks about now."""
    past = "(" + "|".join(HISTORICAL_MARKS) + ")"
    marked = units.groupBy("path").agg(F.bool_or(fold(F.col("text")).rlike(past)).alias("__old")).filter("__old")
    rows = scored.join(marked, "path", "left")
    now = F.arrays_overlap("search_terms", F.array(*map(F.lit, CURRENT_TERMS)))
    old = now & (F.coalesce("__old", F.lit(False)) | fold(F.col("path")).rlike(past))
    rows = rows.withColumn("historical_penalty", F.when(old, F.col("score")).otherwise(0))
    return rows.withColumn("score", F.col("score") - F.col("historical_penalty")).drop("__old")


def boost_dependencies(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds structural_boost: 4 points an edge from a file with the task's top score, up to one below that score.

    ``edges`` (relationship_id, source_path, target_path, kind, resolution) link files. Files with a top candidate and
    penalised candidates get none.
    """
    scored = written(scored)
    best = scored.groupBy("task_id").agg(F.max("score").alias("top")).filter("top > 0")
    seeds = scored.join(best, "task_id").filter("score = top and historical_penalty = 0").select("task_id", "path").distinct()
    direct = edges.filter(
        (F.col("resolution") == "resolved_internal") & F.col("kind").isin(BOOST_KINDS)
    ).select("relationship_id", F.col("source_path").alias("path"), "target_path")
    hits = seeds.join(direct, "path").groupBy("task_id", F.col("target_path").alias("path")).agg(F.countDistinct("relationship_id").alias("links"))
    hits = hits.join(seeds, ["task_id", "path"], "left_anti")
    rows = scored.join(hits, ["task_id", "path"], "left").join(best, "task_id", "left")
    able = F.col("links").isNotNull() & (F.col("historical_penalty") == 0)
    boosted = F.when(able, F.least(F.col("score") + 4 * F.col("links"), F.greatest(F.lit(0), F.col("top") - 1))).otherwise(F.col("score"))
    return written(
        rows.withColumn("__b", boosted).withColumns(
            {"structural_boost": F.col("__b") - F.col("score"), "score": F.col("__b")}
        ).drop("__b", "links", "top")
    )


def dedupe_spans(ranked: DataFrame, span: list[str]) -> DataFrame:
    """Adds ``duplicate``: true but for the best candidate of a task's span: named paths, then score, size, id."""
    order = Window.partitionBy("task_id", *span).orderBy(F.desc("explicit_path_match"), F.desc("score"), "bytes", "candidate_id")
    return ranked.withColumn("duplicate", F.row_number().over(order) > 1)


def select_simple(candidates: DataFrame, budgets: DataFrame, require_score: bool = True) -> DataFrame:
    """Adds outcome, reason and selected_rank: by named path, score, size and id, greedy under the task's budget.

    Without a score and a named path a candidate is below the threshold and isn't tried.
    """
    rows = candidates.withColumn(
        "open",
        (F.lit(not require_score) | (F.col("score") > 0) | F.col("explicit_path_match")) & ~F.coalesce("duplicate", F.lit(False)),
    )
    tried = rows.filter("open").select(
        "task_id",
        F.struct((~F.col("explicit_path_match")).alias("later"), (-F.col("score")).alias("low"), "bytes").alias("pos"),
        "candidate_id", F.col("path").alias("artifact_id"), "bytes", "characters",
        token_estimate(F.col("characters")).alias("tokens"), (F.col("type") == "source_excerpt").alias("is_excerpt"),
    )
    done = greedy(tried, budgets).select("task_id", "candidate_id", "selected_rank")
    out = rows.join(done, ["task_id", "candidate_id"], "left")
    reason = F.when(
        F.coalesce("duplicate", F.lit(False)), "duplicate_content",
    ).when(~F.col("open"), "below_relevance_threshold").when(F.col("selected_rank").isNull(), "context_budget_exceeded").when(F.col(
        "explicit_path_match"
    ), "exact_path_match").when(F.col("score") > 0, "lexical_content_match").otherwise("required_context")
    return out.withColumns({"outcome": F.when(F.col("selected_rank").isNotNull(), "selected").otherwise("excluded"), "reason": reason}).drop("open")


def fallback_smallest(tasks: DataFrame, selected: DataFrame, units: DataFrame, budgets: DataFrame) -> DataFrame:
    """(task_id, candidate_id, selected_rank) for tasks without any scored candidate: whole files, the smallest first.

    ``selected`` holds (task_id) of all candidates with a score. Sizes are summed per file, once. A task takes as many
    files as its budget allows, so tasks without limits are not filled. Every limit rises with the size, so behind a
    file that doesn't fit no other does: where all budgets limit the items, tasks meet only as many of the smallest files.
    Files without any text (all null) have no size and are no candidates; empty ones have the size 0.
    """
    sizes = units.groupBy("path").agg(F.sum(F.octet_length("text")).alias("bytes")).filter("bytes is not null")
    if "max_items" in budgets.columns:
        bound = budgets.agg(F.max("max_items").alias("most"), F.count_if(F.col("max_items").isNull()).alias("open")).first()
        if bound["most"] is not None and not bound["open"]:
            sizes = sizes.orderBy("bytes", "path").limit(int(bound["most"]))
    empty = tasks.select("task_id").join(selected.select("task_id").distinct(), "task_id", "left_anti")
    rows = _by_task(empty, sizes).select(
        "task_id", F.struct("bytes").alias("pos"), F.concat(F.lit("artifact-"), F.col("path")).alias("candidate_id"),
        F.col("path").alias("artifact_id"), F.col("bytes").cast("long").alias("bytes"),
        F.col("bytes").cast("long").alias("characters"), token_estimate(F.col("bytes")).alias("tokens"),
        F.lit(False).alias("is_excerpt"),
    )
    return greedy(rows, budgets).filter("fits").select("task_id", "candidate_id", "selected_rank")


def retrieval_status(tasks: DataFrame, selection: DataFrame) -> DataFrame:
    """(task_id, status, code): complete if something is selected and, where a task has signals, a named path or a hit equals one."""
    signals = F.coalesce("signals", F.array().cast("array<string>")) if "signals" in tasks.columns else F.array().cast("array<string>")
    rows = selection.filter("outcome = 'selected'").join(tasks.select("task_id", signals.alias("signals")), "task_id")
    met = F.col("explicit_path_match") | F.arrays_overlap("signals", F.concat("path_hits", "name_hits", "content_hits"))
    seen = rows.groupBy("task_id").agg(F.bool_or(met).alias("met"))
    out = tasks.select("task_id", F.size(signals).alias("n")).join(seen, "task_id", "left")
    code = F.when(F.col("met").isNull(), "RETRIEVAL_NO_RELEVANT_CONTEXT").when((F.col("n") > 0) & ~F.col("met"), "RETRIEVAL_INSUFFICIENT_CONTEXT")
    return out.select("task_id", F.when(code.isNull(), "complete").otherwise("incomplete").alias("status"), code.alias("code"))


def retrieval_statistics(selection: DataFrame) -> DataFrame:
    """Counts per task of candidates with outcome, reason, type, path and characters."""
    chosen = F.col("outcome") == "selected"
    return selection.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("candidates_generated"),
        F.countDistinct(F.when(chosen, F.col("path"))).alias("artifacts_selected"),
        F.count_if(chosen & (F.col("type") == "source_excerpt")).alias("excerpts_selected"),
        F.count_if(chosen & (F.col("type") == "symbol_definition")).alias("symbols_selected"),
        F.count_if(F.col("reason") == "context_budget_exceeded").alias("budget_excluded"),
        F.count_if(F.col("reason") == "duplicate_content").alias("duplicates"),
        F.sum(F.when(chosen, token_estimate(F.col("characters"))).otherwise(0)).alias("selected_tokens"),
    )


def retrieve(
    tasks: DataFrame, units: DataFrame, edges: DataFrame, budgets: DataFrame, symbols: DataFrame | None = None,
    span: list[str] | None = None,
) -> DataFrame:
    """The whole chain for tasks with search_terms: score, suppress, boost, drop doubles, select under the budget."""
    scored = score_units(tasks, units)
    if symbols is not None:
        scored = scored.unionByName(score_symbols(tasks, symbols, units))
    scored = boost_dependencies(suppress_historical(scored, units), edges)
    return select_simple(dedupe_spans(scored, span or ["candidate_id"]), budgets)


def check_selection(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """(task_id, candidate_id, code): repeated ids, ineligible ones selected, and where both tables disagree."""
    keys = ["task_id", "candidate_id"]
    twice = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit("DUPLICATE_CANDIDATE").alias("code"))
    barred = candidates.filter("outcome = 'selected' and eligibility <> 'eligible'").select(*keys, F.lit("INELIGIBLE_SELECTED").alias("code"))
    chosen = candidates.filter("outcome = 'selected'").select(*keys, F.lit(1).alias("a")).distinct()
    odd = chosen.join(
        selected.select(*keys, F.lit(1).alias("b")).distinct(), keys, "full_outer",
    ).filter("a is null or b is null").select(*keys, F.lit("SELECTION_MISMATCH").alias("code"))
    return twice.unionByName(barred).unionByName(odd)
