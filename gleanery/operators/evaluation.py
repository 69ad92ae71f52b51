"""Evaluation of retrieval strategies against relevance judgments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import in_blocks
from ..functions.text import token_estimate
from .budget import greedy

CASE = ["case_id", "strategy_id"]
#: Gains of the relevance levels.
GAINS = {"required": 2, "supporting": 1}


def _gain(relevance: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in GAINS.items() for x in pair)), relevance), F.lit(0))


def judged(judgments: DataFrame, selections: DataFrame, strategies: DataFrame) -> DataFrame:
    """One row per case and strategy with the counts that all metrics need.

    ``strategies`` (strategy_id) go to the judgments in blocks; every case is measured under each of them, also without a selection.
    A single pass: judgments spread over the strategies, joined to the selections by path, aggregated once.
    """
    gold = in_blocks(strategies.select("strategy_id").distinct(), 1_000, judgments.crossJoin).join(selections.select(*CASE, "path", "rank"), [*CASE, "path"], "left")
    has = F.col("rank").isNotNull()
    level = lambda name: F.col("relevance") == name
    sums = gold.groupBy(*CASE).agg(
        F.count_if(level("required")).alias("required"),
        F.count_if(level("supporting")).alias("supporting"),
        F.count_if(level("required") & has).alias("required_hits"),
        F.count_if(level("supporting") & has).alias("supporting_hits"),
        F.count_if(has).alias("judged_selected"),
        F.count_if(has & ~level("irrelevant")).alias("relevant_selected"),
        F.count_if(has & level("irrelevant")).alias("irrelevant_selected"),
        F.min(F.when(level("required"), F.col("rank"))).alias("first_required"),
        F.array_sort(F.collect_list(F.when(level("required") & has, F.col("rank")))).alias("required_ranks"),
        F.reverse(F.array_sort(F.collect_list(F.when(_gain(F.col("relevance")) > 0, _gain(F.col("relevance")))))).alias("gains"),
        F.collect_list(F.when(has & (_gain(F.col("relevance")) > 0), F.struct("rank", _gain(F.col("relevance")).alias("gain")))).alias("found"),
    )
    sizes = selections.groupBy(*CASE).agg(F.countDistinct("path").alias("n_selected"))
    return sums.join(sizes, CASE, "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))


def recall_by_level(counts: DataFrame, level: str) -> Column:
    """Share of the judged paths of a level that are selected; 1 without any."""
    return F.coalesce(F.try_divide(F.col(f"{level}_hits"), F.col(level)), F.lit(1.0))


def judged_precision() -> Column:
    """Share of selected judged paths that are not irrelevant; 1 without any."""
    return F.coalesce(F.try_divide(F.col("relevant_selected"), F.col("judged_selected")), F.lit(1.0))


def recall_at(k: int) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter("required_ranks", lambda r: r <= k)), F.col("required")), F.lit(1.0))


def reciprocal_rank() -> Column:
    return F.coalesce(F.lit(1.0) / F.col("first_required"), F.lit(0.0))


def ndcg(k: int | None = None) -> Column:
    """Discounted gain (2^g - 1) / log2(rank + 1) over the ideal one; without ``k`` both are cut at the number of selections.

    0 without a positive gain or a selection.
    """
    limit = F.col("n_selected") if k is None else F.least(F.col("n_selected"), F.lit(k))
    ideal_limit = F.col("n_selected") if k is None else F.lit(k)
    value = lambda gain, rank: (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + F.lit(1.0))
    actual = F.aggregate(F.filter("found", lambda s: s["rank"] <= limit), F.lit(0.0), lambda a, s: a + value(s["gain"], s["rank"]))
    ideal = F.aggregate(
        F.transform(
            F.slice("gains", F.lit(1), F.greatest(ideal_limit, F.lit(0)).cast("int")), lambda g, i: value(g, i + 1)
        ), F.lit(0.0), lambda a, v: a + v
    )
    return F.when(F.col("n_selected") == 0, 0.0).otherwise(F.coalesce(F.try_divide(actual, F.when(ideal > 0, ideal)), F.lit(0.0)))


def complete_evidence() -> Column:
    """1 if every required path is selected, else 0."""
    return F.when(F.col("required_hits") == F.col("required"), 1.0).otherwise(0.0)


def retrieval_metrics(judgments: DataFrame, selections: DataFrame, strategies: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """(case_id, strategy_id, metric_name, value) of all metrics."""
    metrics = {
        "required-artifact-recall": recall_by_level(None, "required"), "supporting-artifact-recall": recall_by_level(None, "supporting"), "judged-precision": judged_precision(),
        **{
            f"recall-at-{k}": recall_at(k) for k in ks
        }, "reciprocal-rank": reciprocal_rank(), "ndcg": ndcg(), "complete-evidence": complete_evidence(),
    }
    rows = judged(judgments, selections, strategies)
    return rows.select(
        *CASE,
        F.inline(F.array(*(F.struct(F.lit(n).alias("metric_name"), v.cast("double").alias("value")) for n, v in metrics.items()))),
    )


def context_efficiency(judgments: DataFrame, items: DataFrame, excluded: DataFrame, budgets: DataFrame) -> DataFrame:
    """Retained evidence, precision, irrelevant share, use of the budget, size and exclusion reasons per case and strategy.

    ``items`` (case_id, strategy_id, ord, path, content, type), ``excluded`` (case_id, strategy_id, reason), ``budgets``
    (case_id and limits).
    """
    paths = items.groupBy(*CASE, "path").agg(F.min("ord").alias("rank"))
    counts = judged(judgments, paths, items.select("strategy_id"))
    size = items.groupBy(*CASE).agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("path").alias("artifacts"), F.count_if(F.col("type") == "source_excerpt").alias("excerpts"),
        F.sum(
            F.octet_length("content")
        ).alias("context_bytes"), F.sum(F.length("content")).alias("characters"), F.max(F.octet_length("content")).alias("largest"),
    )
    reasons = excluded.groupBy(*CASE, "reason").agg(F.count(F.lit(1)).alias("n")).groupBy(*CASE).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string")))), ",").alias("exclusions")
    )
    rows = counts.join(size, CASE, "left").join(reasons, CASE, "left").join(budgets, "case_id", "left")
    tokens = token_estimate(F.coalesce(F.col("characters") + F.col("items") - 1, F.lit(0)))
    used = [
        ("max_estimated_tokens", tokens), ("max_characters", F.col("characters")),
        ("max_bytes", F.col("context_bytes")), ("max_artifacts", F.col("artifacts")),
        ("max_excerpts", F.col("excerpts")), ("max_items", F.col("items")), ("max_item_bytes", F.col("largest")),
    ]
    ratios = [F.coalesce(F.coalesce(v, F.lit(0)) / F.col(limit), F.lit(0.0)) for limit, v in used if limit in budgets.columns]
    utilization = F.least(F.greatest(F.lit(0.0), F.lit(0.0), *ratios), F.lit(1.0))
    return rows.select(
        *CASE, recall_by_level(rows, "required").alias("required_retained"), recall_by_level(rows, "supporting").alias(
            "supporting_retained"
        ), judged_precision().alias("context_precision"),
        F.coalesce(
            F.try_divide(F.col("irrelevant_selected"), F.col("n_selected")), F.lit(0.0),
        ).alias("irrelevant_ratio"), utilization.alias("budget_utilization"),
        F.coalesce(
            "context_bytes", F.lit(0),
        ).alias("context_bytes"), tokens.alias("estimated_tokens"), F.coalesce("exclusions", F.lit("")).alias("exclusions"),
    )


def ranked_paths(rows: DataFrame, order: str = "rank") -> DataFrame:
    """(case_id, strategy_id, path, rank): the first place of each path, numbered without gaps."""
    first = rows.groupBy(*CASE, "path").agg(F.min(order).alias("__o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*CASE).orderBy("__o", "path"))).drop("__o")


def primary_selections(items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Paths of selected items (case_id, strategy_id, artifact_id, rank) by first occurrence."""
    return ranked_paths(items.join(artifacts.select("artifact_id", "path"), "artifact_id"))


def baseline(strategy_id: str, candidates: DataFrame, budgets: DataFrame) -> DataFrame:
    """(case_id, strategy_id, path, rank) of a baseline: candidates (case_id, path, rank, bytes, characters) under the budget.

    The first place of a path counts. Baselines know no limit of excerpts. Candidates come from :func:`lexical_rank`,
    :func:`resolve_explicit` or, for all files, from the paths in their order.
    """
    first = candidates.groupBy("case_id", "path").agg(
        F.min("rank").alias("pos"), F.first("bytes").alias("bytes"), F.first("characters").alias("characters"),
    )
    tried = first.select(
        F.col("case_id").alias("task_id"), "pos", F.col("path").alias("candidate_id"),
        F.col("path").alias("artifact_id"), "bytes", "characters", token_estimate(F.col("characters")).alias("tokens"),
        F.lit(False).alias("is_excerpt"),
    )
    limits = budgets.withColumnRenamed("case_id", "task_id")
    chosen = greedy(tried, limits).filter("fits")
    return chosen.select(
        F.col("task_id").alias("case_id"), F.lit(strategy_id).alias("strategy_id"), F.col("candidate_id").alias("path"),
        F.col("selected_rank").alias("rank"),
    )


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("strategy_id", "metric_name").agg(F.count(F.lit(1)).alias("cases"), F.avg("value").alias("mean"))


def baseline_deltas(metrics: DataFrame, primary: str, prefix: str = "baseline-") -> DataFrame:
    """(case_id, metric_name, baseline_id, delta): the primary strategy's value minus each baseline's."""
    ours = metrics.filter(F.col("strategy_id") == primary).select("case_id", "metric_name", F.col("value").alias("ours"))
    theirs = metrics.filter(F.col("strategy_id").startswith(prefix)).select(
        "case_id", "metric_name", F.col("strategy_id").alias("baseline_id"), "value",
    )
    return theirs.join(ours, ["case_id", "metric_name"]).select(
        "case_id", "metric_name", "baseline_id", (F.col("ours") - F.col("value")).alias("delta"),
    )


def repeated_metrics(metrics: DataFrame) -> DataFrame:
    """Keys that occur more than once: such metrics have no delta."""
    return metrics.groupBy(*CASE, "metric_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def regression_gate(aggregates: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(strategy_id, metric_name, failure) where an aggregate is missing, or outside minimum and maximum (both allowed)."""
    rows = thresholds.join(aggregates.select("strategy_id", "metric_name", "mean"), ["strategy_id", "metric_name"], "left")
    failure = F.when(F.col("mean").isNull(), "missing").when(
        F.col("mean") < F.col("minimum"), "below_minimum",
    ).when(F.col("mean") > F.col("maximum"), "above_maximum")
    return rows.select("strategy_id", "metric_name", failure.alias("failure")).filter("failure is not null")


def select_cases(cases: DataFrame, ids: Sequence[str] = (), tags: Sequence[str] = ()) -> DataFrame:
    """Cases in ``ids`` (all, if empty) that carry every tag."""
    rows = cases.filter(F.col("case_id").isin(list(ids))) if ids else cases
    return rows.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0) if tags else rows


def unknown_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Wanted ids (column ``case_id``) that no case has."""
    return ids.join(cases, "case_id", "left_anti")


def artifact_estimates(contents: DataFrame) -> DataFrame:
    """(path, bytes, characters, tokens) of contents; invalid bytes count as one replacement character each."""
    characters = F.length(F.make_valid_utf8(F.col("content").cast("string")))
    return contents.select(
        "path", F.octet_length(F.col("content").cast("binary")).cast("long").alias("bytes"),
        characters.cast("long").alias("characters"), token_estimate(characters).alias("tokens"),
    )


def changed_path_metrics(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, changed, expected, hits, recall, exact) of snapshots (case_id, path, digest) against expected (case_id, path)."""
    keys = ["case_id", "path"]
    a, b = before.select(*keys, F.col("digest").alias("was")), after.select(*keys, F.col("digest").alias("now"))
    changed = a.join(b, keys, "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select(*keys, F.lit(1).alias("c"))
    both = changed.join(expected.select(*keys, F.lit(1).alias("e")).distinct(), keys, "full_outer")
    sums = both.groupBy("case_id").agg(
        F.count("c").alias("changed"), F.count("e").alias("expected"),
        F.count_if(F.col("c").isNotNull() & F.col("e").isNotNull()).alias("hits"),
    )
    exact = (F.col("hits") == F.col("changed")) & (F.col("hits") == F.col("expected"))
    return sums.select("*", F.coalesce(F.try_divide(F.col("hits"), F.col("expected")), F.lit(1.0)).alias("recall"), exact.alias("exact"))
