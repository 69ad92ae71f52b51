"""Allow and block lists for URLs: a blocked Bloom filter before an exact join."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, may_contain, sized
from .common import cut

#: Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty for a null URL or one without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url_rest(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without a leading ``www.``, path without trailing slashes, and the sorted query without tracking.

    Scheme and fragment go. Null for a URL without a host.
    """
    query = F.regexp_extract(url_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    base = F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), F.regexp_replace(url_path(url), r"/+$", ""))
    whole = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    return F.when(url_host(url) != "", whole)


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    blocks: int | None = None,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    ``rules``: (action, host, path) by hand, a short list in the program. A rule fits its host and all subdomains
    where the URL's path starts with the rule's; the longest (host and path together) wins and gives the verdict.
    Where none fits, the method decides: block if the canonical URL is in ``listed`` (a DataFrame of any size with a
    column ``url``), else allow.

    Every URL gives few keys: its canonical form, and the pairs of host suffix and path prefix that a rule could
    have. A blocked Bloom filter of all listed keys and rule keys, sized by their number up to a limit and broadcast,
    passes possible hits only; the exact join on the key removes what the filter let through by chance. Only URLs
    are read, and only hits are shuffled besides the pages' own URLs. A key or URL that many pages share is a skewed
    join with one row on the other side, a written table, so that Spark can split it.

    A null URL or one without ``://`` has an empty host and path, fits no rule and is allowed. Repeated rows share
    their result. Empty tables, rules or lists give no hits; of rules of one length the last by name wins. A very long URL is read
    whole. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    keys = listed.select(F.concat(F.lit("u:"), canonical_url(F.col("url"))).alias("key")).filter("key is not null").distinct()
    keys = keys.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("action"))
    if rules:
        given = F.array(*(F.struct(F.lit(f"r:{h}{p}").alias("key"), F.lit(f"{h}{p}").alias("rule"), F.lit(a).alias("action")) for a, h, p in rules))
        keys = keys.unionByName(spark.range(1, numPartitions=1).select(F.inline(given)))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    tails = [F.substring_index("host", ".", -n) for n in range(1, 1 + max((h.count(".") + 1 for _, h, _ in rules), default=0))]
    heads = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted({len(p) for _, _, p in rules})]
    candidates = F.array_compact(
        F.array_distinct(F.array(F.concat(F.lit("u:"), canonical_url(F.col("url"))), *(F.concat(F.lit("r:"), t, h) for t in tails for h in heads)))
    )
    asked = rows.filter(F.col("url").isNotNull()).select("url", host.alias("host"), path.alias("path")).filter("host <> ''")
    asked = asked.select("url", F.explode(candidates).alias("key"))
    keys = cut(keys)
    blocks = blocks or sized(keys)
    hits = may_contain(asked, bloom_filter(keys, blocks), blocks).join(keys, "key")
    found = hits.groupBy("url").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "rule", "action"))).alias("best"),
        F.bool_or(F.col("rule").isNull()).alias("listed"),
    )
    found = cut(found.select("url", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"), "listed"))
    listed_here = F.coalesce("listed", F.lit(False))
    return rows.join(found, "url", "left").select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        "rule",
        F.coalesce("action", F.when(listed_here, "block").otherwise("allow")).alias("verdict"),
        listed_here.alias("listed"),
    )
