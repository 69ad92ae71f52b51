"""Secret scan: candidate spans by pattern, judged by how many owners publish the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import apart
from .common import cut

# Kind, pattern, the group that holds the secret, the fewest characters of the match and of that group.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = (
    ("assign", ASSIGN, 1, 0, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 0),
    ("hex", r"[0-9a-f]{24,}", 0, 24, 0),
)
#: Kinds that the method adds, where few owners publish the value.
ADDED_KINDS = (
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}", 0, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 0, 0),
)
KINDS = BASE_KINDS + ADDED_KINDS
BASE = [k[0] for k in BASE_KINDS]
#: A text without a match of this holds no candidate.
SEED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}|gh[pousr]_|sk_live_|xox[abprs]-|AIza|eyJ"""


def _matches(kind: str, pattern: str, group: int, least: int, least_group: int) -> Column:
    """Array of (kind, pos, gap, len, value, fits): the matches of a pattern and the gap before each of them.

    ``split`` and ``regexp_extract_all`` walk through the same matches, so the pieces between them give the offsets.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all("text", p, F.lit(0))
    zipped = F.arrays_zip(
        F.transform(F.split("text", pattern, -1), lambda x: F.length(x)).alias("gap"),
        whole.alias("whole"),
        (F.regexp_extract_all("text", p, F.lit(group)) if group else whole).alias("value"),
    )
    return F.transform(
        F.filter(zipped, lambda m: m["whole"].isNotNull()),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("pos"),
            m["gap"].alias("gap"),
            F.length(m["whole"]).alias("len"),
            F.unhex(F.md5(m["value"])).alias("value"),
            ((F.length(m["whole"]) >= least) & (F.length(m["value"]) >= least_group)).alias("fits"),
        ),
    )


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
    owner_col: str = "source", max_owners: int = 4,
) -> DataFrame:
    """One row per span: doc_id, text_key, kind, start, end (code points, end exclusive), n_repos, n_owners, live.

    A span is live if at most ``max_owners`` distinct owners publish its value; a value with more is a widely
    copied example. Spans of the base kinds are all returned; spans of the added kinds only if live.
    ``text_key`` (a 64-bit hash of the text) tells rows apart that repeat an id.

    Texts are read once by a seeding pattern; offsets are worked out only in texts that hold a candidate. What is
    shuffled then are short rows. Values are counted per (value, owner, repository), then per (value, owner), then
    per value, each step combining before its shuffle; the join of the counts has one row per value on one side.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), text.alias("text"))
    found = rows.filter(F.col("text").rlike(SEED)).select(
        "doc_id", "repo", "owner", F.xxhash64("text").alias("text_key"), F.concat(*(_matches(*k) for k in KINDS)).alias("matches")
    )
    spans = found.select("doc_id", "text_key", "repo", "owner", F.inline("matches"))
    spans = spans.repartition("doc_id", "text_key").dropDuplicates(["doc_id", "text_key", "repo", "owner", "kind", "pos"])
    before = Window.partitionBy("doc_id", "text_key", "repo", "owner", "kind").orderBy("pos")
    # Written once: counted and judged without a second scan of the texts.
    spans = cut(spans.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).filter("fits"))
    owners = (
        spans.groupBy("value", "owner", "repo")
        .agg(F.lit(1).alias("one"))
        .groupBy("value", "owner")
        .agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("value")
        .agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    )
    judged = spans.join(cut(owners), "value").withColumn("live", F.col("n_owners") <= max_owners)
    judged = judged.filter(F.col("live") | F.col("kind").isin(BASE))
    return judged.select(
        "doc_id", "text_key", "repo", "owner", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "n_repos",
        "n_owners", "live",
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _per_document(spans: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("kind"))
    listed = F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind", "live")))
    return spans.groupBy("doc_id", "text_key").agg(listed.alias("found"))


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
    owner_col: str = "source", max_owners: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live.

    The base kinds are assign, access and hex; ``spans`` lists all spans as kind:start:end by start, then kind as
    listed, and ``base_sha256`` is the digest of that list of base spans (of an empty text where there are none).
    Corpus-wide ownership decides what the method adds and how many spans look live (:func:`secret_spans`).

    Null texts count as empty and hold no span. A null owner or repository is one of its own kind. Rows that repeat
    an id and text share their result. An empty table gives no rows. A very long text is scanned whole, in its own row.
    Other columns are ignored, whatever their names.
    """
    spans = _per_document(secret_spans(docs, id_col, text_col, repo_col, owner_col, max_owners))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    found = F.coalesce("found", F.expr("array()").cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string,live:boolean>>"))
    joined = rows.alias("r").join(
        spans.alias("s"),
        F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.text_key") == F.col("s.text_key")), "left",
    )
    joined = joined.select(F.col("r.doc_id").alias("doc_id"), found.alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return joined.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(F.filter("found", lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def redact_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
    owner_col: str = "source", max_owners: int = 4, mark: str = "[SECRET]",
) -> DataFrame:
    """``docs`` with every live span of the text replaced by ``mark``; all rows and all other columns stay.

    Overlapping spans are replaced together. Null texts stay null. Values that many owners publish stay as they are.
    Only documents with a live span are shuffled (a Bloom filter of their ids passes them to the join). Other columns may
    have any names.
    """
    live = _per_document(secret_spans(docs, id_col, text_col, repo_col, owner_col, max_owners).filter("live"))
    live = cut(live.select(F.col("doc_id").alias("live_id"), F.col("text_key").alias("live_key"), "found"))
    some, clean = apart(docs, F.col(id_col).cast("string"), live.select(F.col("live_id").cast("string").alias("key")))
    rows = some.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    rows = rows.join(live, F.col("id").eqNullSafe(F.col("live_id")) & (F.col("text_key") == F.col("live_key")), "left")
    text = F.col("row").getField(text_col)
    # Spans come by start: what lies before a span is copied once, and a span that starts inside the last one lengthens it.
    done = F.aggregate(
        "found",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)),
            ).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    cleaned = F.when(F.col("found").isNull(), text).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1)))
    return rows.select(*(cleaned.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns)).unionAll(clean)
