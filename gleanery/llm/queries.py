"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_documents
from .common import shared_folder, table
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .language_id import language_id
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .packing import pack
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .spelling import corpus_variants
from .token_counts import count_documents, write_token_files
from .url_filter import url_filter
from .vector_dedup import vector_dedup

#: (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


#: Files of the tokenizer: the vocabulary, and the same as ranks.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCABULARY, RANKS, public_tokenizers.PATTERN)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs of pages whose id is labelled toxic; every page with the same canonical URL is blocked."""
    pages = table(spark, sf_dir, "pages")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    listed = pages.select("page_id", "url").join(toxic, F.col("page_id") == F.col("doc_id"), "left_semi").select("url")
    return url_filter(pages, RULES, listed)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as flat token files in the shared folder, one for each partition read, and the counts found in them."""
    folder = f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    names = write_token_files(table(spark, sf_dir, "documents"), folder, VOCABULARY, RANKS, public_tokenizers.PATTERN)
    counts = count_documents(spark, names, folder)
    return counts.select(F.col("name").alias("doc_id"), F.col("part").alias("file"), "ordinal", "start", "n_tokens", "ended")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=4)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 move on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line model learns from the quality labels of other documents."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_url_filters,
        op3_token_counts,
        op4_line_dedup,
        op5_byte_bpe,
        op6_embedding_near_dedup,
        op7_language_id,
        op8_exact_dedup,
        op9_secret_scans,
        op10_minhash_near_dedup,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_quality_rules,
    )
}


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": rf"""
WITH u AS (SELECT page_id, url, {_REST} AS rest FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                   lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS query
  FROM u),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
                 || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND canonical IS NOT NULL),
r AS (
  SELECT page_id, host, path, canonical IN (SELECT canonical FROM l) AS hit,
    CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c)
SELECT page_id, host, path, rule, coalesce(hit, false) AS listed,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR hit THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    # Every window of whole lines with 50 words, compared as text with all its places.
    "op4_line_dedup": r"""
WITH l0 AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(range(len(ls))) AS pos, regexp_replace(unnest(ls), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l0),
l2 AS (SELECT *, len(string_split_regex(line, '[\x20\x09-\x0D]+')) AS w FROM l1 WHERE line <> ''),
l3 AS (SELECT *, (sum(w) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS upto FROM l2),
l4 AS (SELECT *, upto - w AS beg FROM l3),
ahead AS (SELECT list(pos) OVER g AS covered, list(line) OVER g AS run, max(upto) OVER g - beg AS words, doc_id FROM l4
  WINDOW g AS (PARTITION BY doc_id ORDER BY beg RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
behind AS (SELECT list(pos) OVER g AS covered, list(line) OVER g AS run, upto - min(beg) OVER g AS words, doc_id FROM l4
  WINDOW g AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
runs AS (SELECT doc_id, covered, array_to_string(run, chr(10)) AS run FROM (FROM ahead UNION ALL FROM behind) WHERE words >= 50),
later AS (SELECT DISTINCT doc_id, unnest(covered) AS pos FROM (
  SELECT *, min({'doc': doc_id, 'pos': covered[1], 'last': covered[len(covered)]}) OVER (PARTITION BY run) AS f FROM runs)
  WHERE doc_id <> f.doc OR covered[1] > f.last),
gone AS (SELECT doc_id, list(pos) AS gone FROM later GROUP BY doc_id)
SELECT l0.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_deleted,
       sha256(CASE WHEN gone IS NULL THEN t ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i -
  1)), chr(10)), '') END) AS kept_sha256
FROM l0 LEFT JOIN gone ON l0.doc_id = gone.doc_id""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[ 	-
]+', '', 'g') AS n FROM documents),
g AS (SELECT n, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.n) AS text_sha256 FROM d JOIN g ON d.n = g.n""",
    "op9_secret_scans": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
p(kind, rank, pattern, grp, least, least_value, base) AS (VALUES
  ('assign', 1,
  '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)',
  2, 0, 6, true)),
a AS (
  SELECT doc_id, source, 'assign' AS kind, 1 AS rank, string_split_regex(t, pattern) AS g, regexp_extract_all(t, pattern, 0) AS w,
  regexp_extract_all(t, pattern, 2) AS v, 0 AS least, 6 AS least_value, true AS base FROM d, p
  UNION ALL SELECT doc_id, source, 'access', 2, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'),
  regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 20, 0, true FROM d
  UNION ALL SELECT doc_id, source, 'hex', 3, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'),
  regexp_extract_all(t, '[0-9a-f]+'), 24, 0, true FROM d WHERE regexp_matches(t, '[0-9a-f]{24}')
  UNION ALL SELECT doc_id, source, 'vendor', 4, string_split_regex(t,
  'gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}'),
    regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}'),
    regexp_extract_all(t,
  'gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}'), 0, 0, false FROM d
  UNION ALL SELECT doc_id, source, 'jwt', 5, string_split_regex(t, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+'),
  regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+'),
    regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+'), 0, 0, false FROM d),
m AS (SELECT doc_id, source, kind, rank, base, least, least_value, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(v) AS
  v, unnest(g[1:len(w)]) AS g FROM a WHERE len(w) > 0),
e AS (SELECT *, (sum(length(g) + length(w)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS stop FROM m),
s AS (SELECT *, stop - length(w) AS start FROM e WHERE length(w) >= least AND length(v) >= least_value),
o AS (SELECT v, count(DISTINCT source) AS owners FROM s GROUP BY v),
k AS (SELECT s.*, owners <= 4 AS live, kind || ':' || start || ':' || stop AS span FROM s JOIN o USING (v) WHERE base OR owners <= 4),
f AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE base) AS b, string_agg(span, ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (WHERE live) AS n_live
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN f USING (doc_id)""",
    "op6_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND
  len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT x AS id, x AS m FROM l UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.id),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON id = vec_id LEFT JOIN n ON x = vec_id""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE
  list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT x AS id, x AS m FROM l UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.id),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON id = d.doc_id""",
    # crc32 bit by bit over the bytes of "<doc_id>:<word>"; near words meet in a form with one code point left out or masked.
    "op11_spelling_variants": r"""
WITH RECURSIVE r0 AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
r1 AS (SELECT doc_id, run, count(*) AS n FROM r0 WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r1),
c AS (SELECT run, n, list_transform(range(length(x) * 4), lambda i: (('0x' || substr(x, 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)) & 1) AS bits FROM b),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bits), lambda a, t: xor(a >> 1, (xor(a, t) & 1) * 3988292384)), 4294967295) AS h FROM c),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v),
cut AS (SELECT DISTINCT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS form FROM p),
mask AS (SELECT word, n, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS form FROM p),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM mask a JOIN mask b ON a.form = b.form AND a.word <> b.word
  UNION SELECT cut.word, cut.n, v.word, v.n FROM cut JOIN v ON cut.form = v.word
  UNION SELECT v.word, v.n, cut.word, cut.n FROM cut JOIN v ON cut.form = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS form, first(m ORDER BY m DESC, encode(other)) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form,
  CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
root AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root ON root.word = f.word""",
    "op12_hard_negatives": r"""
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, b.label = a.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND (a.id <> b.id OR a.label <> b.label)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
