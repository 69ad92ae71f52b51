"""URL rules, secrets and languages on small tables."""

import hashlib
import random
import re

from gleanery.llm.language_id import fit, identify_language, in_known_language, learn, ngrams
from gleanery.llm.secret_scan import redact_secrets, secret_scan
from gleanery.llm.url_filter import bloom_filter, canonical_url, may_contain, url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x?q=1#f", "https://a.b.example.org/en/1999", "https://notexample.org/es/", "https://x.com/de/", "https://x.com/de", "https://com/fr/é", "ftp://x.net?a=/de/",
    "http://www.listed.net/page/?utm_source=x&b=2&a=1", "https://listed.net/page?a=1&b=2#top", "http://listed.net/page", "http://É.com/de/", "a://b://c/de/", "http://x.com/de/", "http://x.com/de/", "http://" + "a." * 3000 + "com/fr/" + "y" * 50_000,
]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_filter(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'z' as host", "'z' as key", "1 as block", "2 as w0", "'r' as rule")
    listed = spark.createDataFrame([("https://listed.net/page?b=2&a=1",), (None,), ("junk",)], "url string")
    for blocks in (1, 1 << 10):
        out = {r.page_id: r for r in url_filter(pages, RULES, listed, blocks=blocks).collect()}
        assert len(out) == len(URLS)
        for k, url in enumerate(URLS):
            host, path, rule, action = verdict(url)
            hit = url in (URLS[11], URLS[12])
            assert (out[k].host, out[k].path, out[k].rule, out[k].verdict, out[k].listed) == (host, path, rule, action or ("block" if hit else "allow"), hit), url
    assert url_filter(pages.limit(0), RULES, listed).count() == 0
    assert {r.verdict for r in url_filter(pages, [], listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    other = spark.range(3000).selectExpr("concat('n', id) as key")
    bloom = bloom_filter(keys, 256)
    assert bloom.count() <= 256
    assert may_contain(keys, bloom, 256).count() == 3000
    assert may_contain(other, bloom, 256).count() < 150


def test_canonical_url(spark):
    df = spark.createDataFrame([("http://WWW.a.com/x/?ref=1&z=2&a=3#q",), ("https://a.com",), (None,)], "url string")
    assert [r[0] for r in df.select(canonical_url(df.url)).collect()] == ["a.com/x?a=3&z=2", "a.com", None]


KEY = "AKIA" + "B" * 16
TOKEN = "ghp_" + "aB3" * 12
TEXTS = [
    None, "", "password=secret1 passwd: 'abc' Api_Key\" : \"k+/_.=-9\"", f"é {KEY} x{KEY}y AKIAshort AKIA", "hex " + "ab12" * 6 + " " + "f" * 23, "password=token:abcdefgh", "token=secret=abcdef ſecret=abcdefg",
    f"{TOKEN} lives here", "deadbeef" * 3000, f"api-key={KEY} apikey={KEY}", "TOKEN  =  " + "x" * 6, "password=hunter22",
]
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secret_table(spark):
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(TEXTS)] + [(100 + k, "copied password=hunter22 everywhere", f"o{k}") for k in range(6)] + [(3, TEXTS[3], "s0"), (None, "token=abcdefgh", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as kind", "2 as value", "3 as start", "4 as repo", "5 as owner", "6 as live", "'n' as found")


def test_secret_scan(spark):
    rows, df = secret_table(spark)
    out = secret_scan(df).collect()
    assert len(out) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in out:
        base = base_spans(texts[r.doc_id])
        count = lambda kind: sum(b[3] == kind for b in base)  # noqa: E731, B023
        assert (r.n_assign, r.n_access, r.n_hex) == (count("assign"), count("access"), count("hex")), r.doc_id
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        # The password that seven owners publish is an example; all else is live.
        assert r.n_live == (0 if "hunter22" in (texts[r.doc_id] or "") else r.spans.count(":") // 2)
    assert next(r for r in out if r.doc_id == 7).spans == f"vendor:0:{len(TOKEN)}"
    assert secret_scan(df.limit(0)).count() == 0


def test_redact_secrets(spark):
    rows, df = secret_table(spark)
    out = redact_secrets(df)
    assert out.columns == df.columns and out.count() == len(rows)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[0] is None and text[1] == ""
    assert text[3] == "é [SECRET] x[SECRET] AKIAshort AKIA".replace("x[SECRET]", "x[SECRET]y")
    assert text[7] == "[SECRET] lives here"
    assert text[100] == "copied password=hunter22 everywhere"
    assert KEY not in text[9] and text[8] == "[SECRET]"


def language_rows():
    rng = random.Random(6)
    parts = {"aa": "ka lo mi tu re".split(), "bb": "schn ungt erbe lich zwa".split(), "cc": "ción eño llar que ía".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(8, 60))), lang) for i, lang in enumerate(rng.choice(list(parts)) for _ in range(400))]
    return rows + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", "cc"), (903, "日本語", None), (904, "ka " * 20_000, None), (None, "ka lo", "aa"), (5, rows[5][1], rows[5][2])]


def test_language_id(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as h", "'y' as said", "'z' as bucket", "1 as score")
    model = learn(df, sample=100)
    assert (model.weights == 0).mean() > 0.2
    out = identify_language(df, model).collect()
    assert len(out) == len(rows)
    truth = {i: (t, lang) for i, t, lang in rows}
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id][1] for r in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in out}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[904].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    kept = in_known_language(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(400)) and kept.filter("doc_id in (900, 901, 902)").count() == 0
    assert identify_language(df.limit(0), model).count() == 0


def test_no_labels_no_language(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify_language(df, learn(df)).collect()] == [("und", 0.0)]


def test_labels_held_out_are_not_learnt(spark):
    rows = [(i, t, lang) for i, t, lang in language_rows() if i is not None and i < 400]
    import zlib

    bad = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "zz") for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (identify_language(spark.createDataFrame(r, schema), learn(spark.createDataFrame(r, schema))).orderBy("doc_id").collect() for r in (rows, bad))
    assert a == b


def test_fit_is_sparse_and_calibrated():
    import numpy as np

    rows = [(lang, t) for _, t, lang in language_rows() if lang and t and ngrams(t)]
    model = fit(rows, np.ones(1 << 16))
    assert model.languages == ["aa", "bb", "cc"] and 0.05 <= model.temperature <= 20
    assert model.predict("ka lo mi tu")[0] == "aa"


def plain_buckets(text):
    """Counts of the n-grams' buckets, character by character."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    if not any(c != " " for c in letters):
        return None
    padded = " " + " ".join("".join(letters).split()) + " "
    counts = {}
    for n in (1, 2, 3, 4):
        for at in range(len(padded) - n + 1):
            h = n
            for c in padded[at : at + n]:
                h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            bucket = (h * 0x85EBCA6B & 0xFFFFFFFF) >> 16
            counts[bucket] = counts.get(bucket, 0) + 1
    return counts


def dense_model(rows, idf, alpha=0.5, beta=1.0, l1=0.002, l2=0.002):
    """Every weight in every step: w = 0 where |z| <= l1, else (sign(z) l1 - z) / ((beta + sqrt(n)) / alpha + l2)."""
    import numpy as np

    names = sorted({lang for lang, _ in rows})

    def vector(text):
        x = np.zeros(len(idf) + 1)
        for bucket, k in plain_buckets(text).items():
            x[bucket] = (1 + np.log(k)) * idf[bucket]
        x /= np.sqrt((x * x).sum())
        x[-1] = 1
        return x

    data = [(names.index(lang), vector(text)) for lang, text in rows if plain_buckets(text)]
    apart, train = [d for k, d in enumerate(data) if k % 5 == 0], [d for k, d in enumerate(data) if k % 5]
    z, n = np.zeros((len(idf) + 1, len(names))), np.zeros((len(idf) + 1, len(names)))
    weights = lambda: np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    def shares(logits):
        e = np.exp(logits - logits.max())
        return e / e.sum()

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(train)):
            truth, x = train[k]
            w = weights()
            p = shares(x @ w)
            g = np.outer(x, p - np.eye(len(names))[truth])
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
            n += g * g
    w = weights()
    sure = 1 - 1 / (len(apart) + 2)

    def loss(t):
        total = 0
        for truth, x in apart:
            p = np.log(shares(x @ w / t) + 1e-12)
            total -= sum(p[k] * (sure if k == truth else (1 - sure) / (len(names) - 1)) for k in range(len(names)))
        return total

    best = min(np.geomspace(0.05, 20, 121), key=loss)
    return lambda text: dict(zip(names, shares(vector(text) @ w / best), strict=True)) if text and plain_buckets(text) else None


def test_language_model_equals_a_dense_one(spark):
    import zlib

    import numpy as np

    rows = [(i, t, lang) for i, t, lang in language_rows() if i is not None and i % 4 == 0 or i in (900, 901, 902)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(df, sample=1_000)
    learnt = [(t or "", lang) for i, t, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    frequency = np.zeros(1 << 16)
    for t, _ in learnt:
        for bucket in plain_buckets(t) or ():
            frequency[bucket] += 1
    idf = np.log((1 + len(learnt)) / (1 + frequency)) + 1
    assert np.allclose(model.idf, idf)
    ordered = [(r.lang, r.t) for r in df.filter("crc32(cast(doc_id as string)) % 4 <> 2 and lang is not null").selectExpr("lang", "coalesce(text, '') as t", "xxhash64('sample', doc_id) as h").orderBy("h", "lang", "t").collect()]
    predict = dense_model(ordered, idf)
    for r in identify_language(df, model).collect():
        expected = predict({i: t for i, t, _ in rows}[r.doc_id])
        if expected is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == max(expected, key=expected.get) and abs(r.score - expected[r.lang_pred]) < 1e-6
