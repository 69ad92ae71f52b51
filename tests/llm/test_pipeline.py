"""The pipeline's stages and the registered queries."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gleanery.llm.queries import ORACLE_SQL, QUERIES


def documents(spark, tmp_path):
    filler = " ".join(f"lorem{i} ipsum{i % 7}" for i in range(120))
    other = " ".join(f"dolor{i} amet{i % 5}" for i in range(120))
    rows = [
        (1, filler, "en", "s1"), (2, filler + " ", "en", "s1"), (3, filler.replace("lorem5 ", "changed "), "en", "s2"), (4, other + " token=abcdefgh12345678", "en", "s3"), (5, None, "en", "s1"), (6, "123 456", "en", "s1"),
        (7, "unlike the others, short text here", "en", "s1"), (7, "unlike the others, short text here", "en", "s1"), (None, "no id at all here", None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return df


def test_stages_keep_clean_documents(spark, tmp_path):
    docs = documents(spark, tmp_path)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        seen[name] = sorted((r.doc_id or 0) for r in docs.collect())
    assert seen["language_id"] == [0, 1, 2, 3, 4, 7, 7]
    assert seen["exact_dedup"] == [0, 2, 3, 4, 7]
    assert seen["near_dedup"] == [0, 2, 4, 7]
    assert seen["secret_scan"] == [0, 2, 4, 7]
    assert docs.filter("doc_id = 4").first().text.endswith("[SECRET]")
    assert docs.filter("n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == 4
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, ran.drop("sequence_id").collect())) == sorted(map(str, pieces.drop("sequence_id").collect()))


def test_columns_with_names_of_inner_ones_pass_through(spark, tmp_path):
    docs = documents(spark, tmp_path)
    names = ["row", "block", "w0", "b0", "key", "maybe", "kept", "own", "sha", "found", "said", "id", "live_id", "node", "component_id", "__id", "stays"]
    docs = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
    rows = docs.filter("doc_id is not null").collect()
    assert sorted(r.doc_id for r in rows) == [2, 4, 7]
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_dedup_stages_with_shared_ids_and_any_columns(spark, tmp_path):
    """Ids that two texts share, nulls, ties, very long texts, and columns that sets can't compare."""
    base = [f"lorem{i}" for i in range(150)]
    near = " ".join([*base[:70], "other", *base[71:]])
    long = " ".join(f"w{i}" for i in range(250_000))
    rows = [
        (-5, " ".join(base)), (3, near), (3, "a text of its own that shares the id"), (4, None), (4, None), (5, ""), (6, "same text"), (6, "same text"), (7, "same  text"), (8, long), (9, long + " end"), (10, long + " "), (None, near + " without an id"), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', doc_id) as m", "array(named_struct('x', text)) as s", "rand() as r", "cast(length(text) as bigint) as n_chars", "'en' as lang", "'s' as source")
    kept = corpus_pipeline.cut(corpus_pipeline.exact(spark, docs, str(tmp_path)))
    assert kept.columns == docs.columns
    key = lambda r: (r.doc_id if r.doc_id is not None else 99, len(r.text or ""))
    assert sorted(map(key, kept.collect())) == sorted([(-5, len(rows[0][1])), (3, len(near)), (3, 36), (4, 0), (7, 10), (9, len(long) + 4), (10, len(long) + 1), (99, len(near) + 14)])
    left = corpus_pipeline.cut(corpus_pipeline.near(spark, kept, str(tmp_path)))
    assert left.columns == docs.columns
    assert sorted(map(key, left.collect())) == sorted([(-5, len(rows[0][1])), (3, 36), (4, 0), (7, 10), (9, len(long) + 4), (99, len(near) + 14)])
    assert left.filter("doc_id = 7").first().m == {"k": 7}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = documents(spark, tmp_path).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


@pytest.mark.parametrize("number", range(1, 11))
def test_each_operator_has_one_query(number):
    assert len([q for q in QUERIES if q.startswith(f"op{number}_")]) == 1


def test_sql_belongs_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_module_without_a_library_of_this_subpackage(monkeypatch):
    import sys

    import __spark_entry__
    from gleanery.plans.registry import QUERIES as CORE

    for name in [m for m in sys.modules if m.startswith("gleanery.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    with pytest.warns(UserWarning):
        assert set(__spark_entry__.queries()) == set(CORE)
