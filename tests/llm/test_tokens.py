import hashlib
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyarrow.fs import FileSystem
from tokenizers import Tokenizer

from gleanery.llm.byte_bpe import ByteBpe, byte_bpe, decode_documents, encode_documents, merge_one, merge_side_by_side
from gleanery.llm.common import shared_folder
from gleanery.llm.packing import binary_pieces, pack, write_buckets
from gleanery.llm.token_counts import count_documents, read_token_files, token_counts, write_token_files
from gleanery.llm.tokens import read_ranks

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    (1, "It's the end of the world, 12 times; and   more\n\n text  "),
    (2, ""),
    (3, None),
    (4, "<|endoftext|> in a text <|endoftext|>"),
    (5, "ß ſ ² Ⅷ 日本語 👩‍👩‍👧 \x1c\x85\xa0  é"),
    (6, "aaaa" * 400 + "x" * 3000),
    (7, "word " * 5000),
    (7, "word " * 5000),
    (None, "no id"),
]
SCHEMA = "doc_id long, text string"


def docs(spark, rows=TEXTS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' as start", "1 as length", "2 as sequence_id", "'y' as ids") if extra else df


def reference_ids(text):
    return Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False).ids


def test_pieces_are_powers_of_two_without_gaps():
    for n in [1, 2, 3, 7, 2047, 2048, 2049, 10_001]:
        pieces = binary_pieces(n, 2048)
        assert [a for a, _ in pieces] == [sum(m for _, m in pieces[:k]) for k in range(len(pieces))]
        assert sum(m for _, m in pieces) == n and all(m & (m - 1) == 0 and m <= 2048 for _, m in pieces)


def test_pack_holds_every_id_once(spark, tmp_path):
    pieces = pack(docs(spark), JSON, RANKS, P.PATTERN, with_ids=True)
    rows = pieces.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for doc_id, text in TEXTS:
        flat = np.array([*reference_ids(text), 1], dtype="<u4")
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: (r.start, r.sequence_id))
        copies = 2 if doc_id == 7 else 1
        assert sum(r.length for r in own) == copies * len(flat)
        for r in own:
            part = flat[r.start : r.start + r.length]
            assert (r.ids_crc32, r.doc_tokens, r.offset, r.ids) == (zlib.crc32(part), len(flat), 0, part.tolist())
            assert 1 << r.bucket == r.length
    write_buckets(pieces, str(tmp_path / "buckets"))
    assert spark.read.parquet(str(tmp_path / "buckets")).count() == len(rows)


def test_pack_of_an_empty_table(spark):
    assert pack(docs(spark, []), JSON, RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        pack(docs(spark), JSON, RANKS, P.PATTERN, longest=1000)


def test_segment_tree_gives_the_same_ids_as_tiktoken():
    own = ByteBpe(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rng = np.random.default_rng(5)
    texts = [t or "" for _, t in TEXTS]
    texts += ["".join(map(chr, rng.choice([*range(32, 127), *range(192, 400), *range(0x4E00, 0x4E40), 0x1F600], rng.integers(1, 300)))) for _ in range(100)]
    ids = own.encode(texts)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(i).decode() for i in ids] == texts


def test_both_merges_agree():
    merges = ByteBpe(RANKS, P.PATTERN).merges
    words = [b"a", b"ab", b"hello", b" international", b"aaaaaaaaaaaaaaa", bytes(range(200, 232))]
    assert merge_side_by_side(words, merges, 32) == [merge_one(w, merges) for w in words]


def test_encode_and_decode_documents(spark):
    out = encode_documents(docs(spark), RANKS, P.PATTERN, with_ids=True)
    for r in out.collect():
        text = dict(TEXTS)[r.doc_id] or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert {(r.doc_id, r.text) for r in decode_documents(out, RANKS, P.PATTERN).collect()} == {(i, t or "") for i, t in TEXTS}
    assert encode_documents(docs(spark, []), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("block", [7, 100, 1 << 18])
def test_token_counts_over_block_borders(spark, block):
    rows = [(i, t) for i, t in TEXTS if i in (1, 2, 3, 4, 5, None)]
    folder = f"{shared_folder(spark)}/flat-{block}-{uuid.uuid4().hex}"
    names = write_token_files(docs(spark, rows).repartition(2), folder, JSON, RANKS, P.PATTERN)
    # What an attempt that failed has left is not counted.
    orphan = FileSystem.from_uri(folder)
    with orphan[0].open_output_stream(f"{orphan[1]}/part-00000000-dead") as out:
        out.write(np.array([7, 50256, 8], dtype="<u2").tobytes())
    found = count_documents(spark, names, folder, block=block).collect()
    assert all(r.ended for r in found)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    assert {(r.name, r.n_tokens) for r in found} == {(i, len(library.encode_ordinary(t or "")) + 1) for i, t in rows}
    for file in {r.part for r in found}:
        own = sorted((r for r in found if r.part == file), key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))]


def test_no_documents_give_no_files(spark):
    folder = f"{shared_folder(spark)}/flat-none-{uuid.uuid4().hex}"
    names = write_token_files(docs(spark, []), folder, JSON, RANKS, P.PATTERN)
    assert names.count() == 0 == count_documents(spark, names, folder).count()


def test_long_words_are_not_remembered():
    bpe = byte_bpe(RANKS, P.PATTERN)
    long = "Ab3" * 20_000
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    for _ in range(2):
        assert bpe.encode([f"a {long} b {long}", "short"]) == [library.encode_ordinary(f"a {long} b {long}"), library.encode_ordinary("short")]
        assert max(map(len, bpe.known)) <= 65


def test_token_counts_of_flat_files(spark, tmp_path):
    np.array([5, 6, 50256, 50256, 7, 8, 9], dtype="<u2").tofile(tmp_path / "a.bin")
    np.array([50256], dtype="<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").touch()
    found = token_counts(read_token_files(spark, str(tmp_path), block=3)).collect()
    assert sorted((r.file[-5:], r.ordinal, r.start, r.n_tokens, r.ended) for r in found) == [
        ("a.bin", 0, 0, 3, True), ("a.bin", 1, 3, 1, True), ("a.bin", 2, 4, 3, False), ("b.bin", 0, 0, 1, True),
    ]


def test_unnamed_files_are_not_read_and_blocks_are_not_shuffled(spark, tmp_path):
    for name in ("a.bin", "b.bin"):
        np.arange(1_000, dtype="<u2").tofile(tmp_path / name)
    found = read_token_files(spark, str(tmp_path), block=100, names=spark.createDataFrame([("a.bin",)] * 2, "file string"))
    assert sorted((r.file[-5:], r.block, len(r.data)) for r in found.collect()) == [("a.bin", k, 200) for k in range(10)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow") and plan.index("MapInArrow") < plan.index("Join LeftSemi")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_documents_of_many_blocks(spark, tmp_path):
    """A file of one long document between short ones, with more blocks than separators."""
    ids = np.concatenate(([1, 2, 50256], np.arange(300_000) % 50_000, [50256, 3, 50256])).astype("<u2")
    ids.tofile(tmp_path / "long.bin")
    blocks = read_token_files(spark, str(tmp_path), block=1_000).selectExpr("*", "1 as base", "2 as done", "'x' as name")
    found = sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in token_counts(blocks).collect())
    assert found == [(0, 0, 3, True), (1, 3, 300_001, True), (2, 300_004, 2, True)]
