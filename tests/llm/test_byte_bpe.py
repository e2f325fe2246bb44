"""Byte-level BPE against the library."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evidentia.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(5)
    kinds = ["abcdefgh", "ein deräöü", "你好世界我们的中文字符测试文本", "ࡰࢉ \U00012f90 1\U0001e4f0", "!?--=='s 'll", "\n\t   　", "émÀ🙂🙃👍"]
    out = ["", "a", " ", "  x", " \n\n hi 's't", "<|endoftext|>", "a\x00b", "aaaaaaaaaaaaaaaa" * 30, "的" * 700]
    out += ["".join(rnd.choice(kinds[2]) for _ in range(3000)), "x" * 3000 + " " * 1000 + "y"]
    out += ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randrange(1, 300))) for _ in range(150)]
    out += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäöéß") for _ in range(rnd.randrange(50, 400))) for _ in range(20)]
    return out + out[:20]


@pytest.mark.parametrize("words", [0, 40, byte_bpe.WORDS])
def test_equals_the_library(spark, library, words):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([*rows, (None, "ab ab"), (-1, None)], "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS word")
    out = byte_bpe.byte_bpe_decode(byte_bpe.byte_bpe_encode(docs, PATH, PATTERN, words=words), PATH, PATTERN, packed="packed")
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) + 2
    for k, text in rows:
        assert list(got[k].ids) == library.encode_ordinary(text)
        assert bytes(got[k].decoded) == text.encode()
        assert bytes(got[k].packed) == b"".join(i.to_bytes(4, "little") for i in got[k].ids)
    assert list(got[-1].ids) == [] and bytes(got[-1].decoded) == b""
    assert list(got[None].ids) == library.encode_ordinary("ab ab")
    assert byte_bpe.byte_bpe_encode(docs.limit(0), PATH, PATTERN, words=words).collect() == []


def test_words_that_the_table_lacks_are_few_and_right(spark):
    assert byte_bpe._least_count(spark.createDataFrame([(n,) for n in (5, 5, 3, 2, 2, 2)], "n long"), 3) == 3
    assert byte_bpe._least_count(spark.createDataFrame([(9,)] * 4, "n long"), 3) == 1 << 62


def test_bytes_need_ranks():
    with pytest.raises(ValueError):
        byte_bpe.Codec({b"a": 0}, PATTERN)


def test_query(spark, library):
    import hashlib

    out = {r.doc_id: r for r in queries.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert out[d.doc_id].n_tokens == len(ids)
        assert out[d.doc_id].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert out[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_only_texts_with_newer_letters_meet_the_long_pattern(spark, library):
    """Both patterns agree elsewhere, and what chooses between them knows every newer letter and number."""
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), PATTERN)
    edges = sorted({c + d for r in byte_bpe.NEWER_LETTERS + byte_bpe.NEWER_NUMBERS for c in r for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(c, f"a{chr(c)}1 {chr(c)}{chr(c)}, .{chr(c)}") for c in edges], "c int, text string")
    got = rows.select("c", F.col("text").rlike(codec.newer).alias("newer"), codec.words(F.col("text")).alias("words"), codec.encoded(codec.words(F.col("text"))).alias("ids"), "text").collect()
    for r in got:
        assert r.newer == any(a <= r.c <= b for a, b in byte_bpe.NEWER_LETTERS + byte_bpe.NEWER_NUMBERS)
        assert "".join(r.words) == r.text and list(r.ids) == library.encode_ordinary(r.text)
    assert len(codec.plain) < 100 < len(codec.pattern)


def test_a_fold_is_one_array_of_longs(spark, library):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), PATTERN)
    words = ["a", "aaaaaaa", "ababababa", "mississippi" * 5, "é" * 30, "x" * 300]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", codec.with_map(lambda k: codec._fold(k, codec._start(k, F.col("w")))).alias("ids"))
    assert [list(r.ids) for r in rows.collect()] == [library.encode_ordinary(w) for w in words]
    assert byte_bpe.NONE << byte_bpe.RANK_AT < 1 << 63
