"""The exchange of op7: parts are ranges of the order of suffixes; a full filter changes nothing."""

import random

import zstandard

from evidentia.llm import suffix_dedup as S
from evidentia.llm.repeats import Shape, shared_anchors
from evidentia.llm.substring_dedup import with_mark


def texts(seed):
    rng = random.Random(seed)
    words = [f"wörd{k}" for k in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(15)]
    return [" ".join(rng.choice([*passages, rng.choice(words), f"own{rng.random()}"]) for _ in range(rng.randrange(1, 12))) for _ in range(120)]


def test_parts_are_ranges_of_sorted_runs(spark):
    rows = with_mark(spark.createDataFrame(list(enumerate(texts(1))), "doc_id long, text string"), "doc_id", "text")
    shape = Shape(50, 24)
    bitmap = shared_anchors(rows, S.read_bytes, S._hashed, shape, 16, "doc", "text")
    cuts = S.splitters(rows, shape, bitmap, 16, 8)
    assert 1 < len(cuts) < 8
    by_part = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for r in S._runs(rows, shape, bitmap, 16, cuts).where("n > 0").collect():
        suffixes, lcps, *_ = S._decode({k: unpack(bytes(v)) if isinstance(v, (bytes, bytearray)) and v else v for k, v in r.asDict().items()})
        assert suffixes == sorted(suffixes) and len(suffixes) == r["n"] == len(lcps)
        by_part.setdefault(r["part"], []).extend(s[:24] for s in suffixes)
    assert len(by_part) > 2
    parts = sorted(by_part)
    assert all(max(by_part[a]) < min(by_part[b]) for a, b in zip(parts, parts[1:], strict=False))


def test_full_filter_and_few_partitions_change_nothing(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts(2))], "doc_id long, text string")
    want = sorted(map(str, S.suffix_dedup(docs).collect()))
    assert any("n_removed=0" not in r for r in want)
    assert sorted(map(str, S.suffix_dedup(docs, filter_bits=8).collect())) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(str, S.suffix_dedup(docs).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
