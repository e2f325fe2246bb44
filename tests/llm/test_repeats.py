"""The two exact-repeat operators against brute force."""

import random

import numpy as np
import pytest

from evidentia.llm.repeats import Shape, find_anchors, merge_spans
from evidentia.llm.substring_dedup import substring_dedup
from evidentia.llm.suffix_dedup import merge_runs, suffix_dedup, suffix_dedup_rows

DOC = "doc_id long, text string, doc long, mark int, spans string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], DOC)


def corpus(seed: int, n: int = 50) -> list[tuple]:
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "dé", "e.", "f|", "the", "of"]
    passages = [[rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(8, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randrange(5, 50)]
            parts += [rng.choice(words) + str(rng.randrange(99)) for _ in range(rng.randrange(12))]
        rows.append((rng.randrange(10**6), rng.choice([" ", " ", "\n"]).join(parts)))
    rows += [(-5, rows[0][1]), (2 * 10**6, rows[1][1]), (7, None), (8, ""), (9, " \t\n"), (10, "one two")]
    rows += [(11, "x" * 5000), (12, "x" * 300), (13, "ab " * 2000), (14, "zero\x00nul " * 30), (15, "zero\x00nul " * 30)]
    rows += [(None, rows[2][1]), (None, "x" * 400), rows[3]]  # null ids, a repeated row
    return rows


def brute(units: dict, window: int) -> dict:
    """units: (doc, sequence) by row; removed positions of each row."""
    first: dict = {}
    for doc, seq in units.values():
        if doc is not None:
            for s in range(len(seq) - window + 1):
                w = tuple(seq[s : s + window])
                first[w] = min(first.get(w, doc), doc)
    out = {}
    for row, (doc, seq) in units.items():
        gone = set()
        if doc is not None:
            for s in range(len(seq) - window + 1):
                if first[tuple(seq[s : s + window])] < doc:
                    gone.update(range(s, s + window))
        out[row] = gone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(spark, seed):
    rows = corpus(seed)
    units = {k: (i, (t or "").encode().split()) for k, (i, t) in enumerate(rows)}
    gone = brute(units, 13)
    want = sorted(
        (str(i), len(w), len(gone[k]), b" ".join(x for p, x in enumerate(w) if p not in gone[k]).decode())
        for k, (i, w) in units.items()
    )
    for more in ({}, {"group_rows": 3}, {"hot_prefix": 2}, {"filter_bits": 10}):
        got = substring_dedup(docs_of(spark, rows), **more).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    assert substring_dedup(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    units = {k: (i, (t or "").encode()) for k, (i, t) in enumerate(rows)}
    gone = brute(units, 50)
    want = sorted(
        (str(i), len(d), len(gone[k]), bytes(x for p, x in enumerate(d) if p not in gone[k]))
        for k, (i, d) in units.items()
    )
    got = suffix_dedup(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == want
    for r in got:
        assert r["n_removed"] == sum(s["b"] - s["a"] for s in r["spans"])
        assert all(x["b"] < y["a"] for x, y in zip(r["spans"], r["spans"][1:], strict=False))
    assert suffix_dedup(docs_of(spark, [])).count() == 0
    cut = suffix_dedup_rows(docs_of(spark, rows), n_chars="doc")
    assert cut.columns == ["doc_id", "text", "doc", "mark", "spans"] and cut.count() == len(rows)
    kept = sorted((str(r["doc_id"]), (r["text"] or "").encode(), r["doc"]) for r in cut.collect())
    texts = {k: bytes(x for p, x in enumerate(d) if p not in gone[k]).decode("utf-8", "ignore") for k, (_, d) in units.items()}
    assert [x[:2] for x in kept] == sorted((str(i), texts[k].encode()) for k, (i, _) in units.items())


def test_anchors_of_pieces_equal_those_of_whole_texts(monkeypatch):
    from evidentia.llm import repeats

    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 1 << 62, 4000, dtype=np.uint64) % np.uint64(300)
    offsets = np.array([0, 0, 3, 1500, 1510, 1523, 3900, 4000])
    shape = Shape(13, 4)

    def windows():
        out = {}
        for a in find_anchors(symbols, offsets, shape, lambda s: s * np.uint64(0x9E3779B97F4A7C15)):
            for at, first, last, doc in zip(a.at, a.first, a.last, a.doc, strict=True):
                for s in range(first, last + 1):
                    assert s <= at <= s + 9 and s not in out
                    out[s] = (at, doc)
        return out

    whole = windows()
    valid = {s for d in range(7) for s in range(offsets[d], offsets[d + 1] - 12)}
    assert set(whole) == valid
    monkeypatch.setattr(repeats, "PIECE", 256)
    assert windows() == whole


def test_merge_runs_is_a_sort_with_an_lcp_array():
    rng = random.Random(6)
    for k in (1, 2, 3, 5, 8, 9):
        runs = [sorted("".join(rng.choice("ab\0") for _ in range(rng.randrange(1, 9))).encode() for _ in range(rng.randrange(0, 40))) for _ in range(k)]

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        lcps = [[0, *[common(a, b) for a, b in zip(r, r[1:], strict=False)]][: len(r)] for r in runs]
        run, index, lcp = merge_runs(runs, lcps)
        out = [runs[r][i] for r, i in zip(run, index, strict=True)]
        assert out == sorted(x for r in runs for x in r)
        assert lcp == [0, *[common(a, b) for a, b in zip(out, out[1:], strict=False)]][: len(out)]


def test_merge_spans():
    assert merge_spans([(5, 9), (0, 2), (2, 4), (8, 20), (-3, 1)], 12) == [(0, 4), (5, 12)]
