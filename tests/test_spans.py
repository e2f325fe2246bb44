"""Overlapping spans against all pairs."""

import random

import pytest

from evidentia.operators import spans as S


@pytest.mark.parametrize("size", [1, 7, 512])
def test_overlaps_equal_all_pairs(spark, size):
    rnd = random.Random(2)

    def some(n):
        rows = [(rnd.randrange(3), k, a := rnd.randrange(90), a + rnd.randrange(-1, 30)) for k in range(n)]
        return rows + [(0, n, 0, 90), (0, n + 1, 5, 5), (1, n + 2, None, 4), (None, n + 3, 1, 4), (2, 0, 3, 9)]

    left, right = some(60), some(80)
    kind = "doc long, nth long, start long, stop long"
    got = S.overlap_join(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["doc"], size)
    want = [
        (*a, *b[1:]) for a in left for b in right
        if a[0] is not None and a[0] == b[0] and None not in (a[2], b[2]) and max(a[2], b[2]) < min(a[3], b[3])
    ]
    names = ["doc", "nth", "start", "stop", "nth_right", "start_right", "stop_right"]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want)


def test_tokens_of_lines(spark):
    text = "ab c\n\n de f  g\nh"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc long, text string")
    lines, words = S.pieces(docs, "doc", "text", "\n"), S.pieces(docs, "doc", "text", " ")
    assert [(r.start, r.stop) for r in lines.where("doc = 1").orderBy("nth").collect()] == [(0, 4), (5, 5), (6, 14), (15, 16)]
    got = S.token_spans(lines, words, "doc", ["nth"], size=4)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 1, 2), (1, 2, 2, 5, 3), (1, 3, 5, 5, 1)]


def test_one_text_with_very_many_spans(spark):
    rows = spark.range(40_000).selectExpr("0L AS doc", "id AS nth", "id * 3 AS start", "id * 3 + 4 AS stop")
    assert S.overlap_join(rows, rows, ["doc"]).count() == 40_000 * 3 - 2
