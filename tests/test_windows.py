"""Windows of texts against the list function."""

import random

import pytest

from evidentia.operators import windows as W
from evidentia.operators.chunking import windows


@pytest.mark.parametrize("budget,overlap", [(6, 2), (5, 4), (30, 0)])
def test_windows_equal_the_list_function(spark, budget, overlap):
    rnd = random.Random(budget)
    texts = ["\n".join(" ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(30))) for _ in range(40)]
    texts += ["", " \n\t\n", None, "one line"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in W.unit_windows(docs, budget=budget, overlap=overlap).orderBy("doc_id", "nth").collect():
        got.setdefault(r.doc_id, []).append(" ".join(x for x in r.text[r.start : r.stop].split("\n") if x.strip()))
        assert r.tokens == len(r.text[r.start : r.stop].split())
    for k, text in enumerate(texts):
        assert got.get(k, []) == windows([x for x in (text or "").split("\n") if x.strip()], budget, overlap)


def test_sentences_and_bounds(spark):
    docs = spark.createDataFrame([(1, "A b. C d!  E f? G")], "doc_id long, text string")
    rows = W.unit_windows(docs, budget=4, overlap=2, separator=W.SENTENCES).orderBy("nth").collect()
    assert [r.text[r.start : r.stop] for r in rows] == ["A b. C d!", "C d!  E f?", "E f? G"]
    with pytest.raises(ValueError):
        W.unit_windows(docs, budget=4, overlap=4)
