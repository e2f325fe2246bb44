"""Token trees under many edits, and edits with nulls."""

import random

import pytest
from tokenizers import Tokenizer

from evidentia.llm.bpe import codec
from evidentia.llm.queries import word_bpe
from evidentia.llm.token_counts import build_trees, cut_leaves, token_counts


@pytest.mark.parametrize("place", ["one", "any", "end"])
def test_many_insertions_reencode_little(place):
    """Leaves are cut again: 2,000 insertions at one place stay cheap."""
    own, rng = codec(word_bpe()), random.Random(4)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(1000))
    tree = build_trees(own, [text])[0]
    for _ in range(2000):
        at = {"one": 2000, "any": rng.randrange(len(text) + 1), "end": len(text)}[place]
        new = rng.choice([" ab ", "xyz ", " 12.", "\n"])
        part = tree.edit(at, at, new)
        tree.settle_leaves(*cut_leaves(own, [part])[0])
        text = text[:at] + new + text[at:]
    assert tree.whole() == text and tree.chars[1] == len(text)
    assert tree.n_tokens == int(own.count([text])[0])
    assert tree.reencoded < 2000 * 400  # two leaves of sixteen short words each


def test_deletions_and_refills():
    own, library, rng = codec(word_bpe()), Tokenizer.from_file(word_bpe()), random.Random(6)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(500))
    tree = build_trees(own, [text], leaf=2)[0]
    for _ in range(120):
        a = rng.randrange(len(text) + 1)
        b = a + rng.choice([0, 3, 200])
        new = " ".join("n" * rng.randrange(5) for _ in range(rng.choice([0, 1, 60])))
        tree.settle_leaves(*cut_leaves(own, [tree.edit(a, b, new)], leaf=2)[0])
        text = text[:a] + new + text[b:]
        assert tree.whole() == text
        assert tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
    tree.settle_leaves(*cut_leaves(own, [tree.edit(None, None, None)])[0])
    assert tree.whole() == "" and tree.n_tokens == 0


def test_null_edits_and_clashing_columns(spark):
    kind = "doc_id long, text string, n_tokens string, key int, edits array<struct<start: int, stop: int, text: string>>"
    rows = [
        (1, "one two three", "x", 7, [None, (None, 4, "A "), (2, None, None)]),
        (2, "one two", "x", 7, None),
        (3, None, "x", 7, [(5, 9, "new text")]),
        (None, "one two", "x", None, [(-3, 2, None)]),
    ]
    out = token_counts(spark.createDataFrame(rows, kind), word_bpe(), edits="edits").collect()
    own = codec(word_bpe())
    want = {1: "A ", 2: "one two", 3: "new text", None: "e two"}
    got = {r["doc_id"]: (r["n_tokens_edited"], r["n_chars_edited"]) for r in out}
    assert got == {k: (int(own.count([t])[0]), len(t)) for k, t in want.items()}
    assert token_counts(spark.createDataFrame([], kind), word_bpe(), edits="edits").count() == 0
