"""Classifier, decontamination, edited token counts and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm.bpe import codec
from evidentia.llm.decontaminate import consistency, contaminated, decontaminate
from evidentia.llm.quality import FEATURES, features, fit, fit_quality, quality_filter, score_quality
from evidentia.llm.queries import example_edits, op8_quality, table, word_bpe
from evidentia.llm.token_counts import build_trees, token_counts

SF = "/root/testdata/sf0.001"
ITEM = "The Zorvan rocket flew 120 km in 45 minutes while Captain Melor watched the silver coast below and waved twice"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, slots string")


def found_in(spark, texts, items=(ITEM,)):
    docs = documents(spark, [(k, t, "i", "s") for k, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}


def test_contaminated_copies_and_changed_questions(spark):
    changed = ITEM.replace("120", "300").replace("45", "77").replace("km", "miles").replace("Melor", "Quand")
    wrong = "rocket flew 5 km in 9 minutes. " * 3
    got = found_in(spark, [
        f"before this. {ITEM}. after that", changed, f"see. {ITEM.upper()} end", "nothing of the kind is here at all today", None, "", wrong,
        ITEM.split("while")[0], f"a{ITEM}", " ".join([ITEM + "."] * 40),
    ])
    assert got[0, 0]["coverage"] == 1.0 and not got[0, 0]["reparameterised"] and got[0, 0]["consistency"] == 1.0
    assert got[1, 0]["coverage"] == 1.0 and got[1, 0]["reparameterised"] and got[1, 0]["slots"] > 0
    assert (8, 0) in got and (9, 0) in got
    assert not {3, 4, 5, 6} & {d for d, _ in got}


def test_inconsistent_slots_are_told_apart():
    same = [(5 + k, k, [str(7), "9"], ["1", "2"]) for k in range(6)]
    assert consistency(same) == (12, 1.0, True)
    mixed = [(5 + k, k, [str(k)], ["1"]) for k in range(6)]
    assert consistency(mixed)[1] == pytest.approx(1 / 6)
    assert consistency([(0, 0, [], [])]) == (0, 1.0, False)


def test_contaminated_equals_plain_windows(spark):
    """On the given tables, against a search for eight equal words in a row."""
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    words = lambda t: re.findall(r"[^\W\d_]+|\d+", t.lower())
    grams = {}
    total = {}
    for i, t in bench.collect():
        w = words(t)
        total[i] = len(w) - 7
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add((i, k))
    want = {}
    for r in docs.collect():
        w = words(r["text"] or "")
        for k in range(len(w) - 7):
            for i, at in grams.get(tuple(w[k : k + 8]), ()):
                want.setdefault((r["doc_id"], i), set()).add(at)
    want = {p for p, at in want.items() if len(at) >= 0.5 * total[p[1]]}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert want and got == want
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in want})


def test_contaminated_edges(spark):
    docs = documents(spark, [(None, ITEM, "i", "s"), (1, ITEM, "i", "s"), (1, ITEM, "i", "s"), (2, "short one here now", "i", "s")])
    bench = spark.createDataFrame([(0, ITEM), (None, ITEM), (3, None), (4, ""), (5, "short one here now"), (6, "12 13")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect())
    assert got == [(1, 0), (2, 5)]
    assert contaminated(docs.limit(0), bench).count() == 0 == contaminated(docs, bench.limit(0)).count()
    assert decontaminate(docs, bench.limit(0)).count() == 4


def test_token_tree_equals_full_encoding():
    own, library, rng = codec(word_bpe()), Tokenizer.from_file(word_bpe()), random.Random(8)
    letters = "abcdeth  in'ts.,!  \n\té1"
    for size in (0, 1, 5, 300, 3000):
        text = "".join(rng.choice(letters) for _ in range(size))
        tree = build_trees(own, [text], leaf=3)[0]
        assert tree.whole() == text
        for _ in range(25):
            a = rng.randrange(len(text) + 3)
            b = a + rng.randrange(0, 12)
            new = "".join(rng.choice(letters) for _ in range(rng.randrange(8)))
            tree.settle(int(own.count([tree.edit(a, b, new)])[0]))
            text = text[:a] + new + text[b:]
            assert tree.whole() == text and tree.chars[1] == len(text)
            assert tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        if size == 3000:
            assert tree.reencoded < 25 * size / 8


def test_token_counts_query_equals_full_encoding(spark):
    library = Tokenizer.from_file(word_bpe())
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 20000), (None, "a b"), (0, "again")], "doc_id long, text string")
    )
    edited = docs.withColumn("edits", example_edits())
    rows = edited.collect()
    out = token_counts(edited, word_bpe(), edits="edits").collect()
    want = []
    for r in rows:
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        for e in r["edits"]:
            t = t[: e["start"]] + (e["text"] or "") + t[e["stop"] :]
        want.append((str(r["doc_id"]), n, len(library.encode(t, add_special_tokens=False).ids), len(t)))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in out) == sorted(want)
    plain = token_counts(docs, word_bpe())
    assert plain.columns == ["doc_id", "n_tokens"] and plain.count() == docs.count()


def test_gam_learns_mains_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:4000], y[:4000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[4000:]) > 0.5) == y[4000:]).mean() > 0.95
    z = (x[:, 2] > 0.3).astype(float)
    assert ((fit(x[:4000], z[:4000]).scores(x[4000:]) > 0.5) == z[4000:]).mean() > 0.98


def test_gam_without_rows_or_with_one_class():
    assert fit(np.empty((0, 2)), np.empty(0)).scores(np.zeros((1, 2))).tolist() == [0.5]
    assert fit(np.ones((5, 2)), np.ones(5)).scores(np.ones((1, 2)))[0] > 0.8


def test_features_of_any_text():
    for text in (None, "", "\x00", "é" * 5, "a b\n" * 9, "!" * 40_000):
        assert len(features(text)) == len(FEATURES) and np.isfinite(features(text)).all()


def test_quality_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op8_quality(spark, sf).collect()}
    docs = table(spark, sf, "documents")
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in table(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_quality_edges(spark):
    docs = documents(spark, [(1, None, "i", "s"), (2, "", "i", "s"), (None, "good text here.", "i", "s"), (1, "again", "i", "s")])
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    assert score_quality(docs, model).count() == 4
    assert score_quality(docs.limit(0), model).count() == 0
    assert fit_quality(docs, labels.limit(0)).base == 0.0
    kept = quality_filter(docs, labels.limit(0), threshold=0.5)
    assert kept.columns == docs.columns and kept.count() == 4


def five_words(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_pipeline_stages_equal_brute_force(spark):
    """Every stage against a plain one, on the stage's own input."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding",
    ]
    docs = table(spark, SF, "documents")
    before = docs.collect()
    fitted = fit_quality(docs, table(spark, SF, "labels"))
    score = {r["doc_id"]: r["score"] for r in score_quality(docs, fitted).collect()}

    def step(name, frame):
        out = stages[name](spark, frame, SF)
        rows = out.collect()
        if name != "BPE encoding and decoding":
            assert out.columns == docs.columns and out.schema == docs.schema
        return spark.createDataFrame(rows, out.schema), sorted(rows, key=lambda r: r["doc_id"])

    frame, kept = step("quality classifier", docs)
    assert [r["doc_id"] for r in kept] == sorted(r["doc_id"] for r in before if score[r["doc_id"]] >= 0.3)
    sets = {r["doc_id"]: five_words(r["text"]) for r in kept}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in sets.items():
        for j, q in sets.items():
            if i < j and len(p & q) >= 0.8 * len(p | q) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    frame, kept_near = step("SimHash near-dedup", frame)
    assert [r["doc_id"] for r in kept_near] == [i for i in sets if root(i) == i]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in kept_near}
    first = {}
    for i, t in texts.items():
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], i), i)
    frame, cut = step("suffix-array dedup", frame)
    for r in cut:
        t, gone = texts[r["doc_id"]], set()
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < r["doc_id"]:
                gone.update(range(s, s + 50))
        assert (r["text"] or "") == bytes(x for p, x in enumerate(t) if p not in gone).decode("utf-8", "ignore")
        assert r["n_chars"] == len(r["text"])
    leaks = {r["doc_id"] for r in contaminated(frame, table(spark, SF, "benchmark")).collect()}
    frame, clean = step("benchmark decontamination", frame)
    assert [r["doc_id"] for r in clean] == [r["doc_id"] for r in cut if r["doc_id"] not in leaks]
    _, out = step("BPE encoding and decoding", frame)
    library = Tokenizer.from_file(word_bpe())
    for r, d in zip(out, clean, strict=True):
        assert r["ids"] == library.encode(d["text"], add_special_tokens=False).ids
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", F.size("ids")).collect())) == [(r["doc_id"], len(r["ids"])) for r in out]
