"""Indexes of vectors and of words against plain searches."""

import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from evidentia.functions import vector_index as V
from evidentia.functions.vectors import recall_many, topk_many
from evidentia.operators import text_index as T


def embeddings(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    return rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_index_finds_nine_of_ten_with_a_tenth_compared(spark, tmp_path, sf):
    rows, queries = embeddings(spark, sf)
    built = V.build_index(rows, f"{tmp_path}/ix", id_="vec_id")
    index = V.open_index(spark, f"{tmp_path}/ix")
    assert (index.rows, index.probes) == (built.rows, built.probes) and (index.centres == built.centres).all()
    assert V.over_fetch(index, 10) < index.rows / 10
    found = V.index_topk(spark, index, queries, 10, id_="vec_id")
    both = recall_many(found, topk_many(rows, queries, 10, id_="vec_id"), "vec_id").agg(F.sum("found"), F.sum("exact")).first()
    assert both[0] >= 0.95 * both[1]
    assert index.table(spark).count() == rows.count()


def test_index_of_all_cells_and_candidates_is_exact(spark, tmp_path, monkeypatch):
    rows, queries = embeddings(spark, "sf0.001")
    rows = rows.unionByName(rows.where("vec_id < 50").withColumn("vec_id", F.col("vec_id") + 1000))  # ties
    index = V.build_index(rows, f"{tmp_path}/ix", id_="vec_id", sample_rows=100)
    want = {tuple(r)[:3] for r in topk_many(rows, queries, 5, id_="vec_id").select("query_id", "rank", "vec_id").collect()}
    for block in (10_000, 7):
        monkeypatch.setattr(V, "BLOCK", block)
        got = V.index_topk(spark, index, queries, 5, id_="vec_id", probes=len(index.centres), candidates=index.rows)
        assert {tuple(r)[:3] for r in got.select("query_id", "rank", "vec_id").collect()} == want


def test_index_of_few_and_no_rows(spark, tmp_path):
    kind = "vec_id long, embedding array<float>, label int"
    some = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, None, 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 2), (4, [0.0, 0.0], 2)], kind)
    asked = spark.createDataFrame([(7, [1.0, 0.2]), (8, None)], "query_id long, query array<float>")
    index = V.build_index(some, f"{tmp_path}/{uuid.uuid4()}", id_="vec_id")
    assert [(r.query_id, r["rank"], r.vec_id) for r in V.index_topk(spark, index, asked, 2, id_="vec_id", probes=9).orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 3)]
    none = V.build_index(some.limit(0), f"{tmp_path}/{uuid.uuid4()}", id_="vec_id")
    assert V.index_topk(spark, none, asked, 2, id_="vec_id").collect() == []
    assert V.index_topk(spark, index, asked.limit(0), 2, id_="vec_id").collect() == []


def words_of(text):
    return re.findall("[a-z0-9]+", text.lower())


def plain_scores(docs, query):
    fields = {d: [[T.stem(w) for w in words_of(t or "")] for t in texts] for d, *texts in docs if d is not None}
    asked, n = set(T.query_terms(query)), len(fields)
    mean = sum(len(f) for fs in fields.values() for f in fs) / n
    out = {}
    for d, fs in fields.items():
        size = sum(map(len, fs))
        for t in asked:
            weight = sum(w * f.count(t) for w, f in zip((1.0, 0.1), fs, strict=True))
            having = sum(any(t in f for f in other) for other in fields.values())
            if weight:
                share = weight * (T.K1 + 1) / (weight + T.K1 * (1 - T.B + T.B * size / mean))
                out[d] = out.get(d, 0) + math.log(1 + (n - having + 0.5) / (having + 0.5)) * share
    return sorted(((-round(s, 9), d) for d, s in out.items()))


def corpus(seed=4):
    rnd = random.Random(seed)
    words = "a aid aids city cities bus buses glasses class classes rare x1 das is".split()
    docs = [(n, " ".join(rnd.choices(words, k=3)), " ".join(rnd.choices(words, k=rnd.randrange(40)))) for n in range(0, 400)]
    docs += [(-7, "rare", "Cities, CITY!\nbus"), (2_000_000, None, None), (2_000_001, "", "rare " * 300), (None, "rare", "rare")]
    return docs + [(n + 5_000, t, x) for n, t, x in docs[:40]]  # ties


def test_ranked_search_equals_a_scan_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 16)
    docs = corpus()
    docs += [(100_000 + n, "seldom" if n < 20 else "x1", "x1 aid " * 30) for n in range(400)]
    T.build_text_index(spark.createDataFrame(docs, "doc_id long, title string, text string"), f"{tmp_path}/t", {"title": 1.0, "text": 0.1})
    index = T.open_text_index(spark, f"{tmp_path}/t")
    for query, k in (("city aids", 10), ("rare rares glasses of", 25), ("seldom x1", 5), ("a is das", 2000), ("class", 0)):
        got, counts = T.ranked(spark, index, query, k, first_blocks=2)
        want = plain_scores(docs, query)[:k]
        assert [(r.id, r.score) for r in got.orderBy("pos").collect()] == [(d, pytest.approx(-s, abs=2e-9)) for s, d in want]
        assert counts["scored"] <= counts["blocks"]
        if query == "seldom x1":
            assert counts["scored"] < counts["blocks"] / 2
    assert T.search(spark, index, "nowhere", 5).collect() == T.search(spark, index, " ?! ", 5).collect() == []


def test_phrases_equal_a_scan(spark, tmp_path):
    docs = corpus(6)
    index = T.build_text_index(spark.createDataFrame(docs, "doc_id long, title string, text string"), f"{tmp_path}/t", {"title": 1.0, "text": 0.1})
    for phrase in ("city bus", "a a", "cities aid a", "rare", "bus nowhere", ""):
        terms = T.query_terms(phrase)
        want = {}
        for d, *fields in docs:
            stems = [[T.stem(w) for w in words_of(f or "")] for f in fields]
            times = sum(s[k : k + len(terms)] == terms for s in stems for k in range(len(s))) if terms else 0
            if times and d is not None:
                want[d] = times
        assert {r.id: r.times for r in T.phrase(spark, index, phrase).collect()} == want


def test_text_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, title string, text string")
    index = T.build_text_index(none, f"{tmp_path}/t", {"title": 1.0, "text": 0.1})
    assert T.search(spark, index, "a", 3).collect() == T.phrase(spark, index, "a").collect() == []


def test_chunks_of_a_block_from_several_batches_are_one_row(spark, tmp_path):
    """Documents out of order, over many tasks: every term has one row a block, its documents in order."""
    docs = [d for d in corpus(8) if d[0] is not None]
    random.Random(1).shuffle(docs)
    rows = spark.createDataFrame(docs, "doc_id long, title string, text string").repartition(7)
    index = T.build_text_index(rows, f"{tmp_path}/t", {"title": 1.0, "text": 0.1})
    table = spark.read.schema(T.POSTINGS).parquet(f"{index.path}/postings").collect()
    assert len({(r.term, r.block) for r in table}) == len(table)
    for r in table:
        assert r.ids == sorted(set(r.ids)) and r.documents == len(r.ids) == len(r.weight) == len(r.length) == len(r.starts) - 1
        assert r.starts[0] == 0 and r.starts[-1] == len(r.places) and r.starts == sorted(set(r.starts))


def test_batches_of_texts_are_bounded_while_an_index_is_built(spark, tmp_path, monkeypatch):
    """Long texts reach a worker in small batches, not ten thousand at a time."""
    name, largest = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sparkContext.accumulator(0)
    before, chunks = spark.conf.get(name, None), T._chunks

    def counted(weights):
        run = chunks(weights)

        def watch(batches):
            for batch in batches:
                if batch.nbytes > 12 << 20:
                    largest.add(1)
                yield from run(iter([batch]))

        return watch

    monkeypatch.setattr(T, "_chunks", counted)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("many of the words "), 5_000).alias("text"))
    index = T.build_text_index(docs, f"{tmp_path}/t", {"text": 1.0})
    assert largest.value == 0 and spark.conf.get(name, None) == before
    assert T.phrase(spark, index, "of the").agg(F.count("*"), F.sum("times")).first()[:] == (400, 400 * 5_000)


def test_an_index_without_positions_ranks_alike(spark, tmp_path):
    docs = spark.createDataFrame(corpus(5), "doc_id long, title string, text string")
    fields = {"title": 1.0, "text": 0.1}
    whole = T.build_text_index(docs, f"{tmp_path}/whole", fields)
    T.build_text_index(docs, f"{tmp_path}/ranked", fields, positions=False)
    ranked = T.open_text_index(spark, f"{tmp_path}/ranked")
    for query in ("city aids", "rare rares glasses of"):
        rows = T.search(spark, whole, query, 50).collect()
        assert rows and rows == T.search(spark, ranked, query, 50).collect()
    table = spark.read.schema(T.POSTINGS).parquet(f"{ranked.path}/postings")
    assert table.agg(F.max(F.size("places")), F.min(F.size("starts") - F.size("ids"))).first()[:] == (0, 1)
    with pytest.raises(ValueError):
        T.phrase(spark, ranked, "a a")
