"""Every stage on nulls, empty and long texts, repeated rows, clashing columns and an empty table."""

import pytest

import corpus_pipeline
from evidentia.llm.queries import table

SF = "/root/testdata/sf0.001"
KIND = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, ids string, node string, mark int, "
    "doc string, _lost string, _found string, score string, label string, words string, fp string"
)
CLASH = ("row", "spans", "ids", "node", 1, "doc", "_lost", "_found", "score", "label", "words", "fp")


def rows(spark):
    given = [tuple(r)[:5] for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").limit(40).collect()]
    passage = " ".join(f"wort{k}" for k in range(60))
    odd = [
        (1000, None, "de", None, None), (1001, "", None, "s", 0), (1002, " \n\t ", "de", "s", 4), (None, passage, "de", "s", len(passage)), (None, None, None, None, None),
        (1003, "x" * 30_000, "de", "s", 30_000), (1004, passage, "de", "s", len(passage)), (1004, passage, "de", "s", len(passage)), (1004, "another text of the same id", "de", "s", 27),
        (1005, f"vorher {passage} nachher", "de", "s", 1), (1006, "straße 😀 " * 400, "de", "s", 1),
    ]
    return [(*r, *CLASH) for r in given + odd]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    data = rows(spark)
    docs = spark.createDataFrame(data, KIND)
    out = stage(spark, docs, SF)
    got = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    if last:
        assert len(got) == len(data) and all(r["ids"] is not None and r["decoded"] is not None for r in got)
    else:
        assert out.columns == docs.columns and out.schema == docs.schema
        assert all(tuple(r)[5:] == CLASH for r in got) and len(got) <= len(data)
    ids = [r["doc_id"] for r in got]
    if name == "SimHash near-dedup":
        assert ids.count(1004) == 3 and ids.count(None) == 2 and 1000 in ids and not {1001, 1002} & set(ids)
    if name == "suffix-array dedup":
        text = {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None}
        assert len(got) == len(data) and text[1000] is None and "wort30" not in text[1005] and text[1005].startswith("vorher")
        assert [r["text"] for r in got if r["doc_id"] is None and r["text"]] == [data[43][1]]
    if name == "benchmark decontamination":
        assert {1000, 1001, 1003, None} <= set(ids)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, name):
    docs = spark.createDataFrame([], KIND)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0


def test_simhash_dedup_with_clashing_columns(spark):
    from evidentia.llm.simhash import simhash_dedup

    data = rows(spark)
    docs = spark.createDataFrame(data, KIND)
    out = simhash_dedup(docs)
    ids = [r["doc_id"] for r in out.collect()]
    # A row stays with its id, so several texts of one id stay or go together.
    assert out.columns == docs.columns and ids.count(None) == 2 and not {1001, 1002} & set(ids)
