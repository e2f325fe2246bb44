"""Column builders and pure functions, with goldens worked out by hand."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.config import UUID_NAMESPACE, Funnel, hnsw_ef_for
from evidentia.functions import text as X
from evidentia.functions.vectors import cell_topk_many, cosine, matryoshka, topk_many
from evidentia.operators import chunking, ingest
from evidentia.operators.sqlgate import query_sql, sql_is_allowed, validate_sql


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_funnel_and_over_fetch():
    assert (hnsw_ef_for(10), hnsw_ef_for(200), hnsw_ef_for(5000)) == (400, 800, 1000)
    with pytest.raises(ValueError):
        Funnel(c_wide=10, c_top=20)


@pytest.mark.parametrize(
    ("head", "normal", "kind"),
    [
        ("1. Introduction", "introduction", "Background Study"), ("3.1 Method", "method", "Methodology"),
        ("Experimental Results", "experimental results", "Result/Discussion"), ("Acknowledgements", "acknowledgements", "Other"),
        ("Chapter  Related   Work:", "related work", "Literature Review"), ("", "", "Other"), (None, "", "Other"), ("5. !!", "", "Other"),
        ("Conclusion and Future Work", "conclusion and future work", "Future Work"), ("Experimental Setup", "experimental setup", "Experiment"),
    ],
)
def test_section_heads(spark, head, normal, kind):
    assert one(spark, X.normalize_head(F.lit(head))) == normal
    assert one(spark, X.classify_section(F.lit(head))) == kind


def test_uuid5_is_the_standard_one(spark):
    want = str(uuid.uuid5(uuid.UUID(UUID_NAMESPACE), "2103.00020:Methodology:7"))
    assert one(spark, X.chunk_uuid(F.lit("2103.00020"), F.lit("Methodology"), F.lit(7))) == want


def test_cited_ids_in_order_without_versions(spark):
    u = "3b4365f9-1111-5222-8333-444444444444"
    text = f"As in 2103.00020v2 and [{u}], then 2103.00020 and {u} again; not 12345.67890 or 2103.000."
    assert one(spark, X.cited_ids(F.lit(text))) == ["2103.00020", u]


def test_numbers_quotes_and_estimate(spark):
    assert one(spark, X.numbers(F.lit("from -1,200.5 to +3 or 4."))) == [-1200.5, 3.0, 4.0]
    span = "this is a quoted span of enough length"
    assert one(spark, X.quoted_spans(F.lit(f'He said "{span}" and “{span}” but "short"'))) == [span, span]
    assert [one(spark, X.token_estimate(F.lit(t))) for t in (None, "", "abc", "a" * 9)] == [0, 0, 1, 2]


def test_wilson_golden(spark):
    low, high = X.wilson(F.lit(50), F.lit(100))
    assert one(spark, low) == pytest.approx(0.404, abs=1e-3) and one(spark, high) == pytest.approx(0.596, abs=1e-3)
    low, high = X.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)


@pytest.mark.parametrize(
    ("gold", "text", "ok"),
    [("12.5", "about 12.52", True), ("12.5", "12.9", False), ("1,200", "1200 rows", True), ("Exact  Match", "an exact match", True), ("red fox", "a fox, red", True), ("of", "fox", False), ("", "x", False)],
)
def test_value_matches(spark, gold, text, ok):
    assert one(spark, X.value_matches(F.lit(gold), F.lit(text))) is ok


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, cosine(a, b)) == pytest.approx(0.5**0.5)
    assert one(spark, cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    out = one(spark, matryoshka(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 6)]), 2))
    assert sum(x * x for x in out) == pytest.approx(1.0) and out[0] / out[1] == pytest.approx(2.0)


def test_topk_many_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([("q", [2.0, 0.1])], "query_id string, query array<double>")
    assert [(r["rank"], r["doc_id"]) for r in topk_many(rows, queries, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert topk_many(rows, queries.limit(0), 2).count() == 0 == topk_many(rows.limit(0), queries, 2).count()
    with pytest.raises(ValueError):
        topk_many(rows, queries, 2, max_queries=0)


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><front><p>no</p></front><body>
<div><head>1. Introduction</head><p>First <formula>x=y</formula>part <ref type="bibr">[1]</ref>stays <ref type="table">Table 2</ref>.</p>
<div><head>Sub</head><p>Nested  text</p></div><p> </p></div>
<div type="references"><head>References</head><p>gone</p></div><div><p>No head</p></div><div><head>Empty</head></div></body></text></TEI>"""


def test_tei_sections(spark):
    want = [("1. Introduction", ["First part stays Table 2.", "Nested text"]), ("", ["No head"])]
    assert chunking.tei_sections(TEI) == want
    for bad in (None, "", "<TEI", "<a/>", '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'):
        assert chunking.tei_sections(bad) == []
    files = spark.createDataFrame([("p1", TEI), ("p2", "<bad")], "arxiv_id string, xml string")
    rows = chunking.with_uuid(chunking.chunk_sections(chunking.typed_sections(chunking.extract_tei(files)), threshold=4)).orderBy("section_order").collect()
    assert [(r["arxiv_id"], r["section_type"], r["section_order"]) for r in rows] == [("p1", "Background Study", 0), ("p1", "Background Study", 1), ("p1", "Background Study", 2), ("p1", "Other", 3)]
    assert all(r["token_count"] <= 4 for r in rows)


def test_packer():
    p = chunking.Packer(threshold=3)
    assert p.pack(["a b", "c", "d", "e f g h i", "j"]) == ["a b\n\nc", "d", "e f g", "h i", "j"]
    assert p.pack([]) == [] and p.pack(["One two. Three four five. Six."]) == ["One two.", "Three four five.", "Six."]
    chars = chunking.Packer(count=len, threshold=4)
    assert chars.pack(["abcdefghij"]) == ["abcd", "efgh", "ij"]
    assert "".join(chunking.Packer(threshold=1).pack(["x" * 9000])) == "x" * 9000
    assert chunking.windows(["a b", "c d", "e f"], 4, 2) == ["a b c d", "c d e f"]


def test_html_sections():
    html = "<nav><li>menu</li></nav><article><h1>The <b>Head</b></h1><p>One<br>two<p>Three</p><ul><li>four</li></ul></article>"
    assert chunking.html_sections(html) == [("The Head", ["One two", "Three", "four"])]
    assert chunking.html_sections(None) == []


@pytest.mark.parametrize("word", "insert update delete drop alter create truncate grant revoke copy call do".split())
def test_gate_refuses_words(word):
    with pytest.raises(ValueError):
        validate_sql(f"SELECT '{word.upper()}' AS x")
    assert validate_sql(f"select {word}ed_at from t;") == f"select {word}ed_at from t"


@pytest.mark.parametrize("sql", [None, "", " ; ", "SELECT 1; SELECT 2", "SHOW TABLES", "EXPLAIN SELECT 1"])
def test_gate_refuses_statements(sql):
    with pytest.raises(ValueError):
        validate_sql(sql)


def test_gate_caps_rows(spark):
    assert query_sql(spark, "SELECT * FROM range(50)", row_cap=7).count() == 7
    assert sql_is_allowed(False, True) and not sql_is_allowed(True, True) and not sql_is_allowed(False, True, "flat")


def test_years():
    assert ingest.parse_years("15-18") == ["15", "16", "17", "18"] and ingest.parse_years("20") == ["20"]


def test_topk_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(60, 5)).round(1)
    points[40:] = points[7]  # a third of the rows are ties
    rows = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in enumerate(points)], "doc_id long, embedding array<double>")
    queries = rows.where("doc_id % 5 = 0").selectExpr("doc_id as query_id", "embedding as query")
    one = sorted(map(tuple, topk_many(rows, queries, 4).select("query_id", "rank", "doc_id").collect()))
    assert one == sorted(map(tuple, topk_many(rows, queries, 4, max_queries=3).select("query_id", "rank", "doc_id").collect()))
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    want = []
    for q in range(0, 60, 5):
        sims = (unit @ unit[q]).round(12)
        want += [(q, r, int(i)) for r, i in enumerate(sorted(range(60), key=lambda i: (-sims[i], i))[:4], 1)]
    got = {(q, r): i for q, r, i in one}
    assert all(round(float(unit[got[q, r]] @ unit[q]), 9) == round(float(unit[i] @ unit[q]), 9) for q, r, i in want)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_of_the_cell_index(spark, sf):
    """Over the whole stated query set, against the exact search: 0.9 and more."""
    from evidentia.plans.corpus_queries import r_ann_recall_lsh

    rows = r_ann_recall_lsh(spark, f"/root/testdata/sf{sf}").collect()
    assert len(rows) == -(-spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").count() // 20)
    assert sum(r["found"] for r in rows) >= 0.9 * sum(r["exact"] for r in rows)


def test_cell_index_with_one_hot_cell_and_nulls(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0] if k % 3 else None if k % 2 else [0.0, 1.0]) for k in range(40)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id long, query array<double>")
    got = cell_topk_many(rows, queries, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 1), (1, 2), (1, 4)]
    assert cell_topk_many(rows.limit(0), queries, 3).count() == 0 == cell_topk_many(rows, queries.limit(0), 3).count()


def test_cells_in_many_parts_equal_the_exact_search(spark, monkeypatch):
    """All cells looked at, in small parts of rows and of queries: the same rows; no pair is a row of a join."""
    from evidentia.functions import vectors

    monkeypatch.setattr(vectors, "TILE_ROWS", 5)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 3)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.unionByName(rows.where("vec_id < 20").withColumn("vec_id", F.col("vec_id") + 1000))  # ties
    queries = rows.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    found = cell_topk_many(rows, queries, 5, id_="vec_id", cells=4, probes=4, salts=1)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got, want = ({(r.query_id, r["rank"]): r.vec_id for r in x.collect()} for x in (found, topk_many(rows, queries, 5, id_="vec_id")))
    assert got == want
