"""Operators on small literal tables, ties and nulls included."""

import json
import math

import pytest
from pyspark.sql import functions as F

from evidentia.operators import claims, eventlog, evaluation, graph, ingest, retrieval
from evidentia.sources import tables


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_ndcg_golden(spark):
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1), ("z", "a", 1)], "query_id string, doc_id string, rel int")
    ranking = spark.createDataFrame([("m", "q", 1, "a"), ("m", "q", 2, "c"), ("m", "q", 3, "b")], "config string, query_id string, rank int, doc_id string")
    out = {r["query_id"]: r for r in evaluation.score_queries(ranking, qrels).collect()}
    assert out["q"]["ndcg"] == pytest.approx(9.130929 / 9.392789, abs=1e-6)
    assert (out["z"]["ndcg"], out["z"]["rr"]) == (0.0, 0.0)
    assert evaluation.score_config(evaluation.score_queries(ranking, qrels)).first()["queries"] == 2


def test_recall_mrr_precision_golden(spark):
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 0), ("q", "c", 1)], "query_id string, doc_id string, rel int")
    ranking = spark.createDataFrame([("m", "q", 1, "b"), ("m", "q", 2, "c"), ("m", "q", 3, "a")], "config string, query_id string, rank int, doc_id string")
    r = evaluation.score_queries(ranking, qrels, k=3).first()
    assert (r["recall"], r["rr"], r["precision"]) == (1.0, 0.5, pytest.approx(2 / 3))
    assert evaluation.score_queries(ranking, qrels, k=1).first()["recall_k"] == 0.0


def test_kappa_undefined_is_nan(spark):
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert math.isnan(evaluation.kappa(same, "a", "b").first()["kappa"])
    assert evaluation.kappa(spark.createDataFrame([(1, 1), (0, 0)], "a int, b int"), "a", "b").first()["kappa"] == 1.0


def test_oolong_golden(spark):
    score = evaluation.oolong_score(F.lit("5"), F.lit("7"), F.lit("numeric"))
    assert spark.range(1).select(score.alias("x")).first()["x"] == pytest.approx(0.75**2)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = ingest.upsert(old, new, "k")
    assert rows_of(once, "k", "v") == [(1, "a"), (2, "B"), (3, "C")] == rows_of(ingest.upsert(once, new, "k"), "k", "v")


def test_manifest_and_sources(spark, tmp_path):
    lines = [
        {"id": "2101.00001", "categories": "cs.CL cs.AI", "versions": [{"version": "v1"}, {"version": "v2"}], "doi": "d"},
        {"id": "0901.00001", "categories": "cs.AI", "versions": [{"version": "v1"}]}, {"id": "2101.00002", "categories": "math", "versions": [{"version": "v1"}]},
        {"id": "2101.00003", "categories": "cs.AI", "versions": []}, {"id": "2101.00004", "categories": "xcs.AIx", "versions": [{"version": "v1"}]},
    ]
    path = tmp_path / "meta.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    (tmp_path / "tei").mkdir()
    for name in ("2101.00001v2.tei.xml", "2101.00004v1.tei.xml", "other.txt"):
        (tmp_path / "tei" / name).write_text("<x/>")
    tables.probe_metadata(spark, str(path))
    out = ingest.build_manifest(tables.metadata(spark, str(path)), tables.markup_files(spark, str(tmp_path / "tei")))
    assert rows_of(out, "arxiv_id", "version", "categories") == [("2101.00001", "v2", ["cs.CL", "cs.AI"]), ("2101.00004", "v1", ["xcs.AIx"])]
    bad = tmp_path / "bad.jsonl"
    bad.write_text("nope\n")
    with pytest.raises(ValueError):
        tables.probe_metadata(spark, str(bad))
    qrels = tmp_path / "q.csv"
    qrels.write_text("query_id,doc_id,rel\nq,a,1\nq,a,2\n")
    assert rows_of(tables.qrels(spark, str(qrels)), "query_id", "doc_id", "rel") == [("q", "a", 2)]


def test_schema_is_created_once(spark):
    ingest.apply_schema(spark)
    ingest.apply_schema(spark)
    assert ingest.tables_exist(spark) == {"papers": True, "chunks": True}
    ingest.drop_schema(spark)
    assert ingest.tables_exist(spark) == {"papers": False, "chunks": False}


def test_rerank_is_stable_on_ties(spark):
    papers = spark.createDataFrame([("a", "red fox"), ("b", "fox red"), ("c", None), ("d", "red")], "arxiv_id string, abstract string")
    pos = spark.createDataFrame([(1, "b"), (2, "c"), (3, "a"), (4, "d")], "pos int, arxiv_id string")
    got = retrieval.rerank_papers(papers, pos, "Red, fox!", 3).orderBy("pos").collect()
    assert [(r["arxiv_id"], r["score"]) for r in got] == [("b", 1.0), ("a", 1.0), ("d", 0.5)]
    assert retrieval.rerank_papers(papers, pos, " ", 0).count() == 0
    assert retrieval.format_query([("x", [" a ", ""]), ("y", ["b"])]) == "a b"


def test_rrf_ties_follow_the_first_list(spark):
    ranked = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c")], "list int, rank int, doc_id string")
    assert [r["doc_id"] for r in retrieval.rrf(ranked).orderBy("rank").collect()] == ["a", "b", "c"]


T = "ord long, head string, head_type string, relation string, tail string, tail_type string, score double, chunk_uuid string, arxiv_id string"


def triples(spark, rows):
    return spark.createDataFrame([(i, h, "Method", r, t, "Method", s, c, "p") for i, (h, r, t, s, c) in enumerate(rows)], T)


def test_direction_pairs(spark):
    rows = triples(spark, [
        ("A", "outperforms", "B", 0.4, "c"), ("B", "outperforms", "a", 0.9, "c"), ("A", "outperforms", "A", 1.0, "c"), ("A", "outperforms", "B", 0.9, "d"),
        ("B", "outperforms", "A", 0.9, "d"), ("A", "compares_to", "B", 0.3, "c"), ("B", "compares_to", "A", 0.3, "c"), ("A", "uses", "B", None, "c"),
    ])
    assert [r[0] for r in rows_of(graph.resolve_pairs(rows), "ord")] == [1, 3, 5, 7]


def test_cycles_lose_their_weakest_edge(spark):
    rows = triples(spark, [("A", "extends", "B", 0.9, "c"), ("B", "extends", "C", 0.2, "c"), ("C", "extends", "A", 0.5, "c"), ("C", "uses", "A", 0.1, "c"), ("B", "extends", "C", 0.2, "d")])
    assert [r[0] for r in rows_of(graph.break_cycles(rows), "ord")] == [0, 2, 3, 4]
    assert graph.find_cycle({"a": ["b"], "b": ["c"], "c": []}) is None


def test_roles_ontology_and_spans(spark):
    rows = triples(spark, [("HotpotQA", "outperforms", "X", 1.0, "c"), ("X", "improves", "Y", 1.0, "c"), ("it", "uses", "Y", 1.0, "c"), ("X net", "uses", "Y net", 1.0, "c")])
    assert [r[0] for r in rows_of(rows.where(graph.role_ok()), "ord")] == [1, 2, 3]
    assert [r[0] for r in rows_of(graph.filter_ontology(rows), "ord")] == [0, 2, 3]
    assert [r[0] for r in rows_of(graph.filter_spans(rows), "ord")] == [0, 1, 3]
    got = {x: spark.range(1).select(graph.normalize_relation(F.lit(x)).alias("x")).first()["x"] for x in ("uses", "Used for", "beats", "odd-one")}
    assert got == {"uses": "uses", "Used for": "uses", "beats": "outperforms", "odd-one": "odd_one"}


def test_graph_of_few_triples(spark):
    rows = graph.with_soft_defaults(
        triples(spark, [("A", "uses", "B", 0.1, "c"), ("a ", "uses", "b", 0.2, "d"), ("B", "uses", "B", 0.3, "c")])
        .withColumns({f"{s}_type_{k}": F.lit(None).cast(t) for s in ("head", "tail") for k, t in (("source", "string"), ("confidence", "double"))})
    )
    kept = graph.dedup(rows)
    assert [r[0] for r in rows_of(kept, "ord")] == [0, 2]
    n, e = graph.nodes(kept), graph.edges(kept)
    assert rows_of(n, "key", "display") == [("a", "A"), ("b", "B")]
    assert rows_of(graph.degrees(e), "key", "degree") == [("a", 1), ("b", 3)]
    assert graph.neighbors(e, " B", direction="both").count() == 2 and graph.neighbors(e, "nobody").count() == 0
    assert graph.match(e, head="A", tail="b").count() == 1
    with pytest.raises(ValueError):
        graph.neighbors(e, "b", direction="up")
    doc = json.loads(graph.to_nodelink(n, e).first()["json"])
    assert len(doc["nodes"]) == 2 and len(doc["links"]) == 2


def test_direction_verification(spark):
    texts = spark.createDataFrame([("c", "Alpha outperforms Beta. Gamma does not use Delta."), ("d", "Nothing here.")], "chunk_uuid string, chunk_text string")
    rows = triples(spark, [("Alpha", "outperforms", "Beta", 1.0, "c"), ("Beta", "outperforms", "Alpha", 1.0, "c"), ("Gamma", "uses", "Delta", 1.0, "c"), ("P", "extends", "Q", 1.0, "d")])
    rows = rows.withColumn("direction_margin", F.lit(0.5) + F.col("ord") / 10)

    def judge(state, head, tail):
        return {"Beta": ("ba", 0.9), "Gamma": ("neither", 0.9)}.get(head, ("ab", 0.5))

    out = {r["ord"]: r for r in graph.verify_direction(rows, texts, judge).collect()}
    assert set(out) == {0, 1, 3}
    assert (out[0]["direction_source"], out[1]["direction_source"], out[3]["direction_source"]) == ("cue", "judge", "judge_uncertain")
    assert (out[1]["head"], out[1]["tail"]) == ("Alpha", "Beta") and out[3]["direction_verified"] is False
    late = {r["ord"]: r["direction_source"] for r in graph.verify_direction(rows, texts, judge, budget=1).collect()}
    assert late[2] == late[3] == "unverified"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_claim_units(spark):
    def units(text, **more):
        return value(spark, claims.claim_units(F.lit(text).cast("string"), **more))

    u = "3b4365f9-1111-5222-8333-444444444444"
    text = f"Intro line without ids.\n- The first finding holds [{u}]\n  and goes on.\n- {u}\n- Second finding is here 2101.00001v3.\n"
    got = units(text)
    assert [x.ids for x in got] == [[u], ["2101.00001"]] and got[0].text.endswith("and goes on.")
    assert [x.ids for x in units("No ids at all here.")] == [[]]
    assert units("") == [] == units(None)
    long = "This line states twelve words or more and it cites nothing at all."
    assert [x.text for x in units(f"{long}\n# Heading words {long}\nLabel:\n", include_uncited=True)] == [long]
    assert value(spark, claims.without_gaps(F.lit("a\n\n**Could not support.** x\n- y"))) == "a"
    assert value(spark, claims.without_gaps(F.lit("it is unsupported here."))) == "it is unsupported here."
    ids = F.array(F.lit("2101.00001"), F.lit("zz"))
    text = F.lit("One two three four five six seven eight 2101.00001. Short one. " + "w " * 60)
    parts = value(spark, claims.split_long(F.array(F.struct(text.alias("text"), ids.alias("ids")))))
    assert parts[0].ids == ["2101.00001"] and parts[0].text.endswith("Short one.")


def test_short_and_merged_ids(spark):
    known = spark.createDataFrame([("3b4365f9-1111-5222-8333-444444444444",), ("3b4365f9-2222-5222-8333-444444444444",), ("aa11bb22-2222-5222-8333-444444444444",)], "id string")
    tokens = spark.createDataFrame([("3b4365f9",), ("aa11bb22",), ("ffffff1",)], "token string")
    assert rows_of(claims.expand_short_ids(tokens, known), "token", "id") == [("3b4365f9", None), ("aa11bb22", "aa11bb22-2222-5222-8333-444444444444"), ("ffffff1", None)]
    cited = spark.createDataFrame([("AA11bb22-0000-5222-8333-444444444444",), ("3b4365f9-0000-5222-8333-444444444444",), ("aa11bb22-2222-5222-8333-444444444444",)], "token string")
    assert sorted(r["status"] for r in claims.repair_ids(cited, known).collect()) == ["merged", "resolved", "unresolved"]


def test_budget_selection_passes_over_large_items(spark):
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).cast("long").alias("cost")) for i, c in enumerate((5, 9, 3, 2, 1))])
    assert spark.range(1).select(eventlog.budget_select(items, 10).alias("x")).first()["x"] == [0, 2, 3]
    cap = eventlog.evidence_cap(F.array(*[F.lit(x) for x in ("abcdef", "gh", "ijkl", "m")]), 4, 7)
    assert spark.range(1).select(cap.alias("x")).first()["x"] == ["abcd", "gh", "i"]


def test_blobs(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    stored = eventlog.with_blobs(texts.where("text = 'b'"))
    new = eventlog.new_blobs(texts, stored)
    assert [r["text"] for r in new.collect()] == ["a"]
    ref = eventlog.with_blobs(spark.createDataFrame([("x\ny",)], "text string")).first()["ref"]
    rows = spark.createDataFrame([(ref, "x\ny"), (ref, "x\r\ny"), (ref, "z")], "ref string, text string")
    assert sorted(r["status"] for r in eventlog.blob_status(rows).collect()) == ["corrupt", "ok", "repaired"]


def test_stream_state_equals_batch(spark, tmp_path):
    from evidentia.streaming.eventlog import stream_state

    log = [("r1", 0, "chat", "root", "c0", None), ("r1", 1, "exec", None, None, "s1"), ("r1", 2, "chat", "root", "c2", None), ("r1", 3, "exec", None, None, "s3"), ("r2", 0, "chat", "sub", "d", None)]
    schema = "run_id string, seq long, call_type string, actor string, completion_ref string, stdout_ref string"
    for k in (0, 1):
        spark.createDataFrame(log[k::2], schema).write.mode("append").json(str(tmp_path / "log"))
    state = stream_state(spark.readStream.schema(schema).json(str(tmp_path / "log")))
    q = state.writeStream.outputMode("update").format("memory").queryName("stream_state").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["run_id"]: r for r in spark.sql("select * from stream_state order by last_seq").collect()}
    assert (last["r1"]["completion_ref"], last["r1"]["executions"], last["r1"]["last_output"], last["r1"]["last_seq"]) == ("c2", 1, "s3", 4)
    assert last["r2"]["completion_ref"] is None


def test_direction_reasons(spark):
    rows = [
        (0, "Alpha outperforms Beta.", "Alpha", "Beta", "outperforms", 1.0, False),
        (1, "Beta outperforms alpha.", "Alpha", "Beta", "outperforms", 0.01, False),
        (2, "Alpha does not outperform Beta.", "Alpha", "Beta", "outperforms", 1.0, True),
        (3, "Alpha and Beta are here.", "Alpha", "Beta", "outperforms", 1.0, True),
        (4, "Beta outperforms Alpha.", "Alpha", "Beta", "no such relation", 0.0, True),
        (5, "It is better than most, and Alpha surpasses Beta.", "Alpha", "Beta", "outperforms", 1.0, True),
        (6, "Alpha surpasses Beta. " + "x" * 50 + " never", "Alpha", "Beta", "outperforms", 0.0, True),
        (7, None, "Alpha", "Beta", "outperforms", 1.0, False),
        (8, "Gamma outperforms Beta.", "Alpha", "Beta", "outperforms", 0.02, True),
    ]
    df = spark.createDataFrame(rows, "i int, s string, h string, t string, r string, m double, b boolean")
    got = {r["i"]: r["x"] for r in df.select("i", graph.direction_reasons("s", "h", "t", "r", "m", F.col("b")).alias("x")).collect()}
    assert got[0] == got[4] == got[5] == got[6] == []
    assert got[1] == ["cue_disagree", "small_margin"] and got[2] == ["negation"]
    assert got[3] == ["non_decisive_types"] and got[8] == ["small_margin", "non_decisive_types"]
    assert not got[7]


def test_sentence_of_a_triple(spark):
    text = "First of all. Only beta here. Alpha meets BETA now. Alpha and beta again."
    cases = [("Alpha", "Beta", "Alpha meets BETA now."), ("Gamma", "beta", "Only beta here."), ("Gamma", "Delta", "First of all.")]
    for head, tail, want in cases:
        assert value(spark, graph.sentence_for(F.lit(text), F.lit(head), F.lit(tail))) == want
    assert value(spark, graph.sentence_for(F.lit(None).cast("string"), F.lit("a"), F.lit("b"))) == ""
    assert value(spark, graph.spans_of(F.lit("a bb a"), "a|bb")) == [(0, 1), (2, 4), (5, 6)]


def test_gap_headings(spark):
    keep = ["All is well.\nNothing unsupported here", "# a lower case heading is unsupported", "x\n**" + "Long " * 30 + "unsupported**"]
    for text in keep[1:]:
        assert value(spark, claims.without_gaps(F.lit(text))) == text
    for head in ("## Unsupported claims", "**Could not verify**", "__Not supported by the chunks__", "What I cannot support:"):
        assert value(spark, claims.without_gaps(F.lit(f"Body.\nMore. \n\n{head}\n- z"))) == "Body.\nMore."
    assert value(spark, claims.without_gaps(F.lit("Unsupported\nx"))) == ""


def test_caps_evidence_and_ontology(spark):
    reason = eventlog.stop_reason(F.lit(1), F.lit(1), F.lit(0.0), backtracks=F.lit(3))
    assert value(spark, reason) == "backtracks"
    assert value(spark, eventlog.stop_reason(F.lit(10), F.lit(1), F.lit(9.0), backtracks=F.lit(3))) == "iterations"
    items = F.array(*[F.struct(F.lit(m).alias("mentions"), F.lit(p).alias("pos"), F.lit(t).alias("text")) for m, p, t in ((1, 0, "aaaa"), (3, 1, "bb"), (3, 2, None), (2, 3, "cccccc"))])
    assert value(spark, eventlog.cited_evidence(items, most=3, per_item=4, total=99)) == (["bb", "", "cccc"], True)
    assert value(spark, eventlog.cited_evidence(items)) == (["bb", "", "cccccc", "aaaa"], False)
    state = graph.ontology()
    assert state == graph.ontology() and len(state["version"]) == 12 and len(state["relations"]) == 8
    assert value(spark, evaluation.usable(F.lit("done"), F.lit("answer"), F.lit(" x "))) and not value(spark, evaluation.usable(F.lit("failed"), F.lit("answer"), F.lit("x")))


def test_drift_counts_and_postprocess(spark):
    now = spark.createDataFrame([("caps", "a", "1"), ("caps", "b", "2"), ("model", None, "m")], "field string, key string, value string")
    frozen = spark.createDataFrame([("caps", "a", "1"), ("caps", "b", "3"), ("caps", "c", "4")], "field string, key string, value string")
    drift = {(r["field"], r["key"]): (r["now"], r["frozen"]) for r in evaluation.frozen_drift(now, frozen).collect()}
    assert drift[("caps", "b")] == ("2", "3") and drift[("caps", "c")] == (None, "4") and ("caps", "a") not in drift
    cited = spark.createDataFrame([("r", "resolved"), ("r", "merged"), ("r", "unresolved"), ("r", "resolved")], "run string, status string")
    assert claims.citation_counts(cited, "run").first().asDict() == {"run": "r", "cited": 4, "resolved": 2, "merged": 1, "unresolved": 1}
    rows = spark.createDataFrame(
        [(1, "Alpha", None, "outperforms", "Beta", None, 0.9, "c"), (2, "Beta", None, "outperforms", "Alpha", None, 0.5, "c"), (3, "Alpha", None, "outperforms", "alpha", None, 0.5, "c")],
        "ord long, head string, head_type string, relation string, tail string, tail_type string, score double, chunk_uuid string",
    )
    for s in graph.SIDES:
        rows = rows.withColumn(f"{s}_type_source", F.lit(None).cast("string")).withColumn(f"{s}_type_confidence", F.lit(None).cast("double"))
    out = graph.postprocess(rows.withColumn("direction_margin", F.lit(None).cast("double")).withColumn("arxiv_id", F.lit("p"))).collect()
    assert [r["ord"] for r in out] == [1]
