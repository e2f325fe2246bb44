"""File sources and sinks, streams over files, the tool registry, embedder and entity keys."""

import json
import time

import pytest
from pyspark.sql import functions as F

from evidentia.operators import eventlog as L
from evidentia.operators import experiments as P
from evidentia.operators import graph as G
from evidentia.operators import retrieval, runs
from evidentia.sources import tables
from evidentia.streaming import eventlog as S

EVENTS = [
    {"run_id": "a", "step_idx": 0, "actor": "root", "call_type": "chat", "action": "plan", "prompt_ref": "p0", "completion_ref": "c0", "tokens_in": 5, "cost_usd": 0.5},
    {"run_id": "a", "step_idx": 0, "call_type": "exec", "action": "run", "code_ref": "x0", "stdout_ref": "s0"},
    {"run_id": "a", "step_idx": 1, "actor": "root", "call_type": "chat", "action": "plan", "error": "timeout", "cost_usd": 0.25},
    {"run_id": "a", "step_idx": 1, "actor": "root", "call_type": "chat", "action": "plan", "prompt_ref": "p1", "completion_ref": "c1", "extra": '{"budget": {"left": 3}}'},
    {"run_id": "a", "step_idx": 1, "call_type": "tool", "tool": "find", "args_hash": "h", "result_ref": "r1", "error": "bad"},
    {"run_id": "a", "step_idx": 2, "call_type": "exec", "action": "run", "code_ref": "x1", "error": "boom"},
    {"run_id": "a", "step_idx": 2, "call_type": "exec", "action": "run", "code_ref": "x2"},
    {"run_id": "b", "step_idx": 0, "call_type": "emit", "action": "emit", "result_ref": "r2", "extra": '{"var": "v"}'},
    {"run_id": "b", "step_idx": 4, "call_type": "emit", "action": "emit", "result_ref": "r3", "extra": '{"var": "v"}'},
]


def logged(spark, path):
    """Events as they are read back, in the order of the file."""
    return tables.events(spark, path).withColumn("seq", F.monotonically_increasing_id())


def test_event_log_round_trip_and_rebuilt_state(spark, tmp_path):
    file = tmp_path / "log.jsonl"
    file.write_text("\n".join(["", "not json", "[1]", *map(json.dumps, EVENTS), '{"run_id": "a", "trunc']))
    events = logged(spark, str(file))
    assert events.count() == len(EVENTS)
    totals = {r["run_id"]: r for r in L.totals(events, "run_id").collect()}
    assert (totals["a"]["cost_usd"], totals["a"]["calls"], totals["a"]["tool_calls"], totals["a"]["cached_tokens"]) == (0.75, 2, 1, 0)
    state = {r["run_id"]: r for r in L.rebuild(events).collect()}
    a = state["a"]
    assert (a["last_seq"], a["prompt_ref"], json.loads(a["budget"])) == (3, "p1", {"left": 3})
    assert [tuple(m) for m in a["messages"]] == [("assistant", "c1"), ("user", "[block failed: boom]"), ("user", "[block interrupted; effects unknown]")]
    assert a["tool_results"] is None and state["b"]["emits"] == {"v": "r3"} and state["b"]["messages"] == [] and state["b"]["last_seq"] == 5
    out = str(tmp_path / "again")
    tables.append_events(tables.events(spark, str(file)), out)
    tables.append_events(tables.events(spark, str(file)), out)
    assert tables.events(spark, out).count() == 2 * len(EVENTS)
    assert "null" not in next((tmp_path / "again").glob("part-*")).read_text()
    summary = {r["run_id"]: r for r in runs.replay_summary(L.turns(events), spark.createDataFrame([("c0",), ("c1",)], "ref string")).collect()}
    assert (summary["a"]["turns"], summary["a"]["code_blocks"], summary["a"]["emits"]) == (3, 2, 0)
    assert summary["a"]["missing_refs"] == 7 and summary["b"]["emits"] == 2  # p0 x0 s0 p1 r1 x1 x2


def test_sheets_and_instruments(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"instance_id": "1", "query": "q"}\n{"query": "none"}\n')
    rows = tables.instruments(spark, str(tmp_path / "i.jsonl"))
    with pytest.raises(Exception, match="instance_id"):
        rows.collect()
    (tmp_path / "ok.jsonl").write_text('{"instance_id": "1", "query": "q", "gold": {"answer": 3}}\n')
    assert tables.instruments(spark, str(tmp_path / "ok.jsonl")).first()["gold"].replace(" ", "") == '{"answer":3}'
    (tmp_path / "p.json").write_text('{"points": [{"name": "a", "k": 1, "n": 1, "C": 5, "c_top": 2}, {"name": "b", "k": 1, "n": 1, "C": 1, "c_top": 2}]}')
    with pytest.raises(Exception, match="c_top"):
        tables.funnel_points(spark, str(tmp_path / "p.json")).collect()
    (tmp_path / "q1.json").write_text('{"id": "1", "text": "same"}\n{"id": "2", "text": "other"}\n')
    (tmp_path / "q2.json").write_text('{"id": "9", "text": "same"}\n')
    got = tables.campaign_queries(spark, [str(tmp_path / f"q{k}.json") for k in (1, 2)]).collect()
    assert sorted(map(tuple, got)) == [("1", "same"), ("2", "other")]
    sheet = spark.createDataFrame([("c", "a", "s", "text, with\nlines", "N:Method; M", None)], tables.ENTITY_SHEET)
    tables.write_csv(sheet, str(tmp_path / "sheet"))
    assert tables.entity_sheet(spark, str(tmp_path / "sheet")).first()["chunk_text"] == "text, with\nlines"
    assert tables.triple_sheet(spark, str(tmp_path / "empty")).columns[0] == "id" if (tmp_path / "empty").exists() else True


def test_fetches_and_listings(spark):
    chunks = spark.createDataFrame(
        [("u1", "p1", "Result", 2, "long " * 60, [1.0]), ("u2", "p1", "Result", None, "x", [1.0]), ("u3", "p2", "Other", 0, None, None)],
        "chunk_uuid string, arxiv_id string, section_type string, section_order int, chunk_text string, chunk_embedding array<double>",
    )
    ids = spark.createDataFrame([("u3",), ("u1",), ("u1",), ("none",)], "chunk_uuid string")
    assert sorted(r["chunk_uuid"] for r in retrieval.fetch_chunks(chunks, ids).collect()) == ["u1", "u3"]
    assert "chunk_embedding" not in retrieval.fetch_chunks(chunks, ids).columns
    listed = retrieval.chunks_for_paper(chunks, "p1").collect()
    assert [r["chunk_uuid"] for r in listed] == ["u1", "u2"] and len(listed[0]["preview"]) == 160 and listed[0]["chars"] == 300
    cut = chunks.select(retrieval.trim_text(F.col("chunk_text"), 10).alias("t")).collect()
    assert [r["t"] for r in cut] == ["long long … [290 more characters]", "x", None]
    many = spark.range(60).select(F.col("id").alias("pos"), F.lit("u").alias("chunk_uuid"))
    with pytest.raises(ValueError):
        retrieval.lookup_chunks(chunks, many)


def test_streams_of_turns_and_heartbeats(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps(e) for e in EVENTS))
    events = tables.stream_events(spark, str(inbox)).withColumn("seq", F.col("step_idx"))
    query = S.stream_turns(events).writeStream.outputMode("complete").format("memory").queryName("turns_").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["run_id"], r["step_idx"]): r["completion_ref"] for r in spark.table("turns_").collect()}
    assert got == {("a", 0): "c0", ("a", 1): "c1", ("a", 2): None, ("b", 0): None, ("b", 4): None}
    beats = S.stream_heartbeat(tables.stream_events(spark, str(inbox)).select("run_id"), 1)
    query = beats.writeStream.outputMode("update").format("memory").queryName("beats_").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(40):
            time.sleep(0.5)
            if (inbox / "2.json").exists() and spark.table("beats_").where("status = 'interrupted'").count() >= 2:
                break
            if not (inbox / "2.json").exists() and spark.table("beats_").count() >= 2:
                (inbox / "2.json").write_text('{"run_id": "b"}\n')
        rows = spark.table("beats_").collect()
    finally:
        query.stop()
    assert {(r["run_id"], r["status"]) for r in rows} >= {("a", "running"), ("b", "running"), ("a", "interrupted")}
    assert max(r["events"] for r in rows if r["run_id"] == "a") == 7


def test_registry_embedder_and_entity_keys(spark):
    registry = P.Registry()
    registry.register("half", lambda x: x / 2)
    with pytest.raises(ValueError):
        registry.register("half", lambda x: x)
    assert registry.dispatch("half", {"x": 4}) == {"ok": True, "result": 2.0}
    assert registry.dispatch("none", {})["ok"] is False and "TypeError" in registry.dispatch("half", {"x": "a"})["error"]
    assert [e["error"] is None for e in registry.events] == [True, False, False]
    rows = spark.createDataFrame([("alpha beta",), ("Beta  ALPHA",), ("gamma",), (None,)], "t string")
    vectors = [r["v"] for r in P.embed(rows, "t", "v", P.hashing_embedder(16)).collect()]
    assert vectors[0] == vectors[1] != vectors[2] and sum(x * x for x in vectors[0]) == pytest.approx(1.0) and not any(vectors[3])
    names = spark.createDataFrame([("Straße",), ("é X\u0007",), (None,)], "n string")
    assert [r["k"] for r in names.select(P.normal_entity(F.col("n")).alias("k")).collect()] == ["strasse", "é x", None]


def test_nodelink_round_trip_and_cycles(spark):
    triples = spark.createDataFrame(
        [(1, "A", "Method", "uses", "B", "Dataset", 0.5, "c1", "p"), (2, "B", "Dataset", "uses", "A", "Method", 0.7, "c2", "p"), (3, "C", "Task", "uses", "C", "Task", 0.7, None, "p")],
        "ord long, head string, head_type string, relation string, tail string, tail_type string, score double, chunk_uuid string, arxiv_id string",
    )
    for s in G.SIDES:
        triples = triples.withColumn(f"{s}_type_source", F.lit(None).cast("string")).withColumn(f"{s}_type_confidence", F.lit(None).cast("double"))
    document = G.to_nodelink(G.nodes(triples), G.edges(triples)).withColumn("payload", F.lit(1))
    back = G.payload_triples(document)
    assert sorted((r["head"], r["relation"], r["tail"], r["tail_type"]) for r in back.collect()) == [("A", "uses", "B", "Dataset"), ("B", "uses", "A", "Method"), ("C", "uses", "C", "Task")]
    with pytest.raises(ValueError):
        G.to_nodelink(G.nodes(triples), G.edges(triples), most=2)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 1)], "src long, dst long")
    assert sorted(r["node"] for r in G.cycle_members(edges).collect()) == [1, 2, 3, 6]
    assert G.cycle_members(edges.limit(0)).count() == 0


def test_bundles(spark, tmp_path):
    docs = spark.createDataFrame([("one",), ("two",), ("password x",)], "text string")
    blobs = L.with_blobs(docs)
    refs = blobs.where("text <> 'password x'").select(F.lit("r").alias("run_id"), "ref")
    path = str(tmp_path / "bundle")
    runs.export_bundle(refs.unionByName(refs), blobs, path, "password")
    bundle = spark.read.parquet(path)
    assert bundle.count() == 2
    assert runs.import_bundle(bundle, blobs.where("text = 'one'")).first()["text"] == "two"
    with pytest.raises(ValueError):
        runs.export_bundle(blobs.select(F.lit("r").alias("run_id"), "ref"), blobs, path + "2", "password")
    with pytest.raises(Exception, match="does not fit"):
        runs.import_bundle(bundle.withColumn("text", F.lit("other")), blobs.limit(0)).collect()
    left = spark.range(1).select(runs.remaining_seconds(F.lit(10.0), F.lit(5), F.lit(20)).alias("a"), runs.remaining_seconds(F.lit(1.0), F.lit(0), F.lit(20)).alias("b")).first()
    assert left["a"] == 30.0 and left["b"] is None


def test_sheets_instances_and_states(spark, tmp_path):
    triples = spark.createDataFrame([(k, f"GPT {k} . 5", "Method", "uses" if k % 3 else "extends", "X", "Dataset", "2101.00001") for k in range(12)],
                                    "ord long, head string, head_type string, relation string, tail string, tail_type string, arxiv_id string")
    sheet = P.gold_sheet(triples, 6, 1).collect()
    assert len(sheet) == 6 and {r["relation"] for r in sheet} == {"uses", "extends"} and all(r["gold_relation_ok"] == "" for r in sheet)
    assert any(r["question"] == f"Is it true that GPT {r['ord']}.5 (Method) {r['relation']} X (Dataset) at arxiv paper 2101.00001" for r in sheet)
    one = P.instances(triples, "ord", "head", "tail", "relation", "d.txt", 3).where("instance_id = 'bridge-0'").first()
    assert one["gold"]["answer"] == "X" and one["meta"].asDict() == {"document": "d.txt", "seed": 3, "answer_type": "extends"}
    assert P.arm_fingerprint({"b": 1, "a": 2}) == P.arm_fingerprint({"a": 2, "b": 1}) != P.arm_fingerprint({"a": 2, "b": 2})
    buckets = F.array(F.struct(F.lit("problems").alias("bucket"), F.array(F.lit("x")).alias("clauses")))
    assert json.loads(spark.range(1).select(P.query_json(buckets)).first()[0]) == {"problems": ["x"]}
    path = str(tmp_path / "state")
    for n in (3, 5):
        P.save_state(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert not (tmp_path / "state.new").exists()
