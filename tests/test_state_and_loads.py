"""Runs rebuilt as streams, and loads that write each batch once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import eventlog as L
from evidentia.operators import ingest
from evidentia.sources.keyed import KeyedTable, load_stream
from evidentia.streaming import runstate

EVENT = (
    "run_id string, seq long, step_idx long, call_type string, actor string, error string, prompt_ref string, completion_ref string, "
    "stdout_ref string, result_ref string, extra string, tool string, args_hash string"
)


def events(seed, runs=6, most=25):
    rnd = random.Random(seed)
    out = []
    for run in range(runs):
        for seq in range(rnd.randrange(1, most)):
            kind, bad = rnd.choice(["chat", "exec", "exec", "emit", "tool"]), rnd.random() < 0.2
            extra = {"budget": seq} if rnd.random() < 0.3 else {}
            extra |= {"var": rnd.choice("xyz")} if kind == "emit" else {}
            out.append((
                f"r{run}", seq, seq // 2 if rnd.random() < 0.9 else None, kind, rnd.choice(["root", "sub"]), "boom" if bad else None,
                f"p{seq}", f"c{seq}", None if bad else f"o{seq}", f"t{seq}" if rnd.random() < 0.8 else None, json.dumps(extra),
                rnd.choice("ab") if kind == "tool" else None, rnd.choice("12"),
            ))
    return out


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(runstate.STATE_STORE[0], None)
    spark.conf.set(*runstate.STATE_STORE)
    yield spark
    spark.conf.unset(runstate.STATE_STORE[0]) if before is None else spark.conf.set(runstate.STATE_STORE[0], before)


def test_streamed_state_equals_the_batch_after_any_split(rocks, tmp_path):
    rows = events(3)
    random.Random(1).shuffle(rows)  # late events too
    source, sink = str(tmp_path / "in"), {}

    def take(batch, _):
        for r in batch.collect():
            sink[r["run_id"]] = r.asDict(recursive=True)

    def run():
        stream = rocks.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(source)
        out = runstate.stream_rebuild(stream).writeStream.outputMode("update").foreachBatch(take)
        out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    for a, b in ((0, 40), (40, len(rows))):  # a restart from the checkpoint between
        for k in range(a, b, 25):
            rocks.createDataFrame(rows[k : min(b, k + 25)], EVENT).coalesce(1).write.mode("append").json(source)
        run()
        want = {r["run_id"]: r.asDict(recursive=True) for r in L.rebuild(rocks.createDataFrame(rows[:b], EVENT)).collect()}
        assert set(sink) == set(want)
        for name, state in want.items():
            got = sink[name]
            assert got.pop("closed") is False
            assert got == {**state, "tool_results": state["tool_results"]}


def test_idle_runs_are_closed_and_forgotten(rocks, tmp_path):
    import time

    rows, source, seen = events(5, runs=2), str(tmp_path / "in"), []
    rocks.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(source)
    stream = runstate.stream_rebuild(rocks.readStream.schema(EVENT).json(source), idle_ms=1)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect()))
    query = query.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and sum(r["closed"] for r in seen) < 2:
        time.sleep(0.5)
    query.stop()
    assert sorted((r["run_id"], r["closed"]) for r in seen)[:4] == [("r0", False), ("r0", True), ("r1", False), ("r1", True)]


def keyed(spark, path):
    empty = spark.createDataFrame([], "id long, name string, at long")
    return KeyedTable(spark, str(path), empty.schema, "id", "at", buckets=16)


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    assert table.rows().count() == 0
    first = spark.range(200).selectExpr("id", "concat('a', id) AS name", "1L AS at")
    assert table.apply(first, 0)
    files = lambda: {f for r in table.rows().inputFiles() for f in [r]}
    before = files()
    second = spark.createDataFrame([(3, "b", 5), (3, "c", 9), (900, "n", 1), (None, "x", 1)], "id long, name string, at long")
    want = ingest.upsert(first, ingest.latest(second.where("id is not null"), "id", "at"), "id", "at")
    assert table.apply(second, 1) and not table.apply(second, 1)
    assert sorted(map(tuple, table.rows().collect())) == sorted(map(tuple, want.select("id", "name", "at").collect()))
    after = files()
    parts = lambda some: {f.split("bucket=")[1].split("/")[0] for f in some}
    assert 1 <= len(parts(before - after)) <= 2 and len(before & after) >= len(before) - 2 * len(before - after)
    assert table.apply(first.limit(0), 2) and files() == after


@pytest.mark.parametrize("stop", ["before the rows", "after the rows"])
def test_a_load_that_stops_between_its_writes(spark, tmp_path, monkeypatch, stop):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(k * 5, k * 5 + 10).selectExpr("id", f"'v{k}' AS name", f"{k}L AS at").coalesce(1).write.mode("append").json(source)
    place, fails = KeyedTable._place, [True]

    def broken(self, staged):
        if stop == "after the rows":
            place(self, staged)
        if fails:
            fails.pop()
            raise RuntimeError("stopped")
        if stop == "before the rows":
            place(self, staged)

    def run():
        stream = spark.readStream.schema("id long, name string, at long").option("maxFilesPerTrigger", 1).json(source)
        load_stream(stream, keyed(spark, tmp_path / "t"), str(tmp_path / "ck"), "s").awaitTermination()

    monkeypatch.setattr(KeyedTable, "_place", broken)
    with pytest.raises(Exception, match="stopped"):
        run()
    monkeypatch.setattr(KeyedTable, "_place", place)
    run()
    table = keyed(spark, tmp_path / "t")
    assert sorted((r["id"], r["at"]) for r in table.rows().collect()) == [(i, min(2, i // 5)) for i in range(20)]
    done = table.ledger().where("state = 'done'").groupBy("batch").count()
    assert sorted(map(tuple, done.collect())) == [(0, 1), (1, 1), (2, 1)]
    run()
    assert table.ledger().where("state = 'done'").count() == 3


def test_a_state_outlives_a_crash_while_it_is_replaced(spark, tmp_path):
    import os

    from evidentia.operators import experiments as P

    path = str(tmp_path / "state")
    P.save_state(spark.range(4), path)
    os.rename(path, f"{path}.new")  # as if the old one was just deleted
    assert P.load_state(spark, path).count() == 4
    P.save_state(spark.range(6), path)
    assert P.load_state(spark, path).count() == 6 and not os.path.exists(f"{path}.new")
