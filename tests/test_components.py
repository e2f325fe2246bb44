"""Strong components and broken cycles against plain ones."""

import random

import pytest

from evidentia.operators import components as C


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        node = todo.pop()
        for a, b in edges:
            if a == node and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def plain_components(edges):
    nodes = {x for e in edges for x in e}
    of = {n: reach(edges, n) for n in nodes}
    return {n: min(m for m in nodes if n in of[m] and m in of[n]) for n in nodes if any(m != n and n in of[m] and m in of[n] for m in nodes)}


def plain_broken(rows):
    live, gone = {o: (a, b) for a, b, o, _ in rows}, set()
    for _, o in sorted(((s, -o) for _, _, o, s in rows)):
        a, b = live[-o]
        if a == b or a in reach(list(live.values()), b):
            gone.add(-o)
            del live[-o]
    return gone


def graph(seed, nodes, edges, scores=5):
    rnd = random.Random(seed)
    return [(rnd.randrange(nodes), rnd.randrange(nodes), k, rnd.randrange(scores) / 10) for k in range(edges)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    edges = [(a, b) for a, b, _, _ in graph(seed, 40, 55)] + [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(8, 100), (None, 3), (3, None)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in C.strong_components(frame).collect()}
    whole = [e for e in edges if None not in e]
    assert got == plain_components(whole)
    part = C.components_of(whole)
    for n in part:
        same = {m for m in part if part[m] == part[n]}
        assert same == ({m for m in got if got[m] == got[n]} if n in got else {n})


def test_components_of_nothing(spark):
    assert C.strong_components(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_weakest_edges_in_a_task():
    for seed in range(60):
        rows = [r for r in graph(seed, 9, 22) if r[0] != r[1]]
        order = sorted(rows, key=lambda r: (r[3], -r[2]))
        got = C.weakest_first([(a, b, k) for k, (a, b, _, _) in enumerate(order)])
        assert {order[k][2] for k in got} == plain_broken(rows) and len(got) == len(set(got))


@pytest.mark.parametrize("share,scores", [(10_000, 5), (20, 5), (20, 1)])
def test_components_larger_than_a_share(spark, share, scores):
    rows = graph(7, 9, 36, scores) + [(20 + k, 20 + (k + 1) % 5, 100 + k, 0.5) for k in range(5)] + [(30, 30, 200, 0.9)]
    frame = spark.createDataFrame(rows, "a long, b long, ord long, score double").selectExpr("*", "'x' AS problem")
    got = [r["ord"] for r in C.cycle_edges(frame, share).collect()]
    assert set(got) == plain_broken(rows) and len(got) == len(set(got))


def test_triples_of_a_graph_have_numbers_of_their_own(spark):
    from evidentia.operators import graph as G

    def many(text):
        return [(f"A{k}", "Method", "uses", f"B{k}", "Dataset", 0.9) for k in range(int(text))]

    chunks = spark.createDataFrame([(f"c{k}", "p", n) for k, n in enumerate(["5000", "3", "0", "7"])], "chunk_uuid string, arxiv_id string, chunk_text string")
    rows = G.build_kg(chunks, many)["extracted"].orderBy("ord").select("ord", "chunk_uuid", "place").collect()
    assert len({r.ord for r in rows}) == len(rows) == 5010
    assert [(r.chunk_uuid, r.place) for r in rows] == sorted((r.chunk_uuid, r.place) for r in rows)


def test_edges_that_no_cycle_can_have_reach_no_group(spark, monkeypatch):
    """Thousands of one-edge graphs, chains and one cycle: only the cycle's graph is worked on."""
    rows = [(f"p{k}", "a", "b", k, 0.5) for k in range(300)]
    rows += [("ring", "a", "b", 1000, 0.9), ("ring", "b", "c", 1001, 0.2), ("ring", "c", "a", 1002, 0.7), ("ring", "x", "a", 1003, 0.1)]
    rows += [("loop", "a", "a", 2000, 0.5), ("loop", "a", "b", 2001, 0.5)]
    seen = spark.sparkContext.accumulator(0)
    broken = C._broken

    def counted(group):
        seen.add(len(group))
        return broken(group)

    monkeypatch.setattr(C, "_broken", counted)
    edges = spark.createDataFrame(rows, "problem string, a string, b string, ord long, score double")
    assert sorted(r["ord"] for r in C.cycle_edges(edges).collect()) == [1001, 2000]
    assert seen.value == 3
