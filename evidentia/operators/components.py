"""Strongly connected components of graphs of any size, and the edges that break their cycles.

Components are found by joins and aggregations over the edge list. Nodes that
no edge enters or that none leaves are trimmed. Every node then takes the
least node that reaches it as its colour; what of a colour reaches back to the
node that gave it is a component. Edges between colours go, and the rest is
coloured again. The number of rounds grows with the longest way within a
component, not with the size of the graph.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.sources.shared import written

#: Rounds of trimming before each colouring: long tails are left to the colours.
TRIMS = 3
#: Edges of a component that one task takes.
SHARE = 5_000


def _trimmed(live: DataFrame) -> tuple[DataFrame, int]:
    size = live.count()
    for _ in range(TRIMS):
        entered, left = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
        live = written(live.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"), "trim")
        before, size = size, live.count()
        if size in (0, before):
            break
    return live, size


def _coloured(live: DataFrame) -> DataFrame:
    """Every ``node`` of the edges with ``colour``, the least node that reaches it."""
    nodes = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
    colours = written(nodes.withColumn("colour", F.col("node")), "colours")
    # Only nodes whose colour changed tell their neighbours.
    fresh = colours
    while True:
        told = live.join(fresh.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
        step = colours.join(told, "node", "left").select("node", F.least("colour", "told").alias("colour"), (F.col("told") < F.col("colour")).alias("new"))
        step = written(step, "colours")
        colours, fresh = step.select("node", "colour"), step.where("new").select("node", "colour")
        if fresh.isEmpty():
            return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes on a cycle of two nodes or more, of edges ``src, dst``.

    A component is named by its least node. Null ends, loops and parallel edges
    do not matter.
    """
    live = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    kind = live.schema["src"].dataType
    none = edges.sparkSession.range(0)
    found = none.select(F.lit(None).cast(kind).alias("node"), F.lit(None).cast(kind).alias("component"))
    while True:
        live, size = _trimmed(live)
        if not size:
            return found
        colours = _coloured(live)
        ends = live
        for end in ("src", "dst"):
            ends = ends.join(colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")), end)
        inside = written(ends.where("src_colour = dst_colour").select("src", "dst"), "edges")
        # Backwards from the node that gave the colour.
        back = fresh = written(colours.where("node = colour"), "back")
        while True:
            before = inside.join(fresh.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            fresh = written(before.join(back, "node", "left_anti"), "back")
            if fresh.isEmpty():
                break
            back = back.unionByName(fresh)
        back = written(back.withColumnRenamed("colour", "component"), "components")
        several = back.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
        found = found.unionByName(back.join(several, "component", "left_semi").select("node", "component"))
        gone = back.select("node")
        live = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        live = written(live, "edges")


def components_of(edges: Iterable[tuple]) -> dict:
    """The component of each node of a small graph, by a walk that keeps its own stack (Tarjan, 1972)."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number: dict = {}
    low: dict = {}
    part: dict = {}
    open_: list = []
    for root in after:
        if root in number:
            continue
        walk = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        while walk:
            node, rest = walk[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    open_.append(other)
                    walk.append((other, iter(after[other])))
                    break
                if other not in part:
                    low[node] = min(low[node], number[other])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    while node not in part:
                        part[open_.pop()] = node
    return part


def weakest_first(edges: list[tuple]) -> list:
    """Keys of the edges that go if, from the weakest on, each goes that is on a cycle then.

    Edges are (a, b, key), keys in order of strength, None for one that stays.
    The weaker half is decided first: what has both ends in one component of
    the stronger half goes at once, and for the others that component counts
    as one node. The stronger half is decided within those components.
    """
    gone, todo = [], [edges]
    while todo:
        some = todo.pop()
        part = components_of((a, b) for a, b, _ in some)
        some = [e for e in some if part[e[0]] == part[e[1]]]
        keys = sorted(k for _, _, k in some if k is not None)
        if not keys:
            continue
        if len(keys) == 1:  # on a cycle, as both ends are in one component
            gone += keys
            continue
        cut = keys[(len(keys) - 1) // 2]
        strong = [e for e in some if e[2] is None or e[2] > cut]
        part = components_of((a, b) for a, b, _ in strong)
        within, between = [], []
        for a, b, k in some:
            a_part, b_part = part.get(a, a), part.get(b, b)
            weak = k is not None and k <= cut
            if a_part != b_part:
                between.append((a_part, b_part, k if weak else None))
            elif weak:
                gone.append(k)
            else:
                within.append((a, b, k))
        todo += [within, between]
    return gone


def _broken(rows: pd.DataFrame) -> pd.DataFrame:
    order = rows.sort_values(["score", "ord"], ascending=[True, False])
    free = order[~order["fixed"]]
    place = {o: k for k, o in enumerate(free["ord"])}
    edges = [(a, b, None if f else place[o]) for a, b, o, f in zip(order["a"], order["b"], order["ord"], order["fixed"], strict=True)]
    return pd.DataFrame({"ord": free["ord"].to_numpy()[weakest_first(edges)] if len(free) else pd.Series([], dtype="int64")})


def cycle_edges(edges: DataFrame, share: int = SHARE) -> DataFrame:
    """``ord`` of the edges to drop so that no cycle is left: weakest first, each that is on a cycle then.

    Edges have ``a, b, ord, score`` and ``problem``, the graph that they belong
    to (no nulls, ``ord`` distinct); of equal scores the later goes first. A
    graph of up to ``share`` edges is one task's. Of larger ones the components
    are found by joins; one of up to ``share`` edges is one task's, and larger
    ones are halved by strength as ``weakest_first`` does.
    """
    rows = edges.select("problem", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "ord", F.col("score").cast("double").alias("score"), F.lit(False).alias("fixed"))
    gone = edges.select("ord").limit(0)

    def named(some: DataFrame) -> DataFrame:
        """Ends named so that those of different problems differ."""
        a, b = (F.md5(F.concat_ws("\x01", "problem", c)) for c in ("a", "b"))
        return some.withColumns({"a": a, "b": b})

    def parts(some: DataFrame, of: DataFrame) -> DataFrame:
        """The components of both ends; an end that is on no cycle is its own."""
        for end in ("a", "b"):
            mine = of.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
            some = some.join(mine, end, "left").withColumn(f"{end}_part", F.coalesce(f"{end}_part", end))
        return some

    def passed(some: DataFrame) -> DataFrame:
        """Edges that an edge of their problem leads to, and that one follows: no other is on a cycle."""
        entered, left = some.select("problem", F.col("b").alias("a")).distinct(), some.select("problem", F.col("a").alias("b")).distinct()
        return some.join(entered, ["problem", "a"], "left_semi").join(left, ["problem", "b"], "left_semi").select(*rows.columns)

    loops = rows.where("a = b").select("ord")
    # A graph without a cycle is mostly gone here, and takes no task's time as a group of its own.
    rows = passed(written(rows.where("a <> b"), "problems"))
    while True:
        rows = written(named(rows), "problems")
        few = rows.groupBy("problem").agg(F.count("*").alias("n")).where(F.col("n") <= share).select("problem")
        whole = rows.join(few, "problem", "left_semi")
        gone = gone.unionByName(written(whole.groupBy("problem").applyInPandas(_broken, "ord long"), "broken"))
        rows = written(rows.join(few, "problem", "left_anti"), "problems")
        if rows.isEmpty():
            return gone.unionByName(loops)
        inside = parts(rows, strong_components(rows.select(F.col("a").alias("src"), F.col("b").alias("dst")))).where("a_part = b_part")
        inside = written(inside.select(F.col("a_part").alias("problem"), "a", "b", "ord", "score", "fixed"), "problems")
        sizes = inside.groupBy("problem").agg(
            F.count("*").alias("n"), F.count(F.when(~F.col("fixed"), 1)).alias("free"),
            *(f(F.when(~F.col("fixed"), F.col(c))).alias(f"{c}_{n}") for c in ("score", "ord") for n, f in (("low", F.min), ("high", F.max))),
            F.percentile_approx(F.when(~F.col("fixed"), F.col("score")), 0.5, 1000).alias("score_mid"),
            F.percentile_approx(F.when(~F.col("fixed"), F.col("ord")), 0.5, 1000).alias("ord_mid"),
        ).where("free > 0")
        sizes = written(sizes, "problems")
        small = inside.join(sizes.where((F.col("n") <= share) & (F.col("free") > 1)).select("problem"), "problem", "left_semi")
        gone = gone.unionByName(written(small.groupBy("problem").applyInPandas(_broken, "ord long"), "broken"))
        # The only free edge of a component is on a cycle.
        gone = gone.unionByName(inside.where("not fixed").join(sizes.where("free = 1").select("problem"), "problem", "left_semi").select("ord"))
        large = sizes.where((F.col("n") > share) & (F.col("free") > 1))
        if large.isEmpty():
            return gone.unionByName(loops)
        # Both halves of what is free have an edge.
        by_score = F.when(F.col("score_mid") > F.col("score_low"), F.col("score") < F.col("score_mid")).otherwise(F.col("score") <= F.col("score_mid"))
        by_ord = F.when(F.col("ord_mid") < F.col("ord_high"), F.col("ord") > F.col("ord_mid")).otherwise(F.col("ord") >= F.col("ord_mid"))
        weak = ~F.col("fixed") & F.when(F.col("score_low") < F.col("score_high"), by_score).otherwise(by_ord)
        split = written(inside.join(large, "problem").withColumn("weak", weak).select("problem", "a", "b", "ord", "score", "fixed", "weak"), "problems")
        strong = split.where(~F.col("weak"))
        placed = written(parts(split, strong_components(strong.select(F.col("a").alias("src"), F.col("b").alias("dst")))), "problems")
        gone = gone.unionByName(placed.where("weak and a_part = b_part").select("ord"))
        between = placed.where("a_part <> b_part").select(
            F.concat_ws("/", "problem", F.lit("weak")).alias("problem"), F.col("a_part").alias("a"), F.col("b_part").alias("b"), "ord", "score", (~F.col("weak")).alias("fixed")
        )
        within = placed.where("not weak and a_part = b_part").select("problem", "a", "b", "ord", "score", "fixed")
        rows = between.unionByName(within)
