"""The prefix trie against a plain one."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from evidentia.llm import prefix_trie, queries

NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows, rebuild=True):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, key(role, text), role, text))
    whole = {c: [r[3:] for r in sorted(v)] for c, v in convs.items()}
    if rebuild:
        head = {c: zlib.crc32(str(c).encode()) % 4 for c in whole}
        whole = {c: whole.get(c - int(math.fmod(c, 20)), [])[: head[c]] + v[head[c] :] for c, v in whole.items()}
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        down = [p for p in members if len(p) == len(path) + 1 and p[:-1] == path]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        ends = ",".join(str(c) for c in members[path] if len(whole[c]) == len(path))
        out[path] = (
            members[path][0], len(path), members[path[:-1]][0] if path else None, len(members[path]), len(down),
            sum(out[p][5] for p in down) or 1, (len(members[path]) - 1) * words + sum(out[p][6] for p in down),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return collections.Counter(out.values())


def got(spark, rows, rebuild=True):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS depth", "3 AS key")
    if rebuild:
        from pyspark.sql import functions as F

        out = prefix_trie.conversation_trie(docs, base=F.expr("conv - conv % 20"), head=F.expr("crc32(cast(conv AS string)) % 4"))
    else:
        out = prefix_trie.conversation_trie(docs)
    assert out.columns == NAMES
    return collections.Counter(tuple(r) for r in out.collect())


def conversations(seed, convs, most, kinds=3):
    rnd = random.Random(seed)
    return [
        (c, t, rnd.choice(["user", "assistant"]), " ".join("ab"[: rnd.randrange(kinds)]))
        for c in range(convs) for t in range(rnd.randrange(most))
    ]


@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_a_plain_trie(spark, rebuild):
    rows = conversations(1, 60, 7)
    assert got(spark, rows, rebuild) == plain(rows, rebuild)


def test_long_common_beginnings_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 3)
    same = [(t, "user", f"turn {t} of many") for t in range(40)]
    rows = [(c, *x) for c in (3, 5, 8, 9, 11, 12, 13, 14, 15) for x in same]
    rows += [(c, *x) for c in (21, 22) for x in same[:33] + [(99, "user", f"own {c}")]] + [(30, *x) for x in same[:20]]
    for rebuild in (False, True):
        assert got(spark, rows, rebuild) == plain(rows, rebuild)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "x"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (1, 0, "", ""), (None, 1, "user", "x"),
        (-3, 5, "user", "  "), (-3, 4, "user", "b\x00c d"), (45, 0, "user", "only"), (27, 0, "a", "x y z"), (20, 1, "1:", "x"), (20, 2, "1", ":x"),
    ]
    for rebuild in (False, True):
        assert got(spark, rows, rebuild) == plain(rows, rebuild)
    assert got(spark, rows[:1]) == plain(rows[:1])
    assert got(spark, rows[5:6]) == got(spark, rows[:0]) == {}
    copies = [(c, t, "user", "hello there") for c in range(20) for t in range(3)]
    assert got(spark, copies, False) == plain(copies, False)


def test_query(spark):
    out = queries.op12_prefix_trie(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collections.Counter(tuple(r[n] for n in NAMES) for r in out) == plain(rows)
