"""Rules with nulls, and the join beside the trie."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evidentia.llm.queries import table
from evidentia.llm.url_filter import build_trie, longest_rule, url_filter

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("block", "net", None), (None, "example.com", "/en/x"),
    ("allow", None, "/free"), ("block", "net", ""), ("allow", "net", ""), ("block", "bücher.de", "/ä"),
]
URLS = ["http://example.com/en/x", "http://a.net", "https://b.org/free/1", None, "no scheme", "http://WWW.bücher.de/äö?x", "x://", "http://b.org/fre"]


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_nulls_in_rules(spark, most):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(pages, rules, max_trie_bytes=most).collect()}
    want = [
        ("example.com/en/", "block"), ("net", "block"), ("/free", "allow"), (None, "allow"), (None, "allow"),
        ("bücher.de/ä", "block"), (None, "allow"), (None, "allow"),
    ]
    assert got == dict(enumerate(want * 2))


def test_join_equals_trie_on_the_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    pages = pages.unionByName(pages).orderBy(F.rand(3))
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    one, two = (sorted(map(str, url_filter(pages, rules, max_trie_bytes=m).collect())) for m in (32 << 20, 0))
    assert one == two


def plain_rule(rules, host, path):
    fits = [
        (len(h) + len(p), len(h), v == "block", h + p, v)
        for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3:5] if fits else None


def test_trie_equals_a_walk_over_all_rules():
    rnd = random.Random(8)
    part = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(3)))
    rules = [(rnd.choice(["allow", "block"]), ".".join(part() for _ in range(rnd.randrange(4))), "/".join(part() for _ in range(rnd.randrange(4)))) for _ in range(300)]
    trie = build_trie(rules)
    for _ in range(2000):
        host, path = ".".join(part() for _ in range(3)), "/" * rnd.randrange(2) + "/".join(part() for _ in range(4))
        assert longest_rule(trie, host, path) == plain_rule(rules, host, path)


def test_very_many_rules_of_one_host_and_very_deep_paths(spark):
    rules = [("block", "example.com", f"/p{k}") for k in range(100_000)] + [("allow", "example.com", "/x" * 5_000)]
    trie = build_trie(rules)
    began = time.perf_counter()
    for k in range(2_000):
        assert longest_rule(trie, "www.example.com", f"/p{k * 50}") == (f"example.com/p{k * 50}", "block")
    assert (time.perf_counter() - began) / 2_000 < 0.0005
    pages = spark.createDataFrame([(1, "http://example.com" + "/x" * 5_001), (2, "http://example.com" + "/x" * 4_999)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter(pages, rules, default="none").orderBy("page_id").collect()] == ["allow", "none"]
