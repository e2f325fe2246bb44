"""URL allow and block rules in one trie.

The trie goes over the labels of a rule's host from the right, then over the
segments of its path. The longest rule that fits decides: most characters of
host and path together, then of the host; block before allow when the same
rule has both.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rule set of more bytes than this is joined, not broadcast.
MAX_TRIE_BYTES = 32 << 20


@dataclass
class Trie:
    """Nodes are numbers, so that a trie of any depth is a few flat tables.

    ``labels`` leads from a host's node by a label, ``segments`` from a path's
    node by a whole segment; ``paths`` gives the path's first node of a host's.
    A rule ends at a path's node with the start of the next segment: ``starts``
    has its rank, and ``lengths`` the lengths of the starts that a node has.
    """

    labels: dict[tuple[int, str], int] = field(default_factory=dict)
    paths: dict[int, int] = field(default_factory=dict)
    segments: dict[tuple[int, str], int] = field(default_factory=dict)
    starts: dict[tuple[int, str], tuple] = field(default_factory=dict)
    lengths: dict[int, list[int]] = field(default_factory=dict)


def lower_ascii(text: str) -> str:
    return text if text.islower() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        cut = rest.find(mark)
        if cut >= 0:
            rest = rest[:cut]
    host, slash, path = rest.partition("/")
    return lower_ascii(host), slash + path


def build_trie(rules: Sequence[tuple[str, str, str]]) -> Trie:
    """Trie of (verdict, host, path) rules; an empty host fits every host.

    A null host or path is empty; a rule without a verdict is none.
    """
    trie, sizes = Trie(), defaultdict(set)
    for verdict, host, path in rules:
        host, path = host or "", path or ""
        if verdict is None:
            continue
        if verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {verdict}")
        node = 0
        for label in reversed(host.split(".")) if host else ():
            node = trie.labels.setdefault((node, label), len(trie.labels) + 1)
        place = trie.paths.setdefault(node, -1 - node)
        *whole, start = path.split("/")
        for segment in whole:
            place = trie.segments.setdefault((place, segment), len(trie.segments))
        rank = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
        trie.starts[place, start] = max(rank, trie.starts.get((place, start), rank))
        sizes[place].add(len(start))
    trie.lengths = {place: sorted(some) for place, some in sizes.items()}
    return trie


def _best(trie: Trie, place: int | None, segments: list[str], best: tuple | None) -> tuple | None:
    for k, segment in enumerate(segments):
        for size in trie.lengths.get(place, ()):
            if size > len(segment):
                break
            rank = trie.starts.get((place, segment[:size]))
            if rank is not None and (best is None or rank > best):
                best = rank
        # The last segment has no "/" behind it, so it is never a whole one.
        if k == len(segments) - 1 or (place := trie.segments.get((place, segment))) is None:
            break
    return best


def longest_rule(trie: Trie, host: str, path: str) -> tuple[str, str] | None:
    """The rule (host and path) and verdict that decide, or None."""
    segments = path.split("/")
    best = _best(trie, trie.paths[0], segments, None) if 0 in trie.paths else None
    node = 0
    for label in reversed(host.split(".")):
        if (node := trie.labels.get((node, label))) is None:
            break
        if node in trie.paths:
            best = _best(trie, trie.paths[node], segments, best)
    return None if best is None else best[3:5]


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame,
    url: str = "url",
    keys: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    max_trie_bytes: int = MAX_TRIE_BYTES,
) -> DataFrame:
    """Judge every URL: ``keys``, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (verdict, host, path) tuples, or a DataFrame with these
    columns. Up to ``max_trie_bytes`` of rules are broadcast as a trie; a
    larger DataFrame is joined instead, with the same result. Where no rule
    fits, ``rule`` is null and the verdict is ``default``. A null URL, or one
    without ``://``, has an empty host and path. A rule's null host or path is
    empty, and a rule without a verdict is none. Narrow with a trie: repeated
    rows give repeated results, other columns are dropped.
    """
    if isinstance(rules, DataFrame):
        size = F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))
        if rules.agg(size).first()[0] > max_trie_bytes:
            return _by_join(pages, rules, url, keys, default)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            host, path, rule, verdict = [], [], [], []
            for value in batch.column(url).to_pylist():
                h, p = split_url(value)
                found = longest_rule(trie, h, p)
                host.append(h)
                path.append(p)
                rule.append(found[0] if found else None)
                verdict.append(found[1] if found else default)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], *[pa.array(x, pa.string()) for x in (host, path, rule, verdict)]],
                names=[*keys, "host", "path", "rule", "verdict"],
            )

    schema = T.StructType(
        [*[pages.schema[k] for k in keys], *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]]
    )
    return pages.select(*keys, url).mapInArrow(judge, schema)


def _by_join(pages: DataFrame, rules: DataFrame, url: str, keys: tuple[str, ...], default: str) -> DataFrame:
    """Each URL's host suffixes and path prefixes, joined with the rules."""
    ranked = (
        rules.where("verdict is not null")
        .groupBy(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
    )
    # Only path lengths that occur are tried; the set of lengths is small.
    lengths = [r[0] for r in ranked.select(F.length("r_path")).distinct().collect()]
    base = (
        pages.select(*keys, url)
        .withColumn("_rest", F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^?#]*)", 1))
        .withColumn("host", F.regexp_extract("_rest", r"(?s)^[^/]*", 0))
        .withColumn("path", F.expr("substring(_rest, length(host) + 1)"))
        .withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    )
    # Equal URLs are judged once; what they are joined back on is their text.
    tried = (
        base.select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
        .withColumn("_l", F.split("_host", r"\."))
        .withColumn("_n", F.explode(F.sequence(F.lit(0), F.size("_l"))))
        .withColumn("r_host", F.expr("array_join(slice(_l, size(_l) - _n + 1, _n), '.')"))
        .withColumn("_k", F.explode(F.array(*[F.lit(n) for n in lengths])))
        .where("_k <= length(_path)")
        .withColumn("r_path", F.expr("substring(_path, 1, _k)"))
        .join(ranked, ["r_host", "r_path"])
        .groupBy("_host", "_path")
        .agg(
            F.max_by(
                F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("v")),
                F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host")),
            ).alias("_best")
        )
    )
    same = (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))
    return base.join(tried, same, "left").select(
        *keys, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict")
    )
