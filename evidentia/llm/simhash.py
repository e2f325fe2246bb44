"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits in three blocks. Two fingerprints at ``most`` or
fewer differing bits differ in ``most // 3`` bits at most within some block.
The anchors of a block are the words of a covering code of radius 1: the
Hamming [15, 11] code over its first fifteen bits, all words over the others.
A fingerprint's home is the anchor within 1; it is replicated to every anchor
within 1 + ``most // 3``. So the home of one of the two holds a replica of the
other, and a link is found where it is compared with its home's replicas.

That gives 2**17 anchors a block, and each holds more fingerprints the more
there are. Beyond ``WIDE_ABOVE`` distinct ones there are two blocks instead, of
the Hamming [31, 26] code and one more bit: a thousand times as many anchors,
for eight times the replicas. The links are the same.

Within an anchor, links are reduced to a spanning forest before they leave
the task; components are found over these edges, never over all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import (
    connected_components,
    partitions,
    ragged,
    stored,
    take_ragged,
    tidy,
)

BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
#: Fingerprints at home in an anchor, before they are dealt to several tasks.
SPLIT_ABOVE = 5_000
#: Distinct fingerprints from which the anchors are of the longer code.
WIDE_ABOVE = 1 << 25
_PARTS = 8192
_PAIRS = 1 << 20


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words, or of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = ragged(size + 1)
    k = min(width, len(words))
    of = xxhash.xxh64_intdigest
    begin, end = starts[: len(words) - k + 1].tolist(), (starts[k:] - 1).tolist()
    return np.array([of(whole[a:b], seed) for a, b in zip(begin, end, strict=True)], "<u8")


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Fingerprint of the word shingles of a text; 0 if it has no word."""
    h = shingle_hashes(text, width, seed)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        bits = np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    mask = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(mask.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long) of every whole text. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(x, width) for x in batch.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select(key, text).mapInArrow(tidy(run), "doc_id long, fp long")


@lru_cache
def _code(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each 15-bit word: its home, and the code words within ``radius``."""
    words = np.arange(1 << CODE_BITS)
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(CODE_BITS):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    home = np.where(syndrome == 0, words, words ^ (1 << np.maximum(syndrome - 1, 0)))
    found = [(words, home, (syndrome > 0).astype(np.int64))]
    for flips in range(2, radius + 1):
        for bits in combinations(range(CODE_BITS), flips):
            # Flips reach a code word if their columns sum to the syndrome.
            at = words[syndrome == reduce(xor, (b + 1 for b in bits))]
            found.append((at, at ^ sum(1 << b for b in bits), np.full(len(at), flips)))
    which, near, far = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(which, kind="stable")
    return home, near[order], far[order], ragged(np.bincount(which, minlength=len(words)))


def anchors(fp: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, is home) of every replica of the fingerprints."""
    home, near, far, bounds = _code(radius)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for block, (low, width) in enumerate(BLOCKS):
        bits = (fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        code, free = bits & (1 << CODE_BITS) - 1, bits >> CODE_BITS
        size = np.diff(bounds)[code]
        row = np.repeat(np.arange(len(fp)), size)
        anchor, distance = take_ragged(near, bounds[code], size), take_ragged(far, bounds[code], size)
        for flips in range(radius + 1):
            ok = distance + flips <= radius
            for bits_ in combinations(range(width - CODE_BITS), flips):
                mask = sum(1 << b for b in bits_)
                r, a = row[ok], anchor[ok]
                f = free[r] ^ mask
                key = block << 40 | f << CODE_BITS | a
                out.append((r, key, (flips == 0) & (a == home[code[r]])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@lru_cache
def _flips(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome of a 32-bit word (the [31, 26] code and one more bit): flips
    that lead to anchors within ``radius``, whether to its home, and bounds."""
    by: list[list[tuple[int, bool]]] = [[] for _ in range(32)]
    for n in range(radius + 1):
        for bits in combinations(range(31), n):
            syndrome = reduce(xor, (b + 1 for b in bits), 0)
            mask = sum(1 << b for b in bits)
            by[syndrome].append((mask, n <= 1))
            if n < radius:
                by[syndrome].append((mask | 1 << 31, False))
    flat = [x for own in by for x in own]
    return np.array([m for m, _ in flat], np.int64), np.array([h for _, h in flat]), ragged(np.array([len(own) for own in by]))


def wide_anchors(fp: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``anchors``, of two blocks of the longer code."""
    masks, homes, bounds = _flips(radius)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for block in range(2):
        word = (fp >> np.uint64(32 * block) & np.uint64((1 << 32) - 1)).astype(np.int64)
        syndrome = np.zeros(len(word), np.int64)
        for bit in range(31):
            syndrome ^= (word >> bit & 1) * (bit + 1)
        size = np.diff(bounds)[syndrome]
        which = take_ragged(np.arange(len(masks)), bounds[syndrome], size)
        row = np.repeat(np.arange(len(fp)), size)
        out.append((row, block << 40 | word[row] ^ masks[which], homes[which]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(fp: np.ndarray, home: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links that a home is part of.

    Breadth first; what has been reached is never compared again, so a large
    group of near copies costs little more than its size.
    """
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left):
        seed, left = left[0], left[1:]
        todo = [seed]
        while todo and len(left):
            x = todo.pop()
            close = np.bitwise_count(fp[left] ^ fp[x]) <= most
            if not home[x]:
                close &= home[left]
            if close.any():
                reached = left[close]
                left = left[~close]
                edges += [(int(x), int(y)) for y in reached]
                todo += reached.tolist()
    return edges


def _bucket_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, most: int):
    """Links (pairs of nodes) within each run of equal keys."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut, len(key)))
    homes = np.add.reduceat(home.astype(np.int64), cut) if len(cut) else size
    found_a, found_b = [], []
    # Small anchors: all homes against all replicas, many anchors at once.
    small = (homes > 0) & (size > 1) & (size <= 64)
    at = np.flatnonzero(home & np.repeat(small, size))
    group = np.repeat(np.arange(len(cut)), size)[at]
    for a in range(0, len(at), _PAIRS // 64):
        h, g = at[a : a + _PAIRS // 64], group[a : a + _PAIRS // 64]
        x, y = np.repeat(h, size[g]), take_ragged(np.arange(len(key)), cut[g], size[g])
        ok = (np.bitwise_count(fp[x] ^ fp[y]) <= most) & (node[x] != node[y])
        found_a.append(node[x[ok]])
        found_b.append(node[y[ok]])
    for g in np.flatnonzero((homes > 0) & (size > 64)):
        part = slice(cut[g], cut[g] + size[g])
        edges = np.array(_forest(fp[part], home[part], most), np.int64).reshape(-1, 2)
        found_a.append(node[part][edges[:, 0]])
        found_b.append(node[part][edges[:, 1]])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def fingerprint_links(prints: DataFrame, most: int = 4, split_above: int = SPLIT_ABOVE, wide_above: int = WIDE_ABOVE) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (``fp``) within ``most`` bits.

    Replicas of a fingerprint: about 45 for up to 5 bits, 300 for up to 8, and
    340 with the longer code, which is for up to 5 bits. An
    anchor that is home to over ``split_above`` is compared by several tasks:
    each gets all replicas and a part of those at home.
    """
    if not 0 <= most <= 8:
        raise ValueError("the anchors cover distances of 0 to 8")
    spark = prints.sparkSession
    prints = prints.select("fp")
    wide = most <= 5 and prints.count() > wide_above
    near = wide_anchors if wide else anchors
    radius = 1 + (max(1, most // 2) if wide else max(1, most // 3))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key, home = near(np.asarray(batch.column("fp")).view(np.uint64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(key[home])], names=["key"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 1024 if wide or radius > 2 else 8192
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            for a in range(0, len(fp), step):
                row, key, home = near(fp[a : a + step].view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fp[a : a + step][row]), pa.array(home)], names=["key", "fp", "home"]
                )

    # At most 3 * fingerprints / split_above anchors are hot: a small table.
    hot = (
        prints.mapInArrow(tidy(at_home), "key long").groupBy("key").count().where(F.col("count") > split_above)
        .select(F.col("key").alias("hot"), F.ceil(F.col("count") / split_above).cast("int").alias("parts"))
    )
    rows = prints.mapInArrow(tidy(replicate), "key long, fp long, home boolean")
    dealt = rows.join(hot, F.col("key") == F.col("hot"), "left").select(
        "key", "fp", "home", F.coalesce("parts", F.lit(1)).alias("parts"),
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"),
    )
    # One number names the anchor, the part and whether the row is at home there.
    own = F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part"))
    packed = dealt.select(((F.col("key") * _PARTS + F.col("part")) * 2 + own.cast("long")).alias("at"), "fp")
    ordered = packed.repartition(partitions(spark), F.shiftright("at", 1)).sortWithinPartitions("at")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links() -> pa.RecordBatch:
            at, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = _bucket_links(at >> 1, fp.view(np.uint64), fp, (at & 1).astype(bool), most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            at, fp = np.asarray(batch.column("at")), np.asarray(batch.column("fp"))
            if not len(at):
                continue
            if held and held[-1][0][-1] >> 1 != at[0] >> 1:
                yield links()
                held.clear()
            # The last anchor of a batch may go on in the next one.
            cut = int(np.searchsorted(at, (at[-1] >> 1) << 1))
            if cut:
                held.append((at[:cut], fp[:cut]))
                yield links()
                held.clear()
            held.append((at[cut:], fp[cut:]))
        if held:
            yield links()

    return ordered.mapInArrow(tidy(compare), "a long, b long")


def simhash_components(
    docs: DataFrame, width: int = 4, most: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every document.

    Copies of one fingerprint are one class, with its smallest doc_id as the
    representative; classes link at ``most`` or fewer bits, and a component is
    named by its smallest doc_id. Null and blank texts have fingerprint zero
    and link like any other. A row with a null doc_id names no component; its
    component is that of its fingerprint, null if all such ids are null.
    Repeated rows give repeated results; other columns are dropped.
    """
    prints = stored(fingerprints(docs, width, key, text), "simhash")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "simhash-classes")
    components = connected_components(fingerprint_links(reps, most))
    grouped = reps.join(components, F.col("fp") == components["node"], "left").select(
        F.col("fp").alias("_fp"), reps["node"].alias("least"), F.coalesce("component", "fp").alias("group")
    )
    named = grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("_fp", "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp"), "left").select(
        F.col("doc_id").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def simhash_dedup(
    docs: DataFrame, width: int = 5, most: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows of ``docs`` that are the smallest doc_id of their component.

    All columns stay. Rows with a null doc_id are kept.
    """
    lost = simhash_components(docs, width, most, key, text).where(F.col(key) != F.col("component_id"))
    return docs.join(lost.select(key).distinct(), key, "left_anti")
