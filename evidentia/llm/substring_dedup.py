"""Word-level substring dedup by prefix-partitioned suffix trees.

The suffixes of all texts are split into groups by prefixes of variable
length. A group is a stretch of neighbouring prefixes of ``gram`` words that
fits in memory; within it, suffixes that share longer prefixes branch further
down. A prefix with too many suffixes of its own is grouped by whole windows
instead (prefixes of ``window`` words), where only the smallest doc_id is kept
for each. The tree of a group is held as its sorted leaves and the depths at
which neighbours branch; an internal node at depth d is an interval of leaves
whose common prefix is at least d words. Nodes at least a window deep, joined
with what stands left of the suffix, are the repeats.

See :mod:`evidentia.llm.repeats` for how few suffixes have to be sent at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import counted_batches, gathered, list_array, partitions, ragged, stored, take_ragged, tidy
from evidentia.llm.repeats import (
    Shape,
    common_prefix,
    find_anchors,
    in_filter,
    merge_spans,
    resolve,
    shared_anchors,
    spans_by_document,
    union_spans,
)

FILTER_BITS = 27
SLICE_BYTES = 8 << 20
#: Suffixes of one group, and suffixes and documents of one prefix before it is
#: grouped by windows.
GROUP_ROWS = 60_000
HOT_PREFIX = 200_000


def read_words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts, offsets by text, and the words."""
    text = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    cut = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
    flat, bounds = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    real = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    kept = ragged(real.astype(np.int64))
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    return np.asarray(coded.indices).astype(np.int64), kept[bounds], words


def _read_hashed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    numbers, offsets, words = read_words(column)
    table = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return table[numbers] if len(words) else np.empty(0, np.uint64), offsets, words


def _same(symbols: np.ndarray) -> np.ndarray:
    return symbols


#: Without ``words``, a row holds spans (places, stops) known to be repeats.
ROWS = "prefix long, left int, words binary, docs array<long>, marks array<int>, places array<int>, stops array<int>"


def _distinct(numbers: np.ndarray, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray, left: np.ndarray):
    """Class of each stretch (equal words and left sides), and a row of each class.

    Stretches are grouped by a polynomial hash and then compared with the first
    of their group; one that differs is a class of its own.
    """
    power = np.full(len(numbers) + 1, np.uint64(0x9E3779B97F4A7C15))
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(numbers) + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    back[0] = 1
    back = np.cumprod(back)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes[numbers] * power[:-1])])
    key = ((sums[stop] - sums[start]) * back[start]) ^ (stop - start).astype(np.uint64)
    order = np.lexsort((left, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (left[order][1:] != left[order][:-1])])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    size = stop - start
    same = size == size[first[group]]
    check = np.flatnonzero(same & (first[group] != np.arange(len(group))))
    if len(check):
        one = take_ragged(numbers, start[check], size[check])
        two = take_ragged(numbers, start[first[group[check]]], size[check])
        same[check] = np.logical_and.reduceat(one == two, ragged(size[check])[:-1])
    odd = np.flatnonzero(~same)
    group[odd] = len(first) + np.arange(len(odd))
    return group, np.concatenate([first, odd])


def _suffixes(docs: DataFrame, shape: Shape, bitmap, filter_bits: int) -> DataFrame:
    """Surroundings of the anchors in the filter, distinct within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for table in gathered(batches, "text", SLICE_BYTES):
            ids, marks = table.column("doc").to_numpy(), table.column("mark").to_numpy()
            numbers, offsets, words = read_words(table.column("text"))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            kept: list[tuple] = []
            for a in find_anchors(numbers, offsets, shape, lambda s: hashes[s]):  # noqa: B023
                hit = in_filter(a.id, bits, filter_bits)
                kept.append((a.id[hit], a.at[hit], a.first[hit], a.last[hit] + shape.window, a.doc[hit]))
            if not sum(len(k[0]) for k in kept):
                continue
            prefix, at, start, stop, doc = (np.concatenate(x) for x in zip(*kept, strict=True))
            group, row = _distinct(numbers, hashes, start, stop, at - start)
            order = np.argsort(group, kind="stable")
            size = np.bincount(group, minlength=len(row))
            least = np.repeat(np.minimum.reduceat(ids[doc][order], ragged(size)[:-1]), size)
            repeated = ids[doc][order] > least
            gone = order[repeated]
            if len(gone):
                begin = offsets[doc[gone]]
                own, a, b = union_spans(doc[gone], start[gone] - begin, stop[gone] - begin)
                one = np.array([0, len(own)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prefix[-1:].view(np.int64)), pa.array([0], pa.int32()), pa.array([None], pa.binary()), list_array(ids[own], one),
                        list_array(marks[own].astype(np.int32), one), *[list_array(x.astype(np.int32), one) for x in (a, b)],
                    ],
                    names=["prefix", "left", "words", "docs", "marks", "places", "stops"],
                )
            order = order[~repeated]
            bounds = ragged(np.bincount(group[order], minlength=len(row)))
            text = [
                b" ".join(map(words.__getitem__, numbers[a:b].tolist()))
                for a, b in zip(start[row].tolist(), stop[row].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(prefix[row].view(np.int64)), pa.array((at - start)[row].astype(np.int32)), pa.array(text, pa.binary()),
                    list_array(ids[doc][order], bounds), list_array(marks[doc][order].astype(np.int32), bounds),
                    list_array((at - offsets[doc])[order].astype(np.int32), bounds), pa.nulls(len(row), pa.list_(pa.int32())),
                ],
                names=["prefix", "left", "words", "docs", "marks", "places", "stops"],
            )

    return docs.mapInArrow(tidy(run), ROWS)


class SuffixTree:
    """Suffixes of one group with their left sides, as leaves and branch depths."""

    def __init__(self, left: np.ndarray, texts: list[bytes], shape: Shape):
        number: dict[bytes, int] = {}
        rows = [[number.setdefault(w, len(number) + 1) for w in t.split(b" ")] for t in texts]
        n, grams = len(rows), shape.grams
        right = np.zeros((n, shape.window), np.int64)
        back = np.zeros((n, grams - 1), np.int64)
        length = np.array([len(r) for r in rows], np.int64) - left
        for k, (r, at) in enumerate(zip(rows, left.tolist(), strict=True)):
            right[k, : len(r) - at] = r[at:]
            back[k, :at] = r[:at][::-1]
        self.order = np.lexsort((length, *right.T[::-1]))
        self.depth = common_prefix(right[self.order], length[self.order])
        # Left sides in leaf order, so that both trees number the same leaves.
        back, size = back[self.order], left[self.order]
        self.left_order = np.lexsort((size, *back.T[::-1]))
        self.left_depth = common_prefix(back[self.left_order], size[self.left_order])
        self.most = size
        self.least = shape.window - length[self.order]


def _tree_spans(rows: list[tuple], shape: Shape) -> pa.RecordBatch:
    """Spans to remove, from the leaves of one group."""
    left = np.array([r[1] for r in rows], np.int64)
    tree = SuffixTree(left, [r[2] for r in rows], shape)
    count = np.array([len(rows[k][3]) for k in tree.order], np.int64)
    owner = np.repeat(np.arange(len(rows)), count)
    doc, mark, place = (np.concatenate([rows[k][c] for k in tree.order]).astype(np.int64) for c in (3, 4, 5))
    low, high = resolve(shape, tree.depth, tree.left_order, tree.left_depth, tree.least, tree.most, owner, doc)
    hit = np.flatnonzero(high >= 0)
    return _span_batch(doc[hit], mark[hit], place[hit] - high[hit], place[hit] - low[hit] + shape.window)


def _span_batch(doc, mark, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(mark.astype(np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
        names=["doc", "mark", "a", "b"],
    )


SPANS = "doc long, mark int, a long, b long"


def _windows(rows: list[tuple], shape: Shape) -> pa.RecordBatch:
    """All windows of suffixes whose prefix has too many: one row for each."""
    out: list[tuple] = []
    for _, left, text, docs, marks, places, _ in rows:
        w = text.split(b" ")
        for s in range(len(w) - shape.window + 1):
            window = b" ".join(w[s : s + shape.window])
            out += [(d, m, p - left + s, p - left + s + shape.window, window) for d, m, p in zip(docs, marks, places, strict=True)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "mark", "a", "b", "window"]
    )


def repeated_spans(
    rows: DataFrame, window: int, gram: int = 4, filter_bits: int = FILTER_BITS,
    group_rows: int = GROUP_ROWS, hot_prefix: int = HOT_PREFIX,
) -> DataFrame:
    """``doc, mark, a, b``: word spans that a window of a smaller ``doc`` covers.

    ``rows`` has ``doc`` (not null), ``mark`` and ``text``.
    """
    shape, spark = Shape(window, gram), rows.sparkSession
    bitmap = shared_anchors(rows, _read_hashed, _same, shape, filter_bits, "doc", "text")
    suffixes = _suffixes(rows, shape, bitmap, filter_bits)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        hot, now, size = None, None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("prefix", "left", "words", "docs", "marks", "places", "stops")]
            for row in zip(*columns, strict=True):
                if row[2] is None:
                    yield _whole(_span_batch(*(np.array(row[k], np.int64) for k in (3, 4, 5, 6))))
                    continue
                if row[0] != now:
                    now, size = row[0], 0
                    # A group ends between two prefixes, once it is large enough.
                    if held and (len(held) >= group_rows or hot is not None):
                        yield _windows(held, shape) if hot is not None else _whole(_tree_spans(held, shape))
                        held, hot = [], None
                    begin = len(held)
                held.append(row)
                size += 1 + len(row[3])
                if size > hot_prefix and hot is None:
                    # What came before this prefix is a group of its own.
                    if begin:
                        yield _whole(_tree_spans(held[:begin], shape))
                    held, hot = held[begin:], now
                if hot is not None and len(held) >= 5_000:
                    yield _windows(held, shape)
                    held = []
        if held:
            yield _windows(held, shape) if hot is not None else _whole(_tree_spans(held, shape))

    def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(batch.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, none], names=["doc", "mark", "a", "b", "window"])

    grouped = suffixes.repartition(partitions(spark), "prefix").sortWithinPartitions("prefix")
    with counted_batches(spark):
        found = stored(grouped.mapInArrow(tidy(trees), f"{SPANS}, window binary"), "substring-spans")
    # The smallest doc_id of a window is a combinable aggregate; the join back
    # goes by window and salt, so that no task holds a hot window.
    hot = found.where("window is not null").withColumn("salt", F.pmod(F.xxhash64("doc", "a"), F.lit(partitions(spark))))
    salted = hot.groupBy("window", "salt").agg(F.min("doc").alias("least"))
    least = salted.groupBy("window").agg(F.min("least").alias("least"))
    repeated = hot.join(salted.drop("least").join(least, "window"), ["window", "salt"]).where("least < doc")
    return found.where("window is null").drop("window").unionByName(repeated.select("doc", "mark", "a", "b"))


def with_mark(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``mark`` (a hash of the text, so that rows that share a key but
    not the text are told apart) and ``text``, null as empty."""
    return docs.select(
        F.col(key).cast("long").alias("doc"), F.hash(F.coalesce(text, F.lit(""))).alias("mark"),
        F.coalesce(text, F.lit("")).alias("text"),
    )


def substring_dedup(
    docs: DataFrame, window: int = 13, gram: int = 4, key: str = "doc_id", text: str = "text",
    filter_bits: int = FILTER_BITS, group_rows: int = GROUP_ROWS, hot_prefix: int = HOT_PREFIX,
) -> DataFrame:
    """Remove every word that a repeated window of a smaller doc_id covers.

    Words are maximal runs of anything but ASCII white space. Returns
    ``doc_id``, ``n_words``, ``n_removed``, ``spans`` (removed word spans, half
    open, merged) and ``kept`` (kept words, joined by one space), one row for
    each input row. Null and blank texts have no words. Rows with a null
    doc_id stay whole and are no one's smaller document. Repeated rows are one
    document: they never remove from each other. Other columns are dropped.
    """
    rows = with_mark(docs, key, text)
    spans = repeated_spans(rows.where("doc is not null"), window, gram, filter_bits, group_rows, hot_prefix)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = t.encode().split()
                cut = merge_spans([(s["a"], s["b"]) for s in found or ()], len(words))
                kept, at = [], 0
                for a, b in cut:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), [{"a": a, "b": b} for a, b in cut], b" ".join(kept).decode()))
            n, gone, cuts, kept_text = zip(*out, strict=True) if out else ([], [], [], [])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, kind), pa.array(kept_text, pa.string())],
                names=[key, "n_words", "n_removed", "spans", "kept"],
            )

    return spans_by_document(rows, spans).select("doc", "text", "spans").mapInArrow(
        tidy(apply), f"{key} long, n_words long, n_removed long, spans array<struct<a: long, b: long>>, kept string"
    )
