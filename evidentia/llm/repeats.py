"""What the two exact-repeat operators share.

Both look for windows (so many consecutive symbols) that another document
holds too. To send as little as possible, each window is stood for by an
*anchor*, the gram in it with the least hash (leftmost on ties). Equal windows
have equal anchors at equal offsets, so

1. every task lists the distinct anchors of its texts; those that two documents
   hold are set in a filter of fixed size (``shared_anchors``). Anchors are
   made distinct before they are sent, so a passage that a third of all
   documents hold counts once for each slice of input;
2. only occurrences of anchors in the filter go on to the exact stage, with
   their surroundings and the run of windows that they stand for. The filter
   has no false negatives; a false positive only sends one anchor more. Of
   equal surroundings in one slice of input only those of the smallest doc_id
   go on, as those of all others are repeats already: a hot passage is sent
   once a slice, not once a document;
3. the exact stage orders the surroundings. A window at offset ``o`` from its
   anchor is the class of its left ``o`` symbols together with the class of
   its right ``window - o`` symbols, both intervals of common prefixes in
   sorted order (``resolve``). The smallest doc_id of each class decides;
4. spans go back to their documents by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import gathered, partitions, tidy

#: Text of one slice, within which anchors and surroundings are made distinct.
SLICE_BYTES = 12 << 20
#: Symbols whose positions are looked at together; their hashes fit in a core's cache.
PIECE = 1 << 15
_POS = 24
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)
ID_BITS = 47


@dataclass(frozen=True)
class Shape:
    """Windows of ``window`` symbols, anchors of ``gram`` symbols."""

    window: int
    gram: int

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Anchors:
    """Anchor positions, first and last window start, and document, by row."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    id: np.ndarray


_ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            out = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return [p[:n] for p in _powers]


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Anchors are least hashes, so small numbers; their ids use all 64 bits."""
    h = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` symbols in a row: a polynomial in them, mixed."""
    n = len(symbols)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=sums[1:])
    h = sums[k:] - sums[:-k]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= _MORE
    return h


def _anchors(symbols: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sliding least (hash, position) over the grams of each window."""
    h = gram_hash(symbols, shape.gram)
    key = (h >> np.uint64(_POS)) << np.uint64(_POS)
    key |= np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= shape.grams:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if rest := shape.grams - span:
        key = np.minimum(key[:-rest], key[rest:])
    return h, key & np.uint64((1 << _POS) - 1)


def find_anchors(symbols: np.ndarray, offsets: np.ndarray, shape: Shape, hashed: Callable) -> Iterator[Anchors]:
    """Anchors of all windows of documents that lie one after the other.

    ``hashed`` makes 64-bit hashes of symbols. Positions are in ``symbols``.
    """
    doc, end = 0, len(offsets) - 1
    while doc < end:
        # Whole documents up to a piece, or a piece of one that is longer.
        stop = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + PIECE, "right")) - 1)
        low, high = int(offsets[doc]), int(offsets[stop])
        for begin in range(low, max(high, low + 1), PIECE):
            part = slice(begin, min(high, begin + PIECE + shape.window - 1) if stop == doc + 1 else high)
            n = part.stop - part.start - shape.window + 1
            if n <= 0:
                break
            h, pos = _anchors(hashed(symbols[part]), shape)
            # A window that starts here would run over the end of its document.
            valid = np.ones(n, bool)
            for e in offsets[doc + 1 : stop].tolist():
                valid[max(0, e - part.start - shape.window + 1) : e - part.start] = False
            s = np.flatnonzero(valid)
            if not len(s):
                continue
            p = pos[s].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            last = np.append(new[1:] - 1, len(s) - 1)
            at = p[new]
            yield Anchors(
                at + begin,
                s[new] + begin,
                s[last] + begin,
                np.searchsorted(offsets, at + begin, "right") - 1,
                _spread(h[at]),
            )
        doc = stop


def runs_of(x: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def shared_anchors(
    docs: DataFrame, read: Callable, hashed: Callable, shape: Shape, filter_bits: int, key: str, text: str
) -> Broadcast:
    """Bitmap of the anchors that at least two documents hold, broadcast.

    A Bloom filter of ``2**filter_bits`` bits, two for each id, whatever
    the input: that is the bound of what the driver gathers. Each slice sends an anchor once (six bytes, in
    one row for each part of the id space), with a mark if the slice alone
    has it in two documents.
    """
    spark = docs.sparkSession
    part_bits = min(filter_bits - 4, max(4, (partitions(spark) - 1).bit_length()))
    low = ID_BITS + 1 - part_bits

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, text, SLICE_BYTES):
            names = table.column(key).to_numpy()
            symbols, offsets, _ = read(table.column(text))
            found, owner = [], []
            for a in find_anchors(symbols, offsets, shape, hashed):
                found.append(a.id >> np.uint64(64 - ID_BITS))
                owner.append(names[a.doc])
            if not found:
                continue
            one, own = np.concatenate(found), np.concatenate(owner)
            order = np.argsort(one)
            one, own = one[order], own[order]
            cut = runs_of(one)
            two = np.minimum.reduceat(own, cut) != np.maximum.reduceat(own, cut)
            marked = one[cut] << np.uint64(1) | two
            parts = (marked >> np.uint64(low)).astype(np.int64)
            raw = marked.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            edge = runs_of(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parts[edge].astype(np.int32)),
                    pa.array([raw[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(parts)], strict=True)], pa.binary()),
                ],
                names=["part", "ids"],
            )

    def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits(part: int, blobs: list[bytes]) -> pa.RecordBatch:
            raw = np.zeros((sum(map(len, blobs)) // 6, 8), np.uint8)
            raw[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
            marked = np.sort(raw.view("<u8").ravel())
            one = marked >> np.uint64(1)
            twice = np.flatnonzero(one[1:] == one[:-1])
            shared = np.concatenate([one[twice], one[marked & np.uint64(1) == 1]])
            size = filter_bits - part_bits
            out = np.zeros(1 << size, bool)
            for at in _places(shared, part_bits, size):
                out[at] = True
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.packbits(out).tobytes()], pa.binary())], names=["part", "bits"]
            )

        held, now = [], None
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if part != now and held:
                    yield bits(now, held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield bits(now, held)

    found = (
        docs.select(key, text)
        .mapInArrow(tidy(ids), "part int, ids binary")
        .repartition(partitions(spark), "part")
        .sortWithinPartitions("part")
        .mapInArrow(tidy(slices_of), "part int, bits binary")
        .toLocalIterator()
    )
    size = 1 << filter_bits - part_bits - 3
    bitmap = bytearray(1 << filter_bits - 3)
    for part, slice_ in found:
        bitmap[part * size : (part + 1) * size] = slice_
    return spark.sparkContext.broadcast((part_bits, bytes(bitmap)))


def _places(one: np.ndarray, part_bits: int, size: int) -> list[np.ndarray]:
    """The two bits of an id within the filter's part of its id space."""
    inner = one & np.uint64((1 << ID_BITS - part_bits) - 1)
    first = inner >> np.uint64(ID_BITS - part_bits - size)
    second = (inner * _MIX) >> np.uint64(64 - size)
    return [first.astype(np.int64), second.astype(np.int64)]


def in_filter(ids: np.ndarray, shared: tuple[int, bytes], filter_bits: int) -> np.ndarray:
    part_bits, bits = shared
    bitmap = np.frombuffer(bits, np.uint8)
    one = ids >> np.uint64(64 - ID_BITS)
    base = (one >> np.uint64(ID_BITS - part_bits)).astype(np.int64) << (filter_bits - part_bits)
    out = np.ones(len(ids), bool)
    for inner in _places(one, part_bits, filter_bits - part_bits):
        at = base + inner
        out &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def prefix_class(lcp: np.ndarray, length: int) -> np.ndarray:
    """For rows in sorted order: the first row of the interval (the internal
    node) whose common prefix is at least ``length``."""
    return np.maximum.accumulate(np.where(lcp < length, np.arange(len(lcp)), 0))


def packed(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian 64-bit words of byte rows, for np.lexsort."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return [c for c in wide.view(">u8").astype(np.uint64).T]


def common_prefix(a: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before, no longer than either."""
    out = np.zeros(len(a), np.int64)
    if len(a) > 1 and a.shape[1]:
        differ = a[1:] != a[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
        out[1:] = np.minimum(first, np.minimum(length[1:], length[:-1]))
    return out


def resolve(
    shape: Shape,
    right_lcp: np.ndarray,
    left_order: np.ndarray,
    left_lcp: np.ndarray,
    least_offset: np.ndarray,
    most_offset: np.ndarray,
    owner: np.ndarray,
    doc: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of each occurrence also start in a smaller document.

    Surroundings are in sorted order of their right sides; ``left_order`` sorts
    them by left sides, read from the anchor outwards. Occurrences have an
    ``owner`` (a row of surroundings) and a ``doc``. Returns the least and the
    most offset of their marked windows; -1 as the most if there is none. All
    windows between overlap, so the two bound the span that goes.
    """
    n = len(right_lcp)
    least_doc = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least_doc, owner, doc)
    low, high = np.full(len(doc), shape.window, np.int64), np.full(len(doc), -1, np.int64)
    left_class = np.empty(n, np.int64)
    for o in range(shape.grams):
        rows = np.flatnonzero((least_offset <= o) & (o <= most_offset))
        if not len(rows):
            continue
        left_class[left_order] = prefix_class(left_lcp, o)
        both = prefix_class(right_lcp, shape.window - o)[rows] * n + left_class[rows]
        order = np.argsort(both, kind="stable")
        cut = runs_of(both[order])
        least = np.full(n, np.iinfo(np.int64).max)
        least[rows[order]] = np.repeat(
            np.minimum.reduceat(least_doc[rows[order]], cut), np.diff(np.append(cut, len(rows)))
        )
        hit = np.flatnonzero(least[owner] < doc)
        low[hit] = np.minimum(low[hit], o)
        high[hit] = o
    return low, high


def union_spans(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each row, sorted."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    wide = row << np.int64(40)
    reach = np.maximum.accumulate(b + wide) if len(row) else b
    cut = np.flatnonzero(np.concatenate([[True], (a + wide)[1:] > reach[:-1]])) if len(row) else row
    last = np.append(cut[1:], len(row))[: len(cut)] - 1
    return row[cut], a[cut], reach[last] - wide[cut]


def merge_spans(spans: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """Union of half-open spans, clipped at ``end``."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        a, b = max(0, a), min(b, end)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans_by_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (doc, mark, ...) with an array ``spans`` of its span bounds, or null."""
    grouped = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(grouped, ["doc", "mark"], "left")
