"""Byte-level dedup by a common-prefix-aware distributed merge sort of suffixes.

Every slice of input sorts its suffixes into a run and front-codes it: each
suffix is sent as the length of the prefix that it shares with the one before,
and the rest, compressed. The exchange cuts runs at splitters, quantiles of the
first ``gram`` bytes of a bounded sample of suffixes, so that parts are ranges
of the order of all suffixes and equal beginnings meet. There, a tree of losers
merges the runs. It keeps,
for each loser, how much of it equals the last winner; these lengths mostly
decide a match by themselves, and where they tie, comparison starts behind
them, so no byte known to be equal is looked at again. The lengths that fall
out are the LCP array of the merged suffixes, in which repeats are intervals.

See :mod:`evidentia.llm.repeats` for how few suffixes have to be sent at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from evidentia.llm.common import gathered, partitions, ragged, take_ragged, tidy
from evidentia.llm.repeats import (
    SLICE_BYTES,
    Shape,
    common_prefix,
    find_anchors,
    in_filter,
    merge_spans,
    packed,
    resolve,
    runs_of,
    shared_anchors,
    spans_by_document,
    union_spans,
)
from evidentia.llm.substring_dedup import SPANS, _span_batch, with_mark

FILTER_BITS = 27
#: Documents, and suffixes of each, that splitters are chosen by.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 4_000, 64
_BYTE_HASH = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64)


def read_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, None]:
    """UTF-8 bytes of all texts, and offsets by text."""
    text = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(text, pa.ChunkedArray):
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], None


def _hashed(symbols: np.ndarray) -> np.ndarray:
    return _BYTE_HASH[symbols]


RUN = (
    "part int, n int, lcp binary, rest binary, length binary, left binary, lefts binary, "
    "count binary, doc binary, mark binary, place binary"
)


def _padded(data: np.ndarray, shape: Shape) -> np.ndarray:
    return np.concatenate([np.zeros(shape.grams, np.uint8), data, np.zeros(shape.window, np.uint8)])


def _sides(wide: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, shape: Shape):
    """Right and left surroundings of anchors as byte rows, padded with zeros."""
    length, left = last + shape.window - at, at - first
    around = sliding_window_view(wide, shape.grams + shape.window)[at]
    right = around[:, shape.grams :]
    right[np.arange(shape.window) >= length[:, None]] = 0
    back = np.ascontiguousarray(around[:, shape.grams - 1 : 0 : -1])
    back[np.arange(shape.grams - 1) >= left[:, None]] = 0
    return right, length, back, left


def _beginnings(data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """First ``gram`` bytes of the suffixes at anchors, as strings that compare."""
    if not len(at):
        return np.empty(0, f"S{gram}")
    return np.ascontiguousarray(sliding_window_view(data, gram)[at]).view(f"S{gram}").ravel()


def splitters(rows: DataFrame, shape: Shape, bitmap, filter_bits: int, parts: int) -> np.ndarray:
    """Beginnings that cut the suffixes to be sent into about ``parts`` equal ranges.

    They only decide how even the parts are. Of about ``SAMPLE_DOCS`` documents
    at most ``SAMPLE_SUFFIXES`` beginnings each come to the driver.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for table in gathered(batches, "text", SLICE_BYTES):
            data, offsets, _ = read_bytes(table.column("text"))
            for a in find_anchors(data, offsets, shape, _hashed):
                hit = np.flatnonzero(in_filter(a.id, bits, filter_bits))
                # Every document's suffixes at even distances.
                first = np.searchsorted(a.doc[hit], a.doc[hit])
                last = np.searchsorted(a.doc[hit], a.doc[hit], "right")
                step = np.maximum(1, -(-(last - first) // SAMPLE_SUFFIXES))
                hit = hit[(np.arange(len(hit)) - first) % step == 0]
                found = _beginnings(data, a.at[hit], shape.gram).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["found"])

    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    taken = rows.sample(share, seed=50).mapInArrow(tidy(sample), "found binary").collect()
    every = np.sort(np.frombuffer(b"".join(bytes(r["found"]) for r in taken), f"S{shape.gram}"))
    return np.unique(every[np.arange(1, parts) * len(every) // parts]) if len(every) else every


def _runs(rows: DataFrame, shape: Shape, bitmap, filter_bits: int, cuts: np.ndarray) -> DataFrame:
    """Sorted, front-coded runs of the suffixes at the anchors in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for table in gathered(batches, "text", SLICE_BYTES):
            docs, marks = table.column("doc").to_numpy(), table.column("mark").to_numpy()
            data, offsets, _ = read_bytes(table.column("text"))
            kept: list[tuple] = []
            for a in find_anchors(data, offsets, shape, _hashed):
                hit = in_filter(a.id, bits, filter_bits)
                kept.append((a.at[hit], a.first[hit], a.last[hit], a.doc[hit]))
            if not kept:
                continue
            at, first, last, doc = (np.concatenate(x) for x in zip(*kept, strict=True))
            part = np.searchsorted(cuts, _beginnings(data, at, shape.gram), "right")
            wide = _padded(data, shape)
            place = at - offsets[doc]
            done = np.zeros(len(at), bool)
            dealt = np.argsort(part, kind="stable")
            edges = np.append(runs_of(part[dealt]), len(dealt))
            for a, b in zip(edges, edges[1:], strict=False):
                w = dealt[a:b]
                batch, repeated = _front_coded(
                    int(part[w[0]]), *_sides(wide, at[w], first[w], last[w], shape), docs[doc[w]], marks[doc[w]], place[w]
                )
                done[w[repeated]] = True
                yield batch
            if done.any():
                row, a, b = union_spans(doc[done], (first - offsets[doc])[done], (last + shape.window - offsets[doc])[done])
                yield _run_row(int(part[dealt[-1]]), 0, {"doc": docs[row].astype("<i8"), "mark": marks[row].astype("<i4"), "place": a.astype("<i8"), "rest": b.astype("<i8")})

    return rows.mapInArrow(tidy(run), RUN)


def _sorted(right: np.ndarray, length: np.ndarray, back: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of the suffixes; only those with equal beginnings look further."""
    words = packed(right)
    order = np.argsort(words[0], kind="stable")
    first = words[0][order]
    tied = np.zeros(len(order), bool)
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:]
    rows = order[tied]
    if len(rows):
        keys = left[rows], *packed(back[rows])[::-1], length[rows], *[w[rows] for w in words[::-1]]
        order[tied] = rows[np.lexsort(keys)]
    return order


def _run_row(part: int, n: int, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A run of ``n`` suffixes; with 0, spans (doc, mark, place, rest) known to be repeats."""
    compress = zstandard.ZstdCompressor(3).compress
    names = ["lcp", "rest", "length", "left", "lefts", "count", "doc", "mark", "place"]
    packed_ = [compress(values[c].tobytes()) if c in values else b"" for c in names]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([n], pa.int32()), *[pa.array([v], pa.binary()) for v in packed_]],
        names=["part", "n", *names],
    )


def _front_coded(part, right, length, back, left, doc, mark, place) -> tuple[pa.RecordBatch, np.ndarray]:
    """A run, and which occurrences have equal surroundings in a smaller doc."""
    order = _sorted(right, length, back, left)
    right, length, back, left = right[order], length[order], back[order], left[order]
    same = np.zeros(len(order), bool)
    same[1:] = (
        (right[1:] == right[:-1]).all(axis=1) & (back[1:] == back[:-1]).all(axis=1)
        & (length[1:] == length[:-1]) & (left[1:] == left[:-1])
    )
    rows = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(doc[order], rows), np.diff(np.append(rows, len(order))))
    repeated = doc[order] > least
    sent = order[~repeated]
    count = np.add.reduceat((~repeated).astype("<i4"), rows)
    right, length, back, left = right[rows], length[rows], back[rows], left[rows]
    lcp = common_prefix(right, length)
    column = np.arange(right.shape[1])
    values = {
        "lcp": lcp.astype(np.uint8),
        "rest": right[(column >= lcp[:, None]) & (column < length[:, None])],
        "length": length.astype(np.uint8),
        "left": left.astype(np.uint8),
        "lefts": back[np.arange(back.shape[1]) < left[:, None]],
        "count": count.astype("<i4"),
        "doc": doc[sent].astype("<i8"), "mark": mark[sent].astype("<i4"), "place": place[sent].astype("<i4"),
    }
    return _run_row(part, len(rows), values), order[repeated]


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while a[known : known + 8] == b[known : known + 8]:
        known += 8
    while a[known] == b[known]:
        known += 1
    return known


def merge_runs(runs: list[list[bytes]], lcps: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs with a tree of losers that keeps common prefixes.

    ``lcps[r][i]``: common prefix of ``runs[r][i]`` and the one before it (0 for
    the first). Returns run, index and common prefix with the one before, of
    each string in order. Ties go to the earlier run.
    """
    k = 1
    while k < len(runs):
        k *= 2
    runs = [*runs, *[[] for _ in range(k - len(runs))]]
    size, at = [len(r) for r in runs], [0] * k
    # A match: the run that goes on, with the common prefix to the last output.
    loser, known = [0] * k, [0] * k
    out_run, out_index, out_lcp = [], [], []

    def match(a: int, p: int, b: int, q: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix (to the winner)."""
        if at[a] >= size[a]:
            return b, q, a, p
        if at[b] >= size[b] or p > q:
            return a, p, b, q
        if p < q:
            return b, q, a, p
        x, y = runs[a][at[a]], runs[b][at[b]]
        h = _common(x, y, p)
        if h == len(x):
            first = h < len(y) or a < b
        else:
            first = h < len(y) and x[h] < y[h]
        return (a, p, b, h) if first else (b, p, a, h)

    def fill(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        w, p, loser[node], known[node] = match(*fill(2 * node), *fill(2 * node + 1))
        return w, p

    w, p = fill(1) if k > 1 else (0, 0)
    for _ in range(sum(size)):
        i = at[w]
        out_run.append(w)
        out_index.append(i)
        out_lcp.append(p)
        at[w] = i + 1
        p = lcps[w][i + 1] if i + 1 < size[w] else 0
        node = (w + k) // 2
        while node:
            # Both sides' prefixes are to the last output, so they compare.
            q, other = known[node], loser[node]
            if at[w] < size[w] and (at[other] >= size[other] or p > q):
                pass
            else:
                w, p, loser[node], known[node] = match(w, p, other, q)
            node //= 2
    return out_run, out_index, out_lcp


def _decode(row: dict) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray]:
    lcp = np.frombuffer(row["lcp"], np.uint8).astype(np.int64)
    length = np.frombuffer(row["length"], np.uint8).astype(np.int64)
    left = np.frombuffer(row["left"], np.uint8).astype(np.int64)
    out, before, begin, rest = [], b"", 0, row["rest"]
    for p, n in zip(lcp.tolist(), (length - lcp).tolist(), strict=True):
        before = before[:p] + rest[begin : begin + n]
        begin += n
        out.append(before)
    return out, lcp.tolist(), length, left, np.frombuffer(row["count"], "<i4").astype(np.int64)


def _merged_spans(rows: list[dict], shape: Shape) -> pa.RecordBatch:
    """Spans to remove, from all runs of one part."""
    texts, lcps, length, left, count = zip(*map(_decode, rows), strict=True)
    run, index, lcp = (np.array(x, np.int64) for x in merge_runs(list(texts), list(lcps)))
    base = ragged(np.array([len(t) for t in texts]))
    order = base[run] + index
    length, left, count = (np.concatenate(x) for x in (length, left, count))
    flat = np.frombuffer(b"".join(r["lefts"] for r in rows), np.uint8)
    back = np.zeros((len(left), shape.grams - 1), np.uint8)
    back[np.arange(shape.grams - 1) < left[:, None]] = flat
    begin = ragged(count)
    back, left, length = back[order], left[order], length[order]
    left_order = np.lexsort((left, *packed(back)[::-1]))
    left_lcp = common_prefix(back[left_order], left[left_order])
    size = count[order]
    owner = np.repeat(np.arange(len(order)), size)
    doc, mark, place = (
        take_ragged(np.concatenate([np.frombuffer(r[c], kind) for r in rows]), begin[order], size).astype(np.int64)
        for c, kind in (("doc", "<i8"), ("mark", "<i4"), ("place", "<i4"))
    )
    low, high = resolve(shape, lcp, left_order, left_lcp, shape.window - length, left, owner, doc)
    hit = np.flatnonzero(high >= 0)
    return _span_batch(doc[hit], mark[hit], place[hit] - high[hit], place[hit] - low[hit] + shape.window)


def repeated_byte_spans(rows: DataFrame, window: int, gram: int = 24, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc, mark, a, b``: byte spans that a window of a smaller ``doc`` covers.

    ``rows`` has ``doc`` (not null), ``mark`` and ``text``.
    """
    if not gram <= window < 256:
        raise ValueError("a window has between a gram and 255 bytes")
    shape, spark = Shape(window, gram), rows.sparkSession
    bitmap = shared_anchors(rows, read_bytes, _hashed, shape, filter_bits, "doc", "text")
    # More parts than tasks, as a task holds one at a time.
    cuts = splitters(rows, shape, bitmap, filter_bits, 2 * partitions(spark))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                row = {k: decompress(v) if v and isinstance(v, bytes) else v for k, v in row.items()}
                if not row["n"]:
                    yield _span_batch(*(np.frombuffer(row[c], "<i4" if c == "mark" else "<i8") for c in ("doc", "mark", "place", "rest")))
                    continue
                if held and row["part"] != held[0]["part"]:
                    yield _merged_spans(held, shape)
                    held = []
                held.append(row)
        if held:
            yield _merged_spans(held, shape)

    return (
        _runs(rows, shape, bitmap, filter_bits, cuts)
        .repartition(partitions(spark), "part")
        .sortWithinPartitions("part")
        .mapInArrow(tidy(merge), SPANS)
    )


def cut_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def suffix_dedup(
    docs: DataFrame, window: int = 50, gram: int = 24, key: str = "doc_id", text: str = "text",
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Remove every byte that a repeated ``window`` of a smaller doc_id covers.

    Texts are UTF-8 bytes; windows never cross documents and are judged on the
    input. Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (maximal
    removed runs, half open) and ``kept`` (binary), one row for each input row.
    Null texts are empty. Rows with a null doc_id stay whole and are no one's
    smaller document. Repeated rows are one document: they never remove from
    each other. Other columns are dropped.
    """
    rows = with_mark(docs, key, text)
    spans = repeated_byte_spans(rows.where("doc is not null"), window, gram, filter_bits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, cuts, kept = [], [], [], []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = t.encode()
                cut = merge_spans([(s["a"], s["b"]) for s in found or ()], len(data))
                rest = cut_bytes(data, cut)
                size.append(len(data))
                gone.append(len(data) - len(rest))
                cuts.append([{"a": a, "b": b} for a, b in cut])
                kept.append(rest)
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary())],
                names=[key, "n_bytes", "n_removed", "spans", "kept"],
            )

    return spans_by_document(rows, spans).select("doc", "text", "spans").mapInArrow(
        tidy(apply), f"{key} long, n_bytes long, n_removed long, spans array<struct<a: long, b: long>>, kept binary"
    )


def suffix_dedup_rows(
    docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text", n_chars: str | None = None
) -> DataFrame:
    """``docs`` with ``text`` cut likewise, and ``n_chars`` brought up to date.

    All rows and columns stay. Where a cut splits a character of several bytes,
    its remaining bytes, which are no text any more, go as well.
    """
    spans = repeated_byte_spans(with_mark(docs, key, text).where("doc is not null"), window)
    names = docs.columns
    grouped = spans_by_document(
        docs.selectExpr(
            "struct(*) as row", f"cast(`{key}` as long) as doc", f"hash(coalesce(`{text}`, '')) as mark"
        ),
        spans,
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            columns = dict(zip(names, row.flatten(), strict=True))
            out = []
            for t, found in zip(columns[text].to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if found:
                    data = t.encode()
                    t = cut_bytes(data, merge_spans([(s["a"], s["b"]) for s in found], len(data))).decode("utf-8", "ignore")
                out.append(t)
            columns[text] = pa.array(out, pa.string())
            if n_chars:
                columns[n_chars] = pa.array([None if t is None else len(t) for t in out], columns[n_chars].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return grouped.select("row", "spans").mapInArrow(tidy(apply), docs.schema)
