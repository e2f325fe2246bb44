"""Context-triggered piecewise hashing of whole texts.

A rolling hash over seven bytes ends a chunk wherever it equals ``size - 1``
modulo the block size; each chunk is written as one of 64 characters. The
block size is the smallest ``3 * 2**k`` that gives at most 64 chunks by the
length of the text, halved while the signature is under 32 characters. A
fingerprint holds the block size and the signatures at it and at its double,
so that texts whose sizes differ by up to a factor of two still compare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import partitions, stored, tidy

LEAST, MOST, WINDOW = 3, 64, 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power(n: int, inverse: bool) -> np.ndarray:
    """The first ``n`` powers of the odd base, or of its inverse, modulo 2**64."""
    have = _powers[inverse]
    if len(have) < n:
        base = np.full(1 << max(12, (n - 1).bit_length()), _ODD_INVERSE if inverse else _ODD, np.uint64)
        base[0] = 1
        have = _powers[inverse] = np.cumprod(base)
    return have[:n]


def _rolling(data: np.ndarray) -> np.ndarray:
    """Sum, position-weighted sum and shifted xor of the last seven bytes."""
    n = len(data)
    wide = np.zeros(n + WINDOW - 1, np.uint32)
    wide[WINDOW - 1 :] = data
    out, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        part = wide[WINDOW - 1 - back : WINDOW - 1 - back + n]
        out += part * np.uint32(WINDOW - back + 1)
        mixed ^= part << np.uint32(5 * back) if 5 * back < 32 else 0
    return out + mixed


def _signature(roll: np.ndarray, prefix: np.ndarray, size: int) -> bytes:
    """One character for each chunk; the last takes whatever is left."""
    n = len(roll)
    ends = np.flatnonzero(roll % np.uint32(size) == size - 1)[: MOST - 1] + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    chunk = (prefix[ends] - prefix[starts]) * _power(n + 1, True)[starts]
    chunk ^= chunk >> np.uint64(29)
    chunk *= np.uint64(0xBF58476D1CE4E5B9)
    return ALPHABET[(chunk >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(text: str) -> str:
    """``size:signature:signature at double size``; ``3::`` of an empty text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST}::"
    roll = _rolling(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(n, False), out=prefix[1:])
    size = LEAST
    while size * MOST < n:
        size *= 2
    signature = _signature(roll, prefix, size)
    while len(signature) < MOST // 2 and size > LEAST:
        size //= 2
        signature = _signature(roll, prefix, size)
    return f"{size}:{signature.decode()}:{_signature(roll, prefix, 2 * size).decode()}"


def edit_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """``1 - edit distance / longer length`` of each pair; two empty ones: 1."""
    if not left:
        return np.empty(0)
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    a, b = np.zeros((len(n), n.max()), np.uint8), np.ones((len(m), m.max()), np.uint8)
    for side, out in ((left, a), (right, b)):
        for k, x in enumerate(side):
            out[k, : len(x)] = np.frombuffer(x.encode(), np.uint8)
    steps = np.arange(b.shape[1] + 1, dtype=np.int16)
    row = np.broadcast_to(steps, (len(n), len(steps))).copy()
    distance = np.where(n == 0, m, 0)
    for i in range(a.shape[1]):
        new = row + np.int16(1)
        np.minimum(new[:, 1:], row[:, :-1] + (a[:, i : i + 1] != b), out=new[:, 1:])
        # Insertions: the best of all columns to the left, one step each.
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = np.flatnonzero(n == i + 1)
        distance[done] = row[done, m[done]]
    longest = np.maximum(n, m)
    return np.where(longest == 0, 1.0, 1.0 - distance / np.maximum(longest, 1))


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for each pair of fingerprints; 0 at incompatible block sizes."""
    out = np.zeros(len(pairs))
    which, left, right = [], [], []
    for k, (x, y) in enumerate(pairs):
        if x == y:
            out[k] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        for fits, u, v in ((p == q, p1, q1), (p == q, p2, q2), (int(p) == 2 * int(q), p1, q2), (2 * int(p) == int(q), p2, q1)):
            if fits:
                which.append(k)
                left.append(u)
                right.append(v)
    for a in range(0, len(which), 2048):
        np.maximum.at(out, which[a : a + 2048], edit_likeness(left[a : a + 2048], right[a : a + 2048]))
    return out.tolist()


def document_fingerprints(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keys`` and ``fingerprint`` of every whole text; null as empty. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x or "") for x in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], prints], names=[*keys, "fingerprint"]
            )

    schema = T.StructType([*[docs.schema[k] for k in keys], T.StructField("fingerprint", T.StringType())])
    return docs.select(*keys, text).mapInArrow(tidy(run), schema)


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _compared(rows: list[tuple]) -> list[pa.Array]:
    """Columns of ``_RESULT``, of (id, text, next text)."""
    prints = [fingerprint(t) for _, t, _ in rows]
    nexts = [fingerprint(x) for _, _, x in rows]
    cut = [(t[: len(t) - len(t) // 3] + x[: len(t) // 3]) if t else "" for _, t, x in rows]
    edited = [fingerprint(t) for t in cut]
    like = likeness([*zip(prints, edited, strict=True), *zip(prints, nexts, strict=True)])
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in cut], pa.string()),
        pa.array(prints, pa.string()),
        pa.array(edited, pa.string()),
        pa.array(like[: len(rows)], pa.float64()),
        pa.array(like[len(rows) :], pa.float64()),
    ]


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text, and compare with the next one.

    The edited text has its last third (code points, rounded down) replaced by
    as many from the start of the next text in descending ``key`` order; the
    first follows the last. Null texts are empty. Null keys come last; rows
    that share a key are in order of their text. A table of one row is its own
    next; an empty table gives no rows.

    Rows are dealt into ranges, of the key and the beginning of the text, and
    paired within them. The first and the last row of each range come out as
    they are; every last one then meets the first of the next range by a join.
    """
    spark = docs.sparkSession
    key_order = F.col("id").desc_nulls_last()
    rows = (
        docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
        .repartitionByRange(partitions(spark), key_order, F.substring("text", 1, 64).asc())
        .sortWithinPartitions(key_order, F.col("text").asc())
    )

    def edge(kind: str, row: tuple) -> pa.RecordBatch:
        none = [pa.nulls(1, f.type) for f in fields[1:]]
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([row[0]], pa.int64()), *none, pa.array([kind], pa.string()), pa.array([part], pa.int32()), pa.array([row[1]], pa.string())],
            names=[*names, "edge", "part", "text"],
        )

    def pairs(ready: list[tuple]) -> pa.RecordBatch:
        n = len(ready)
        return pa.RecordBatch.from_arrays(
            [*_compared(ready), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())],
            names=[*names, "edge", "part", "text"],
        )

    fields = [pa.field("doc_id", pa.int64()), pa.field("n_chars", pa.int64()), *[pa.field(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[pa.field(n, pa.float64()) for n in ("near_edited", "near_next")]]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for the next one
        ready: list[tuple] = []
        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held is None:
                    yield edge("first", row)
                else:
                    ready.append((*held, row[1]))
                held = row
                if len(ready) >= 512:
                    yield pairs(ready)
                    ready = []
        if ready:
            yield pairs(ready)
        if held is not None:
            yield edge("last", held)

    found = stored(rows.mapInArrow(tidy(run), f"{_RESULT}, edge string, part int, text string"), "fingerprints")
    # Two rows a range, and only range numbers are ordered in one task.
    first = found.where("edge = 'first'").select(F.col("part").alias("_part"), F.col("text").alias("next"))
    every = Window.orderBy("_part")
    after = first.select("_part").select(
        F.col("_part").alias("part"),
        F.coalesce(F.lead("_part").over(every), F.min("_part").over(every)).alias("_next"),
    )
    last = (
        found.where("edge = 'last'").select("doc_id", "text", "part").join(after, "part")
        .join(first, F.col("_next") == F.col("_part")).select("doc_id", "text", "next")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if rows:
                yield pa.RecordBatch.from_arrays(_compared(rows), names=names)

    return (
        found.where("edge is null").select(*names)
        .unionByName(last.mapInArrow(tidy(close), _RESULT))
        .withColumnRenamed("doc_id", key)
    )
