"""An index of vectors: an inverted file with product-quantised residuals.

Rows stand in the cell of their nearest centre, as codes: what is left of the
unit vector beside the centre, cut into ``parts`` pieces, each replaced by the
nearest of at most 256 typical pieces. A query looks into its nearest cells,
adds up one look-up table's entries for each code there, and compares only the
vectors of the best codes exactly.

The table is partitioned by cell, so that a search reads no other cell; codes
and vectors are columns of their own, so that the first step reads no vector.
Centres and pieces are fitted on at most ``SAMPLE_ROWS`` rows, those with the
least hashes of their id; all rows are indexed. The number of cells grows with
the root of the rows. How many cells a query looks into is measured on the
sample when the index is built: as many as hold ``RECALL`` of the sample's true
neighbours. Vectors without clusters thus cost more cells, not recall.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.config import hnsw_ef_for
from evidentia.functions.vectors import _unit_rows, cosine
from evidentia.sources.shared import written

#: Rows that centres, pieces and the number of cells looked into are fitted on.
SAMPLE_ROWS = 20_000
MOST_CELLS = 4_096
#: Share of the sample's true neighbours that the cells looked into hold.
RECALL = 0.98
#: Queries that are searched together: what the driver and every task hold.
BLOCK = 10_000
#: Least number of codes whose vectors are compared, for each row wanted.
REFINE = 5


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies and what a search has to know of it."""

    path: str
    rows: int
    centres: np.ndarray
    pieces: np.ndarray  # parts, up to 256, width
    probes: int

    @property
    def parts(self) -> int:
        return len(self.pieces)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for a in range(0, len(x), 4_096):
        out[a : a + 4_096] = (x[a : a + 4_096] @ centres.T - half).argmax(1)
    return out


def k_means(x: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """Centres of a sample; a centre without rows stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(np.int64)].copy()
    for _ in range(rounds):
        own = nearest_rows(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into ``parts`` equal pieces; zeros fill the last."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def _probes(x: np.ndarray, own: np.ndarray, centres: np.ndarray, depth: int, queries: int) -> int:
    """Cells that hold ``RECALL`` of the ``depth`` nearest rows of some rows of the sample."""
    asked = x[np.linspace(0, len(x) - 1, min(queries, len(x))).astype(np.int64)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :depth]
    order = np.argsort(-(asked @ centres.T - (centres * centres).sum(1) / 2), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), RECALL, method="higher")) + 1


def build_index(
    rows: DataFrame, path: str, id_: str = "doc_id", vector: str = "embedding", parts: int = 16, sample_rows: int = SAMPLE_ROWS, depth: int = 10
) -> VectorIndex:
    """Index all rows with a vector under ``path``; ids are distinct.

    Rows with a null id or vector are left out; all vectors have one length. An
    index of no rows can be built and finds nothing.
    """
    spark = rows.sparkSession
    kept = rows.where(F.col(vector).isNotNull() & F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    count = kept.count()
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()
    x = _unit_rows(sample.column("vector")) if sample.num_rows else np.zeros((1, 1))
    centres = k_means(x, max(1, min(MOST_CELLS, round(count**0.5))))
    own = nearest_rows(x, centres)
    parts = min(parts, x.shape[1])
    rest = _cut(x - centres[own], parts)
    typical = [k_means(rest[:, p], 256) for p in range(parts)]
    pieces = np.stack(typical)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit_rows(batch.column("vector"))
            cell = nearest_rows(unit, centres)
            left = _cut(unit - centres[cell], parts)
            codes = np.stack([nearest_rows(left[:, p], pieces[p]) for p in range(parts)], axis=1).astype(np.uint8)
            data = pa.py_buffer(np.ascontiguousarray(codes))
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(codes), [None, data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), code, pa.array(cell.astype(np.int32))], ["id", "vector", "code", "cell"]
            )

    kinds = T.StructType([*kept.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])
    coded = kept.mapInArrow(encode, kinds)
    # A cell of very many rows is dealt to several files.
    coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
    index = VectorIndex(path, count, centres, pieces, _probes(x, own, centres, depth, 500) if count else 1)
    held = io.BytesIO()
    np.savez(held, centres=centres, pieces=pieces, numbers=np.array([count, index.probes]))
    spark.createDataFrame([(bytearray(held.getvalue()),)], "index binary").coalesce(1).write.parquet(f"{path}/index")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before, by another session too."""
    held = np.load(io.BytesIO(bytes(spark.read.parquet(f"{path}/index").first()[0])))
    count, probes = held["numbers"].tolist()
    return VectorIndex(path, count, held["centres"], held["pieces"], probes)


class _Best:
    """The best rows of every query that a task has seen, in bounded memory."""

    def __init__(self, queries: int, most: int):
        self.most, self.least = most, np.full(queries, -np.inf, np.float32)
        self._ids: list[pa.Array] = []
        self._cells: list[np.ndarray] = []
        self._known, self._new = 0, 0
        self._parts: list[tuple[np.ndarray, ...]] = []

    def ids(self, ids: pa.Array, cells: np.ndarray) -> int:
        """Take down the rows of a batch; their numbers begin with the result."""
        if self._known > 1 << 20:
            self._trim()
            self._forget()
        base = self._known
        self._ids.append(ids)
        self._cells.append(cells)
        self._known += len(ids)
        return base

    def add(self, query: np.ndarray, row: np.ndarray, near: np.ndarray) -> None:
        self._parts.append((query, row, near))
        self._new += len(query)
        if self._new > 1 << 22:
            self._trim()

    def _trim(self) -> None:
        if not self._parts:
            return
        query, row, near = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        order = np.lexsort((row, -near, query))
        query, row, near = query[order], row[order], near[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query, "left")
        last = nth == self.most - 1
        self.least[query[last]] = near[last]
        kept = nth < self.most
        self._new, self._parts = 0, [(query[kept], row[kept], near[kept])]

    def _forget(self) -> None:
        """Rows that no query keeps go, and the others get new numbers."""
        query, row, near = self._parts[0] if self._parts else (np.empty(0, np.int64),) * 3
        used, row = np.unique(row, return_inverse=True)
        self._ids = [pa.concat_arrays(self._ids).take(pa.array(used))]
        self._cells = [np.concatenate(self._cells)[used]]
        self._known, self._parts = len(used), [(query, row, near)]

    def rows(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray] | None:
        if not self._parts:
            return None
        self._trim()
        self._forget()
        query, row, near = self._parts[0]
        return query, self._ids[0].take(pa.array(row)), self._cells[0][row], near


def index_candidates(
    spark: SparkSession, index: VectorIndex, wanted: pa.Table, candidates: int, probes: int | None = None
) -> DataFrame:
    """``q, cell, id, near``: the ``candidates`` best codes of each query (``q``, unit row ``v``) of a block."""
    names, x = wanted.column("q").combine_chunks(), _unit_rows(wanted.column("v"))
    centres, pieces = index.centres, index.pieces
    far = x @ centres.T - (centres * centres).sum(1) / 2
    looked = np.argsort(-far, axis=1, kind="stable")[:, : min(probes or index.probes, len(centres))]
    asks = np.zeros(far.shape, bool)
    np.put_along_axis(asks, looked, True, axis=1)
    to_centre = (x @ centres.T).astype(np.float32)
    # For every query and part, the inner product with each typical piece.
    tables = np.einsum("qpw,pkw->pkq", _cut(x, index.parts), pieces).astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Best(len(x), candidates)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.asarray(batch.column("cell"))
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(pieces))
            base = held.ids(batch.column("id"), cells)
            for cell in np.unique(cells):
                asking, own = np.flatnonzero(asks[:, cell]), np.flatnonzero(cells == cell)
                step = max(1, (1 << 22) // max(1, len(own)))
                for a in range(0, len(asking), step):
                    some = asking[a : a + step]
                    near = np.repeat(to_centre[some, cell][None, :], len(own), axis=0)
                    for p, table in enumerate(tables):
                        near += table[codes[own, p]][:, some]
                    row, at = np.nonzero(near >= held.least[some])
                    held.add(some[at], base + own[row], near[row, at])
        found = held.rows()
        if found is not None:
            query, ids, cells, near = found
            for a in range(0, len(query), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(query[part])), pa.array(cells[part]), ids.slice(a, 1 << 16), pa.array(near[part])], ["q", "cell", "id", "near"]
                )

    table = index.table(spark).where(F.col("cell").isin([int(c) for c in np.flatnonzero(asks.any(0))])).select("id", "code", "cell")
    kinds = T.StructType([
        T.StructField("q", T.LongType() if pa.types.is_integer(names.type) else T.StringType()), T.StructField("cell", T.IntegerType()),
        T.StructField("id", table.schema["id"].dataType), T.StructField("near", T.FloatType()),
    ])
    order = Window.partitionBy("q").orderBy(F.desc("near"), "id")
    found = table.mapInArrow(score, kinds)
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= candidates).drop("_n")


def over_fetch(index: VectorIndex, k: int) -> int:
    """Codes whose vectors are compared for each query: the policy's number, or a
    tenth of the rows, but ``REFINE`` for each row wanted at least."""
    return max(REFINE * k - 1, min(hnsw_ef_for(k), index.rows // 10 - 1))


def index_topk(
    spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int, id_: str = "doc_id",
    query_id: str = "query_id", query_vector: str = "query", probes: int | None = None, candidates: int | None = None,
) -> DataFrame:
    """Approximate ``query_id, rank, id, sim`` of all queries, ids long or string; ties go to the smaller id.

    The vectors of ``candidates`` codes of each query are compared exactly, those
    of ``over_fetch`` unless stated. Queries are worked on in blocks
    of about ``BLOCK``; null vectors are left out, and distinct ids are meant.
    """
    if candidates is None:
        candidates = over_fetch(index, k)
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<float>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asked
        wanted = block.toArrow()
        if not wanted.num_rows or not index.rows:
            continue
        near = written(index_candidates(spark, index, wanted, candidates, probes), "candidates")
        vectors = index.table(spark).select("cell", "id", "vector")
        pairs = near.join(vectors, ["cell", "id"]).join(block, "q").select("q", "id", cosine(F.col("vector"), F.col("v")).alias("sim"))
        order = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
        best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = written(best, "index-topk") if blocks > 1 else best
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = asked.select("q", F.lit(None).cast(index.table(spark).schema["id"].dataType if index.rows else "long").alias("id"), F.lit(0.0).alias("sim"), F.lit(0).alias("rank")).limit(0)
    return out.select(F.col("q").alias(query_id), "rank", F.col("id").alias(id_), "sim")
