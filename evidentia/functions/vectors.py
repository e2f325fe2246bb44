"""Vectors as arrays of float: expressions, and one Arrow top-k for many queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidentia.sources.shared import written


#: Rows and queries of a part of a cell.
TILE_ROWS, TILE_QUERIES = 8_192, 4_096


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def matryoshka(v: Column, dim: int) -> Column:
    """Layer norm over all entries, then the first ``dim``, scaled to length one."""
    n = F.size(v).cast("double")

    def let(value: Column, body) -> Column:
        """Name a value within an expression, so that it is computed once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double"))

    def unit(head: Column) -> Column:
        return let(F.greatest(F.sqrt(dot(head, head)), F.lit(1e-12)), lambda m: F.transform(head, lambda x: x / m))

    def normal(centred: Column) -> Column:
        return let(
            F.sqrt(dot(centred, centred) / n + 1e-5),
            lambda sd: let(F.transform(F.slice(centred, 1, dim), lambda x: x / sd), unit),
        )

    return let(total(v) / n, lambda m: let(F.transform(v, lambda x: x.cast("double") - m), normal))


def _unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column as rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best_rows(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` largest, ties by the smaller id."""
    if len(sims) > k:
        near = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k])
    else:
        near = np.arange(len(sims))
    return near[np.lexsort((ids[near], -sims[near]))[:k]]


def topk_many(
    rows: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", vector: str = "embedding",
    query_id: str = "query_id", query_vector: str = "query", max_queries: int = 10_000,
) -> DataFrame:
    """The ``k`` most similar rows of each query: ``query_id, rank, id, sim``.

    Each task multiplies its rows with the matrix of a block of queries and
    keeps its own best ``k`` of each; only these are shuffled. Ties go to the
    smaller id. Query ids are distinct. A block has about ``max_queries``
    queries, which is the bound of what the driver and every task hold; with
    more, blocks are worked on one after the other and written to the shared
    folder. Null vectors are left out.
    """
    if max_queries < 1:
        raise ValueError("a block has at least one query")
    queries = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    data = rows.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("vector"))
    blocks = max(1, -(-queries.count() // max_queries))
    # xxhash64 deals ids evenly, so no block is much over its share.
    parts = [queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks)]
    found = [_block_topk(data, part, k) for part in parts]
    if blocks > 1:
        found = [written(one, "topk") for one in found]
    return reduce(DataFrame.unionByName, found).select(
        F.col("q").alias(query_id), "rank", F.col("id").alias(id_), "sim"
    )


def _block_topk(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    wanted = queries.toArrow()
    names, matrix = wanted.column("q"), _unit_rows(wanted.column("v")) if wanted.num_rows else np.zeros((0, 0))
    step = max(1, (1 << 22) // max(1, len(names)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: pa.Array | None = None
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64)) for _ in range(len(names))]
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            # Ids are ranked among those at hand, so that ties compare as they do.
            base = 0 if ids is None else len(ids)
            every = batch.column("id") if ids is None else pa.concat_arrays([ids, batch.column("id")])
            rank = np.empty(len(every), np.int64)
            rank[np.asarray(pc.array_sort_indices(every))] = np.arange(len(every))
            x = _unit_rows(batch.column("vector"))
            for a in range(0, len(x), step):
                near = matrix @ x[a : a + step].T
                for j, sims in enumerate(near):
                    own_sims, own = kept[j]
                    at = _best_rows(sims, rank[base + a : base + a + len(sims)], k)
                    sims, rows_ = np.concatenate([own_sims, sims[at]]), np.concatenate([own, base + a + at])
                    at = _best_rows(sims, rank[rows_], k)
                    kept[j] = sims[at], rows_[at]
            used, where = np.unique(np.concatenate([r for _, r in kept]), return_inverse=True)
            ids = every.take(pa.array(used))
            cut = np.cumsum([0, *(len(r) for _, r in kept)])
            kept = [(s, where[a:b]) for (s, _), a, b in zip(kept, cut, cut[1:], strict=False)]
        if ids is not None:
            size = [len(r) for _, r in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    names.combine_chunks().take(pa.array(np.repeat(np.arange(len(names)), size))),
                    ids.take(pa.array(np.concatenate([r for _, r in kept]))),
                    pa.array(np.concatenate([s for s, _ in kept])),
                ],
                names=["q", "id", "sim"],
            )

    kinds = T.StructType([T.StructField("q", queries.schema["q"].dataType), T.StructField("id", data.schema["id"].dataType), T.StructField("sim", T.DoubleType())])
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return data.mapInArrow(best, kinds).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cell_centres(rows: DataFrame, cells: int, sample_rows: int, vector: str = "embedding", id_: str = "doc_id") -> np.ndarray:
    """Centres of a bounded sample's spherical k-means: unit rows."""
    order = F.xxhash64(id_), F.col(id_)
    sample = rows.where(F.col(vector).isNotNull()).orderBy(*order).limit(sample_rows).select(F.col(vector).alias("v")).toArrow()
    if not sample.num_rows:
        return np.zeros((1, 1))
    x = _unit_rows(sample.column("v"))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(np.int64)]
    for _ in range(12):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def cell_topk_many(
    rows: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", vector: str = "embedding", query_id: str = "query_id",
    query_vector: str = "query", cells: int = 32, probes: int = 22, sample_rows: int = 20_000, salts: int = 8,
) -> DataFrame:
    """Approximate top-k by an index of cells, for any number of queries.

    Centres are fitted on the ``sample_rows`` rows with the least hashes of
    their id; every row is indexed, in the cell of its nearest centre. A query
    looks at the ``probes`` nearest cells, exactly; a cell is dealt to
    ``salts`` parts or more, of about ``TILE_ROWS`` rows, and its queries to
    parts of about ``TILE_QUERIES``. Each two parts that meet are one product
    of matrices, which leaves ``k`` rows of each query. Columns as
    ``topk_many``.
    """
    centres = cell_centres(rows, cells, sample_rows, vector, id_)

    def nearest(count: int, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                # A single cell is everyone's; that of no rows has no length.
                near = np.zeros((batch.num_rows, 1), np.int64)
                if len(centres) > 1:
                    near = np.argsort(-(_unit_rows(batch.column("v")) @ centres.T), axis=1, kind="stable")[:, :count]
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(near.ravel().astype(np.int32))], names=[*names, "cell"])

        return run

    def dealt(df: DataFrame, name: str, key: str, value: str, count: int) -> DataFrame:
        picked = df.where(F.col(value).isNotNull()).select(F.col(key).alias(name), F.col(value).alias("v"))
        return picked.mapInArrow(nearest(count, [name, "v"]), T.StructType([*picked.schema.fields, T.StructField("cell", T.IntegerType())]))

    index, asked = dealt(rows, "id", id_, vector, 1), dealt(queries, "q", query_id, query_vector, probes)
    salts = max(salts, -(-rows.count() // (len(centres) * TILE_ROWS)))
    shares = max(1, -(-queries.count() * min(probes, len(centres)) // (len(centres) * TILE_QUERIES)))
    salt, share = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"), F.pmod(F.xxhash64("q"), F.lit(shares)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("salt", salt).withColumn("share", every(shares))
    right = asked.withColumn("share", share).withColumn("salt", every(salts))
    tile = ["cell", "salt", "share"]

    kinds = T.StructType([T.StructField("q", asked.schema["q"].dataType), T.StructField("id", index.schema["id"].dataType), T.StructField("sim", T.DoubleType())])
    none = to_arrow_schema(kinds).empty_table()

    def best(own: pa.Table, wanted: pa.Table) -> pa.Table:
        if not own.num_rows or not wanted.num_rows:
            return none
        own = own.take(pc.sort_indices(own, [("id", "ascending")]))
        x, y, place = _unit_rows(own.column("v")), _unit_rows(wanted.column("v")), np.arange(own.num_rows)
        step = max(1, (1 << 22) // len(x))
        near = [(at, sims[at]) for a in range(0, len(y), step) for sims in y[a : a + step] @ x.T for at in [_best_rows(sims, place, k)]]
        of = np.repeat(np.arange(len(y)), [len(at) for at, _ in near])
        at, sims = (np.concatenate(part) for part in zip(*near, strict=True))
        return pa.table({"q": wanted.column("q").take(pa.array(of)), "id": own.column("id").take(pa.array(at)), "sim": pa.array(sims)})

    pairs = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(best, kinds)
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("q").alias(query_id), "rank", F.col("id").alias(id_), "sim"
    )


def recall_many(approximate: DataFrame, exact: DataFrame, id_: str, query_id: str = "query_id") -> DataFrame:
    """Share of each query's exact rows that the approximate result has."""
    have = approximate.select(query_id, id_).distinct().withColumn("_hit", F.lit(1))
    both = exact.select(query_id, id_).distinct().join(have, [query_id, id_], "left")
    return both.groupBy(query_id).agg(F.count("*").alias("exact"), F.count("_hit").alias("found"))
