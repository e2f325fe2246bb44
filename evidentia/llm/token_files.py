"""Token ids in ORC files.

Files hold ``doc_id``, ``ids`` and ``row`` (the row's number in its
partition) in ascending ``doc_id`` order, range partitioned, so the numbers in
their names are in order as well. ORC writes integers with run-length encoding (RLEv2), a row index every
``row_index_stride`` rows and a Bloom filter on ``doc_id`` in each stripe.
Readers split a file at its stripes, and skip stripes and row groups by their
statistics and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.bpe import BATCH_BYTES, codec
from evidentia.llm.common import gathered, list_array, partitions, stored, tidy

STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 10_000


def encode_sorted(
    docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, token ``ids`` with ``end_id`` last and ``row``, range partitioned and sorted.

    The texts are moved, not the ids: they are smaller. Rows with a null key
    come first; rows that share a key are in order of their text, and ranges
    part them by its beginning, so that a key of many texts has several tasks.
    """
    ordered = (
        docs.select(key, text)
        .repartitionByRange(partitions(docs.sparkSession), F.col(key), F.substring(text, 1, 64))
        .sortWithinPartitions(key, text)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = codec(vocabulary), 0
        for table in gathered(batches, text, BATCH_BYTES):
            flat, bounds = own.encode(table.column(text))
            flat = np.insert(flat, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column(key).combine_chunks(),
                    list_array(flat.astype(np.int32), bounds),
                    pa.array(np.arange(row, row + table.num_rows)),
                ],
                names=[key, "ids", "row"],
            )
            row += table.num_rows

    schema = T.StructType(
        [docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("row", T.LongType(), False)]
    )
    return ordered.mapInArrow(tidy(encode), schema)


def write_tokens(tokens: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ``key``, ``ids`` and ``row`` as ORC, keeping the partitions and their order."""
    (
        tokens.select(key, "ids", "row")
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(
    spark: SparkSession, path: str, keys: Iterable[int] | None = None, key: str = "doc_id"
) -> DataFrame:
    """The rows of the files, or of the stated keys only.

    A list of keys is pushed to the ORC reader, which leaves out the stripes
    and row groups whose statistics or Bloom filters exclude all of them.
    """
    out = spark.read.schema(
        T.StructType(
            [T.StructField(key, T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("row", T.LongType())]
        )
    ).orc(path)
    return out if keys is None else out.where(F.col(key).isin(list(keys)))


def token_positions(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """For each document in the files: ``start``, ``n_tokens`` and ``ids_crc32``.

    Counts and checksums are taken where a stripe is read. Starts add a
    running sum within a file to the sums of the files before it: one row a
    file, so what is summed in one task grows with the files alone.
    """
    # Files are in order of the number in their name, which may outgrow its five digits.
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    read = read_tokens(spark, path, key=key).select(key, "ids", "row", number.alias("part"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            bounds = np.asarray(ids.offsets).astype(np.int64)
            flat = memoryview(np.asarray(ids.values).astype("<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (key, "part", "row")), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                names=[key, "part", "row", "n_tokens", "ids_crc32"],
            )

    rows = stored(
        read.mapInArrow(tidy(digest), f"{key} long, part int, row long, n_tokens long, ids_crc32 long"),
        "token-positions",
    )
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = parts.select(
        F.col("part"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base")
    )
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("through", F.sum("n_tokens").over(within))
        .join(before, "part")
        .select(
            key,
            (F.col("base") + F.col("through") - F.col("n_tokens")).alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )
