"""Shared plumbing: the shared folder, Arrow helpers, hot-key-safe components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.shared import shared_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and keeps a
    table that two consumers read from being computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Text that reaches a Python worker in one Arrow batch.
ARROW_BYTES = 4 << 20


def bounded(query: Callable) -> Callable:
    """The same query, whose Arrow batches are bounded by bytes.

    Spark's own bound is 10,000 rows, or 64 MB, of whole texts, which both the
    JVM and the worker hold. A bound that the session sets itself stays.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(ARROW_BYTES))
        return query(spark, *args)

    return run


@contextlib.contextmanager
def counted_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Within, Arrow batches are bounded by rows, not by bytes.

    For jobs that move millions of small rows: Spark adds up the bytes of all
    columns at every row, which took more time than the rows themselves.
    """
    names = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = [spark.conf.get(name, None) for name in names]
    spark.conf.unset(names[0])
    spark.conf.set(names[1], str(rows))
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Offsets (one more than rows) of rows with these lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def take_ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s+n]`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    step = np.arange(total, dtype=np.int64)
    step += np.repeat(starts - (ends - lengths), lengths)
    return values[step]


class Numbers(defaultdict):
    """Numbers new keys in order of appearance."""

    def __init__(self, keys: Iterable = ()):
        super().__init__(None, zip(keys, count()))
        self.default_factory = count(len(self)).__next__

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def fresh(self, keys: list) -> tuple[np.ndarray, list]:
        """Numbers of the keys, and the keys that are new, in order of their number."""
        known = len(self)
        numbers = self.of(keys)
        later = np.flatnonzero(numbers >= known)
        first = later[np.unique(numbers[later], return_index=True)[1]]
        return numbers, [keys[k] for k in first.tolist()]


class Stretches:
    """Numbers stretches of text in a table of bounded size.

    ``learn`` is called with each new stretch, in order of its number. Once
    there are more than ``most``, those that only one call has had since the
    last time are forgotten, or all if there are still too many; ``keep`` is
    told which numbers stay, in their new order.
    """

    def __init__(self, learn: Callable[[list[str]], None], keep: Callable[[np.ndarray], None]):
        self.learn, self.keep = learn, keep
        self.number, self.calls = Numbers(), np.zeros(1 << 12, np.uint8)

    def __len__(self) -> int:
        return len(self.number)

    def forget(self, stay: np.ndarray | None = None) -> None:
        stay = np.empty(0, np.int64) if stay is None else stay
        names = list(self.number)
        self.number = Numbers([names[k] for k in stay.tolist()])
        self.calls[:] = 0
        self.keep(stay)

    def numbered(self, stretches: pa.Array, most: int, step: int) -> np.ndarray:
        """Number of each stretch; new ones are learnt ``step`` at a time."""
        if len(self) > most:
            hot = np.flatnonzero(self.calls[: len(self)] > 1)
            self.forget(hot if len(hot) <= most // 2 else None)
        coded = stretches.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(self)
        numbers = self.number.of(distinct)
        if len(self) > len(self.calls):
            self.calls = np.resize(self.calls, len(self) * 3 // 2)
        self.calls[known : len(self)] = 0
        self.calls[numbers] += self.calls[numbers] < 255
        if len(self) > known:
            new = [distinct[k] for k in np.flatnonzero(numbers >= known).tolist()]
            for a in range(0, len(new), step):
                self.learn(new[a : a + step])
        return numbers[np.asarray(coded.indices)]


class Growing:
    """A growing array."""

    def __init__(self, kind: type, first: list[int] | None = None):
        self._held, self._size = np.empty(1 << 12, kind), 0
        self.extend(first or [])

    def __len__(self) -> int:
        return self._size

    @property
    def array(self) -> np.ndarray:
        return self._held[: self._size]

    def extend(self, more: np.ndarray | list[int]) -> None:
        end = self._size + len(more)
        if end > len(self._held):
            self._held = np.resize(self._held, end * 5 // 4)
        self._held[self._size : end] = more
        self._size = end


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def slices(
    batches: Iterator[pa.RecordBatch], text: str, most_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(
            pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)
        ).astype(np.int64)
        part = np.cumsum(size) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system, which the allocators would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gathered(
    batches: Iterator[pa.RecordBatch], text: str, most_bytes: int
) -> Iterator[pa.Table]:
    """Join batches into tables of about ``most_bytes`` of text each.

    Memory freed since the last table is given back before the next.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, text, most_bytes):
        n = batch.column(text).nbytes
        if held and size + n > most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
            give_back()
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def connected_components(
    links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, share: int | None = None
) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until
    the edges no longer change; each step is two shuffles of the edges, whose
    number never grows. The result has ``node`` and ``component`` for every
    node of an edge; nothing is collected but two numbers a round. With
    ``share``, steps have a task for that many edges, not more: each task
    leaves files for each of the shuffles.
    """
    edges = (
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges = checkpointed(edges)
    before: tuple | None = None
    size = edges.count() if share else 0

    def dealt(some: DataFrame) -> DataFrame:
        return some.coalesce(max(1, -(-size // share))) if share else some

    for _ in range(rounds):
        edges = dealt(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u goes to u's smallest neighbour (or u).
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = dealt(
            dealt(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        # Small star: u and all its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = dealt(
            dealt(
                joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(joined.select("u", F.col("m").alias("v")))
                .where("u <> v")
            ).distinct()
        )
        edges = checkpointed(small)
        now = tuple(
            edges.agg(
                F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
            ).first()
        )
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(mapper: Mapper) -> Mapper:
    """The same mapper, which gives freed memory back when its task ends.

    Python workers are used again by later tasks and stages; what their
    allocators keep would count against the executor all the time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(batches)
        finally:
            give_back()

    return run
