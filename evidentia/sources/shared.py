"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where a session names none, one is set in local mode only, as in tests: on
    a cluster a machine's own folder would lose what others wrote.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        where = "/tmp/evidentia-checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, which lost executors do not lose."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch; Spark's own bound is 10,000 rows of whole texts, or 64 MB.
ARROW_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes from now on, unless the session sets a bound itself."""
    if spark.conf.get(_BOUND, None) is None:
        spark.conf.set(_BOUND, str(ARROW_BYTES))


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches are bounded by bytes, whatever the session sets."""
    before = spark.conf.get(_BOUND, None)
    spark.conf.set(_BOUND, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BOUND) if before is None else spark.conf.set(_BOUND, before)
