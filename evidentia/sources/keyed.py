"""A table that is updated by key, in place, batch by batch, each batch once.

Rows lie in ``buckets`` partitions by a hash of their key. A batch rewrites the
partitions that its keys fall into and leaves the files of all others alone.

A batch is first merged and written aside, then noted as pending, then put in
place (dynamic partition overwrite), then noted as done. Whoever opens the
table again finishes what is pending: the merged rows are whole partitions, so
that putting them in place a second time changes nothing. A batch that is done
is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from evidentia.operators.ingest import latest, upsert
from evidentia.sources.shared import written

LEDGER = "source string, batch long, state string, staged string, at timestamp"


class KeyedTable:
    """Rows of ``schema`` under ``path``; of one key the last by ``order`` of the last batch stays."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, order: str | None = None, buckets: int = 64):
        self.spark, self.path, self.schema = spark, path, schema
        self.key, self.order, self.buckets = key, order, buckets
        self.recover()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        return self._read(f"{self.path}/rows", StructType([*self.schema.fields]).add("bucket", IntegerType()))

    def _read(self, path: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._all().drop("bucket")

    def ledger(self) -> DataFrame:
        """What was noted of batches, a row for each step."""
        empty = self.spark.createDataFrame([], LEDGER)
        return self._read(f"{self.path}/ledger", empty.schema)

    def _note(self, source: str, batch: int, state: str, staged: str) -> None:
        row = self.spark.createDataFrame([(source, batch, state, staged, None)], LEDGER).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def _place(self, staged: str) -> None:
        whole = self.spark.read.parquet(staged)
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")

    def recover(self) -> None:
        """Finish the batches that are pending, of which there is one at most for each source."""
        steps = self.ledger()
        done = steps.where("state = 'done'").select("source", "batch")
        for r in steps.where("state = 'pending'").join(done, ["source", "batch"], "left_anti").orderBy("at").collect():
            self._place(r["staged"])
            self._note(r["source"], r["batch"], "done", r["staged"])

    def apply(self, rows: DataFrame, batch: int, source: str = "") -> bool:
        """Merge a batch; False if this batch of this source is done already.

        Rows with a null key are left out. Writers take turns: two at a time
        may both rewrite one partition.
        """
        if self.ledger().where((F.col("source") == source) & (F.col("batch") == batch) & (F.col("state") == "done")).limit(1).count():
            return False
        self.recover()
        fresh = rows.where(F.col(self.key).isNotNull()).select(*self.schema.names)
        fresh = latest(fresh, self.key, self.order) if self.order else fresh.dropDuplicates([self.key])
        fresh = written(fresh.withColumn("bucket", self._bucket()), "batch")
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` at most
        if touched:
            current = self._all().where(F.col("bucket").isin(touched))
            merged = written(upsert(current, fresh, self.key, self.order), "merged")
            staged = merged.inputFiles()[0].rsplit("/", 1)[0]
            self._note(source, batch, "pending", staged)
            self._place(staged)
        self._note(source, batch, "done", "")
        return True


def load_stream(
    stream: DataFrame, table: KeyedTable, checkpoint: str, source: str, shape: Callable[[DataFrame], DataFrame] | None = None, **trigger: bool
) -> StreamingQuery:
    """Start to merge a stream into a table, each of its batches once.

    The stream's checkpoint may bring a batch again after a crash; the ledger
    knows whether it was written. ``shape`` is applied to each batch before.
    """

    def one(rows: DataFrame, batch: int) -> None:
        table.apply(shape(rows) if shape else rows, batch, source)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
