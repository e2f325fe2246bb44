"""Shares that end in a half of the last digit."""

from pyspark.sql import functions as F

from evidentia.functions import text as X


def test_a_quotient_that_stands_for_a_half_goes_up(spark):
    rows = spark.createDataFrame([(0.333171,), (0.242631,), (-0.333171,), (0.2,), (None,)], "cost double")
    got = [r["x"] for r in rows.select(X.rounded(F.col("cost") / F.lit(0.2), 5).alias("x")).collect()]
    assert got == [1.66586, 1.21316, -1.66586, 1.0, None]
