"""Ids of six digits and more: documents beyond the first hundred thousand."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def later(spark, tmp_path_factory):
    """The documents under ids around 100,000 and 12,345,600, and other tables as they are."""
    at = tmp_path_factory.mktemp("later")
    for name in ("documents", "embeddings"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "documents":
            rows = rows.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 99_900).otherwise(F.col("doc_id") + 12_345_600))
        rows.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_ids_of_many_digits(spark):
    text = "See 2103.00020v3, 1501.100000v12 and 2612.12345678; not 12345.1, 123.12345 or 1501.x."
    assert spark.range(1).select(X.cited_ids(F.lit(text)).alias("x")).first()["x"] == ["2103.00020", "1501.100000", "2612.12345678"]


@pytest.mark.parametrize("name", ["a_claim_scores", "v_cited_ids", "v_claim_units", "v_resolve", "r_paper_envelope"])
def test_queries_over_later_documents(spark, later, name):
    query, sql = registry.ALL[name]
    out = query(spark, later)
    columns = sorted(out.columns)
    with duckdb.connect() as duck:
        for t in ("documents", "embeddings"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{later}/{t}.parquet/*.parquet')")
        want = duck.sql(sql)
        order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
        rows = collections.Counter(tuple(str(r[i]) for i in order) for r in want.fetchall())
    assert collections.Counter(tuple(map(str, r)) for r in out.select(*columns).collect()) == rows
