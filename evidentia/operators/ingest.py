"""Corpus ingest: metadata to manifest, keyed upserts, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.config import ID_YEARS, TARGET_CATEGORY
from evidentia.functions import text as X


def is_candidate(category: str = TARGET_CATEGORY, years: Sequence[str] = ID_YEARS) -> Column:
    """The category is a substring of the raw string; the id begins with a year."""
    return F.contains(F.col("categories"), F.lit(category)) & F.substring("id", 1, 2).isin(list(years))


def year_from_id(c: Column | str) -> Column:
    """Two leading digits as a year of this century, else null."""
    c = X.col(c)
    return F.when(c.rlike(r"^\d\d"), F.substring(c, 1, 2).try_cast("int") + 2000)


def parse_years(spec: str) -> list[str]:
    low, _, high = spec.partition("-")
    return [f"{y:02d}" for y in range(int(low), int(high or low) + 1)]


def markup_name() -> Column:
    """File name of a record's last version."""
    return F.concat("id", F.element_at("versions", -1)["version"], F.lit(".tei.xml"))


def build_manifest(
    metadata: DataFrame, files: DataFrame, category: str = TARGET_CATEGORY, years: Sequence[str] = ID_YEARS
) -> DataFrame:
    """Candidates with a version whose marked-up text is among ``files`` (``name``)."""
    rows = metadata.where(is_candidate(category, years) & (F.size("versions") > 0)).withColumn("tei_xml", markup_name())
    return rows.join(files.select(F.col("name").alias("tei_xml")), "tei_xml", "left_semi").select(
        F.col("id").alias("arxiv_id"), F.element_at("versions", -1)["version"].alias("version"), "tei_xml", "title", "authors",
        X.words("categories").alias("categories"), F.col("doi").alias("arxiv_doi"), F.col("journal-ref").alias("journal_ref"),
        "update_date", "abstract",
    )


def download_plan(targets: DataFrame, pdfs: DataFrame, xmls: DataFrame, key: str) -> DataFrame:
    """``action`` of each target: skip what is marked up, process what is fetched."""
    have = targets.join(xmls.select(key).distinct().withColumn("_x", F.lit(True)), key, "left").join(
        pdfs.select(key).distinct().withColumn("_p", F.lit(True)), key, "left"
    )
    action = F.when(F.col("_x"), "skip").when(F.col("_p"), "process").otherwise("download")
    return have.withColumn("action", action).drop("_x", "_p")


def upsert(current: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``batch`` replaces rows of ``current`` by ``key``; of several the last by ``order``.

    One shuffle of both on the key; idempotent.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    by = [F.desc("_new"), *([F.desc(order)] if order else [])]
    ranked = both.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*by)))
    return ranked.where("_rank = 1").drop("_rank", "_new")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where("_rank = 1").drop("_rank")


def not_loaded(rows: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    return rows.join(loaded.select(key).distinct(), key, "left_anti")


def foreign_key_violations(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti")


def apply_schema(spark: SparkSession, database: str = "default") -> None:
    """Create the two tables where they are missing; does nothing the second time."""
    from evidentia.sources.corpus import CHUNKS, PAPERS

    for name, schema in (("papers", PAPERS), ("chunks", CHUNKS)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def tables_exist(spark: SparkSession, database: str = "default") -> dict[str, bool]:
    return {name: spark.catalog.tableExists(f"{database}.{name}") for name in ("papers", "chunks")}


def drop_schema(spark: SparkSession, database: str = "default") -> None:
    for name in ("chunks", "papers"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def status_tally(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
