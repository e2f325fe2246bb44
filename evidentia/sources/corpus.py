"""The corpus tables, from whatever holds its documents and vectors.

``papers`` and ``chunks`` have the fixed schemas below. The mapping from the
given tables (documents, embeddings) is one of many; operators only know the
schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import lexicons as lex
from evidentia.functions import text as X

PAPERS = (
    "arxiv_id string, title string, authors string, categories array<string>, arxiv_doi string, journal_ref string, "
    "current_ver string, update_date date, abstract string, abstract_embedding array<float>, embedding_version string"
)
CHUNKS = (
    "chunk_uuid string, arxiv_id string, section_type string, chunk_text string, chunk_embedding array<float>, "
    "token_count int, section_order int, embedding_version string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_id(doc: str = "doc_id"):
    d = F.col(doc)
    return F.format_string("%02d%02d.%05d", (15 + d % 12).cast("int"), (1 + d % 12).cast("int"), d)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, with a vector where there is one."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        paper_id().alias("arxiv_id"), F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), "source",
        F.array("lang", "source").alias("categories"), F.col("text").alias("abstract"),
        F.col("embedding").alias("abstract_embedding"), "doc_id",
    )


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True, first: bool = False) -> DataFrame:
    """One row for each line of a document that is not blank, or for the first of them."""
    kinds = F.array(*[F.lit(x) for x in lex.SECTION_TYPES])
    placed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("chunk_text")))
    written = F.filter(placed, lambda x: F.trim(x["chunk_text"]) != "")
    lines = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.explode(F.slice(written, 1, 1) if first else written).alias("_x"))
        .select("doc_id", "_x.*")
        .withColumn("arxiv_id", paper_id())
        .withColumn("section_type", F.element_at(kinds, ((F.col("doc_id") + F.col("line")) % 7 + 1).cast("int")))
        .withColumn("section_order", F.col("line").cast("int"))
        .withColumn("token_count", F.size(X.words("chunk_text")))
        .withColumn("chunk_uuid", X.chunk_uuid("arxiv_id", "section_type", "section_order"))
    )
    if vectors:
        stored = table(spark, sf_dir, "embeddings")
        size = F.lit(max(1, stored.count()))
        lines = lines.withColumn("vec_id", (F.col("doc_id") * 31 + F.col("line")) % size)
        lines = lines.join(stored, "vec_id").withColumnRenamed("embedding", "chunk_embedding")
    kept = ["chunk_uuid", "arxiv_id", "section_type", "section_order", "chunk_text", "token_count", "doc_id"]
    return lines.select(*kept, *(["chunk_embedding"] if vectors else []))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of all searches: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label")
    )
