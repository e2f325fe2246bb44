"""The retrieval funnel: papers by vector, rerank, chunks by vector, rerank.

Ids and scores travel through the stages; texts are joined where they are
scored. Every order ends in a unique key, so ties are stable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import LOOKUP_CHARS, LOOKUP_CHUNKS, LOOKUP_IDS, PAPER_CHUNK_LIMIT, PREVIEW_CHARS, RRF_K, Funnel
from evidentia.functions import lexicons as lex
from evidentia.functions import text as X
from evidentia.functions.vectors import cosine
from evidentia.operators.ingest import year_from_id
from evidentia.sources.shared import written

#: A scorer makes a column of a query text and a text column.
Scorer = Callable[[str, Column], Column]


def format_query(buckets: Sequence[tuple[str, Sequence[str]]]) -> str:
    """All clauses of the ordered buckets, stripped, blanks left out."""
    return " ".join(c.strip() for _, clauses in buckets for c in clauses if c.strip())


def overlap_score(query: str, text: Column) -> Column:
    """Share of the query's distinct words that the text has."""
    wanted = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    if not wanted:
        return F.lit(0.0)
    terms = F.array(*[F.lit(w) for w in wanted])
    return F.size(F.array_intersect(terms, X.tokens(F.coalesce(text, F.lit(""))))) / F.lit(len(wanted))


def vector_literal(query: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def shallow_match(papers: DataFrame, query: Sequence[float], k: int = Funnel.k) -> DataFrame:
    """``pos, arxiv_id, sim`` of the nearest papers with a vector."""
    rows = papers.where(F.col("abstract_embedding").isNotNull()).select(
        "arxiv_id", cosine(F.col("abstract_embedding"), vector_literal(query)).alias("sim")
    )
    return positioned(rows.orderBy(F.desc("sim"), "arxiv_id").limit(k), F.desc("sim"), F.col("arxiv_id"))


def positioned(rows: DataFrame, *order: Column) -> DataFrame:
    """Number rows of a result that a limit has already made small."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def top_by_score(rows: DataFrame, top: int, score: str = "score", pos: str = "pos") -> DataFrame:
    """Highest scores first, ties in input order; numbered anew."""
    best = rows.orderBy(F.desc(score), pos).limit(max(0, top))
    return positioned(best.withColumnRenamed(pos, "_before"), F.desc(score), F.col("_before")).drop("_before")


def rerank_papers(
    papers: DataFrame, candidates: DataFrame, query: str, n: int = Funnel.n, scorer: Scorer = overlap_score
) -> DataFrame:
    """``pos, arxiv_id, score`` of the best ``n`` candidates (``pos, arxiv_id``)."""
    rows = candidates.select("pos", "arxiv_id").join(papers.select("arxiv_id", "abstract"), "arxiv_id")
    return top_by_score(rows.select("pos", "arxiv_id", scorer(query, F.col("abstract")).alias("score")), n)


def deep_match(chunks: DataFrame, papers: DataFrame, query: Sequence[float], c: int = Funnel.c_wide) -> DataFrame:
    """``pos, chunk_uuid, arxiv_id, sim``: exact nearest chunks of the papers."""
    scoped = chunks.where(F.col("chunk_embedding").isNotNull()).join(papers.select("arxiv_id"), "arxiv_id", "left_semi")
    rows = scoped.select("chunk_uuid", "arxiv_id", cosine(F.col("chunk_embedding"), vector_literal(query)).alias("sim"))
    return positioned(rows.orderBy(F.desc("sim"), "chunk_uuid").limit(c), F.desc("sim"), F.col("chunk_uuid"))


def rerank_chunks(
    chunks: DataFrame, candidates: DataFrame, query: str, top: int = Funnel.c_top, scorer: Scorer = overlap_score
) -> DataFrame:
    """The best ``top`` candidates (``pos, chunk_uuid``) with their texts and scores."""
    columns = ["chunk_uuid", "arxiv_id", "section_type", "section_order", "chunk_text", "token_count"]
    rows = candidates.select("pos", "chunk_uuid").join(chunks.select(*columns), "chunk_uuid")
    return top_by_score(rows.withColumn("score", scorer(query, F.col("chunk_text"))), top)


def funnel(
    papers: DataFrame, chunks: DataFrame, vector: Sequence[float], query: str, depth: Funnel = Funnel(), scorer: Scorer = overlap_score
) -> tuple[DataFrame, DataFrame]:
    """Chunks, and the metadata of their papers in the order of first mention."""
    # Each stage leaves a few hundred rows, which the next ones read; written,
    # they are not worked out again for every use.
    near = written(shallow_match(papers, vector, depth.k), "funnel")
    kept = written(rerank_papers(papers, near, query, depth.n, scorer), "funnel")
    scoped = chunks.join(F.broadcast(kept.select("arxiv_id")), "arxiv_id", "left_semi")
    wide = written(deep_match(scoped, kept, vector, depth.c_wide), "funnel")
    best = written(rerank_chunks(scoped, wide, query, depth.c_top, scorer), "funnel")
    first = best.groupBy("arxiv_id").agg(F.min("pos").alias("pos"))
    return best, fetch_papers(papers, first).orderBy("pos")


def fetch_papers(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids, with their year and without vectors."""
    rows = papers.drop("abstract_embedding").join(ids, "arxiv_id")
    return rows.withColumn("year", year_from_id("arxiv_id"))


def fetch_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.drop("chunk_embedding").join(ids.select("chunk_uuid").distinct(), "chunk_uuid")


def fetch_paper_chunks(chunks: DataFrame, per_paper: int = PAPER_CHUNK_LIMIT) -> DataFrame:
    """Up to ``per_paper`` chunks of each paper, its sections taken in turn."""
    by_section = Window.partitionBy("arxiv_id", "section_type").orderBy("section_order", "chunk_uuid")
    by_paper = Window.partitionBy("arxiv_id").orderBy("section_rank", "section_order", "chunk_uuid")
    return (
        chunks.drop("chunk_embedding")
        .withColumn("section_rank", F.row_number().over(by_section))
        .withColumn("rank", F.row_number().over(by_paper))
        .where(F.col("rank") <= per_paper)
    )


def lookup(rows: DataFrame, asked: DataFrame, key: str, pattern: str, most: int = LOOKUP_IDS) -> DataFrame:
    """Asked-for ids (``pos``, key) in order, each found, missing or invalid.

    More than ``most`` ids are refused with an error, none is left out.
    """
    if asked.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ids in one look-up")
    ids = asked.withColumn(key, F.lower(F.trim(key)))
    have = rows.select(key).distinct().withColumn("_have", F.lit(True))
    return ids.join(have, key, "left").select(
        "pos", key,
        F.when(~F.col(key).rlike(pattern), "invalid").when(F.col("_have"), "found").otherwise("missing").alias("status"),
    )


def lookup_chunks(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    return lookup(chunks, asked, "chunk_uuid", f"^{lex.UUID}$")


def trim_text(c: Column, most: int = LOOKUP_CHARS) -> Column:
    """A text cut to ``most`` characters, with a note of how many are left out."""
    more = F.concat(F.substring(c, 1, most), F.lit("… ["), (F.length(c) - most).cast("string"), F.lit(" more characters]"))
    return F.when(F.length(c) > most, more).otherwise(c)


def chunks_for_paper(chunks: DataFrame, paper: str, limit: int = LOOKUP_CHUNKS) -> DataFrame:
    return (
        chunks.where(F.col("arxiv_id") == paper)
        .select(
            "chunk_uuid", "section_type", "section_order", F.substring("chunk_text", 1, PREVIEW_CHARS).alias("preview"),
            F.length("chunk_text").alias("chars"),
        )
        .orderBy(F.col("section_order").asc_nulls_last(), "chunk_uuid")
        .limit(limit)
    )


def lexical_topk(papers: DataFrame, query: str, k: int, text: str = "abstract") -> DataFrame:
    """Papers that share a word with the query, by the share of its words."""
    scored = papers.select("arxiv_id", overlap_score(query, F.col(text)).alias("score")).where("score > 0")
    return positioned(scored.orderBy(F.desc("score"), "arxiv_id").limit(k), F.desc("score"), F.col("arxiv_id"))


def phrase_match(papers: DataFrame, phrase: str, k: int, text: str = "abstract") -> DataFrame:
    """Papers whose words hold the phrase's in a row, the most often first."""
    words = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split())
    if not words:
        return papers.select("arxiv_id", F.lit(0).alias("times"), F.lit(0).alias("pos")).limit(0)
    body = F.concat(F.lit(" "), X.normalize_span(F.coalesce(text, F.lit(""))), F.lit(" "))
    times = (F.length(body) - F.length(F.replace(body, F.lit(f" {words} "), F.lit("  ")))).cast("int")
    found = papers.select("arxiv_id", F.floor(times / F.lit(len(words))).cast("int").alias("times")).where("times > 0")
    return positioned(found.orderBy(F.desc("times"), "arxiv_id").limit(k), F.desc("times"), F.col("arxiv_id"))


def rrf(ranked: DataFrame, k: int = RRF_K, group: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of ``list, rank, doc_id`` (ranks from 1); ties by
    the first list, then the rank in it."""
    keys = [*group, "doc_id"]
    scored = ranked.groupBy(*keys).agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"), F.min(F.col("list") * 100000 + F.col("rank")).alias("first")
    )
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "first")
    return scored.withColumn("rank", F.row_number().over(order))


def sample_by_hash(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """A repeatable sample: the first ``n`` by a hash of key and seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def capacity(chunks: DataFrame, point: Sequence[str], papers: int) -> DataFrame:
    """Chunks per paper of each point: least, median, papers left without, characters."""
    per = chunks.groupBy(*point, "arxiv_id").agg(F.count("*").alias("_n"), F.sum(F.length("chunk_text")).alias("chars"))
    return per.groupBy(*point).agg(
        F.min("_n").alias("least"), F.median("_n").alias("median"), F.greatest(F.lit(0), papers - F.count("*")).alias("starved"),
        F.sum("chars").alias("chars"),
    )


def recall_of(approximate: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """Share of the exact ids that the approximate result has."""
    both = exact.select(key).distinct().join(approximate.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("exact"), F.count("_hit").alias("found"), X.rate(F.count("_hit"), F.count("*")).alias("recall"))
