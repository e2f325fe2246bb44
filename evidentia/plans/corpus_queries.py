"""Queries of groups I (ingest), C (chunking) and R (retrieval), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.config import Funnel
from evidentia.functions import text as X
from evidentia.functions.vector_index import build_index, index_topk, over_fetch
from evidentia.functions.vectors import cell_topk_many, matryoshka, recall_many, topk_many
from evidentia.operators import chunking, ingest, retrieval
from evidentia.operators import text_index as text_indexes
from evidentia.operators.windows import unit_windows
from evidentia.plans import sql as Q
from evidentia.sources.corpus import chunks, papers, query_vectors, table
from evidentia.sources.shared import shared_dir, written

QUERY = "evaluation of the thing that is here and with this oneed erin"
DEPTH = Funnel(k=100, n=20, c_wide=150, c_top=40)


def vector(spark: SparkSession, sf_dir: str, n: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == n).first()["embedding"]


def i_manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit("01."), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("id"),
        F.when(F.col("lang") == "en", "cs.CL cs.AI").otherwise("math.CO").alias("categories"),
        F.array(F.struct(F.lit("v1").alias("version")), F.struct(F.concat(F.lit("v"), (F.col("doc_id") % 3 + 2).cast("string")).alias("version"))).alias("versions"),
        F.lit("t").alias("title"), "source", F.lit(None).cast("string").alias("authors"), F.lit(None).cast("string").alias("doi"),
        F.lit(None).cast("string").alias("journal-ref"), F.lit("2020-01-01").alias("update_date"), F.lit("a").alias("abstract"), "doc_id",
    )
    files = docs.where("doc_id % 5 <> 0").select(ingest.markup_name().alias("name"))
    return ingest.build_manifest(docs, files).select("arxiv_id", "version", "tei_xml", F.size("categories").alias("n_categories"))


I_MANIFEST = """
SELECT id AS arxiv_id, v AS version, id || v || '.tei.xml' AS tei_xml, CAST(2 AS INT) AS n_categories FROM (
  SELECT lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || '01.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS id,
    'v' || (doc_id % 3 + 2) AS v, doc_id, lang FROM documents)
WHERE lang = 'en' AND doc_id % 5 <> 0 AND CAST(substr(id, 1, 2) AS INT) BETWEEN 15 AND 26
"""


def i_year_from_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("arxiv_id", ingest.year_from_id("arxiv_id").alias("year"))


I_YEAR = f"SELECT arxiv_id, CAST(2000 + CAST(substr(arxiv_id, 1, 2) AS INT) AS INT) AS year FROM (SELECT {Q.PAPER_ID} AS arxiv_id FROM documents)"


def i_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    current = orders.where("o_orderkey % 3 <> 0")
    batch = orders.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return ingest.upsert(current, batch, "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 2))


I_UPSERT = """
SELECT o_orderkey, o_custkey, round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0
"""


def i_resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chunks(spark, sf_dir, vectors=False).where("section_order = 1")
    return ingest.not_loaded(papers(spark, sf_dir).select("arxiv_id"), done, "arxiv_id")


I_RESUME = f"WITH {Q.LINES} SELECT {Q.PAPER_ID} AS arxiv_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE section_order = 1)"


def i_fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return ingest.foreign_key_violations(lines, parents, "l_orderkey")


I_FK = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)"


def i_download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    plan = ingest.download_plan(ids, ids.where("doc_id % 2 = 0"), ids.where("doc_id % 3 = 0"), "doc_id")
    return ingest.status_tally(plan, "action")


I_PLAN = """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'skip' WHEN doc_id % 2 = 0 THEN 'process' ELSE 'download' END AS action, count(*) AS n
FROM documents GROUP BY 1
"""


def c_explode_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, vectors=False).select("arxiv_id", "section_order", "section_type", "token_count", F.md5("chunk_text").alias("text_md5"))


C_EXPLODE = f"""WITH {Q.LINES}
SELECT arxiv_id, CAST(section_order AS INT) AS section_order, section_type, CAST(token_count AS INT) AS token_count, md5(chunk_text) AS text_md5 FROM chunks"""

HEADS = (
    "1. Introduction", "3.1 Method", "Experimental Results", "Acknowledgements", "  II. Related Work ", "4.2.1. Ablation Study:",
    "Section Conclusions and Future Work", "2 Datasets and training details", "", "chapter 7 Overview", "The Summary!",
)


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % len(HEADS) + 1).cast("int")), F.when(F.col("doc_id") % 2 == 0, F.lit("  Part")).otherwise("")).alias("head")
    )


_HEADS_SQL = f"""heads AS (
  SELECT doc_id, [{', '.join(repr(h) for h in HEADS)}][doc_id % {len(HEADS)} + 1] || CASE WHEN doc_id % 2 = 0 THEN '  Part' ELSE '' END AS head FROM documents
), normal AS (
  SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(head), '^\\d+(?:\\.\\d+)*\\.?\\s*', ''),
    '^(chapter|section)\\s+', ''), '\\s+', ' ', 'g'), ' '), '^[[:punct:] ]+|[[:punct:] ]+$', '', 'g') AS head FROM heads
)"""


def c_normalize_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("doc_id", X.normalize_head("head").alias("head"))


C_NORMALIZE = f"WITH {_HEADS_SQL} SELECT doc_id, head FROM normal"


def c_classify_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("doc_id", X.classify_section("head").alias("section_type"))


def _classify_sql() -> str:
    from evidentia.functions.lexicons import SECTION_KEYWORDS

    rows = ", ".join(f"({w!r}, {k!r}, {o})" for o, (k, ws) in enumerate(SECTION_KEYWORDS.items()) for w in ws.split("|"))
    return f"""WITH {_HEADS_SQL}, words(word, kind, ord) AS (VALUES {rows}), ranked AS (
      SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, ord) AS r
      FROM normal JOIN words ON contains(head, word) WHERE head <> '')
    SELECT n.doc_id, coalesce(r.kind, 'Other') AS section_type FROM normal n LEFT JOIN ranked r ON n.doc_id = r.doc_id AND r.r = 1"""


def c_chunk_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, vectors=False).select("arxiv_id", "section_order", "chunk_uuid")


C_UUID = f"WITH {Q.LINES} SELECT arxiv_id, CAST(section_order AS INT) AS section_order, chunk_uuid FROM chunks"


def c_section_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, vectors=False).groupBy("section_type").agg(
        F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("most")
    )


C_HISTOGRAM = f"""WITH {Q.LINES} SELECT section_type, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens,
  CAST(max(token_count) AS INT) AS most FROM chunks GROUP BY section_type"""


def c_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("arxiv_id"),
        F.array(F.struct(F.lit("Other").alias("section_type"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("paragraphs"))).alias("sections"),
    )
    return chunking.with_uuid(chunking.chunk_sections(docs, threshold=128))


def c_html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = chunking.extract_html(table(spark, sf_dir, "pages"))
    return chunking.typed_sections(raw, "page_id").select("page_id", F.posexplode("sections").alias("n", "s")).select(
        "page_id", "n", "s.section_type", F.size("s.paragraphs").alias("paragraphs")
    )


def r_shallow_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.shallow_match(papers(spark, sf_dir), vector(spark, sf_dir), 100).select("pos", "arxiv_id", F.round("sim", 6).alias("sim"))


_SHALLOW = f"""shallow AS (
  SELECT arxiv_id, list_cosine_similarity(abstract_embedding::DOUBLE[], {Q.query(0)}) AS sim FROM papers WHERE abstract_embedding IS NOT NULL
), near AS (
  SELECT arxiv_id, sim, row_number() OVER (ORDER BY sim DESC, arxiv_id) AS pos FROM shallow QUALIFY pos <= 100
)"""
R_SHALLOW = f"WITH {Q.PAPERS}, {_SHALLOW} SELECT CAST(pos AS INT) AS pos, arxiv_id, round(sim, 6) AS sim FROM near"


def r_rerank_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    near = retrieval.shallow_match(p, vector(spark, sf_dir), DEPTH.k)
    return retrieval.rerank_papers(p, near, QUERY, DEPTH.n).select("pos", "arxiv_id", F.round("score", 6).alias("score"))


R_RERANK = f"""WITH {Q.PAPERS}, {_SHALLOW}, scored AS (
  SELECT n.pos AS before, n.arxiv_id, {Q.overlap(QUERY, 'p.abstract')} AS score FROM near n JOIN papers p ON n.arxiv_id = p.arxiv_id
), kept AS (
  SELECT * FROM (SELECT arxiv_id, score, row_number() OVER (ORDER BY score DESC, before) AS pos FROM scored) WHERE pos <= 20
)"""
R_RERANK_PAPERS = R_RERANK + " SELECT CAST(pos AS INT) AS pos, arxiv_id, round(score, 6) AS score FROM kept"


def _deep(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, c, v = papers(spark, sf_dir), chunks(spark, sf_dir), vector(spark, sf_dir)
    kept = retrieval.rerank_papers(p, retrieval.shallow_match(p, v, DEPTH.k), QUERY, DEPTH.n)
    return c, retrieval.deep_match(c, kept, v, DEPTH.c_wide)


def r_deep_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir)[1].select("pos", "chunk_uuid", "arxiv_id", F.round("sim", 6).alias("sim"))


_DEEP = f"""{R_RERANK}, {Q.LINES}, wide AS (
  SELECT * FROM (SELECT chunk_uuid, arxiv_id, chunk_text, sim, row_number() OVER (ORDER BY sim DESC, chunk_uuid) AS before FROM (
    SELECT chunk_uuid, arxiv_id, chunk_text, list_cosine_similarity(chunk_embedding::DOUBLE[], {Q.query(0)}) AS sim
    FROM vector_chunks WHERE arxiv_id IN (SELECT arxiv_id FROM kept))) WHERE before <= 150
)"""
R_DEEP = _DEEP + " SELECT CAST(before AS INT) AS pos, chunk_uuid, arxiv_id, round(sim, 6) AS sim FROM wide"


def r_rerank_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, wide = _deep(spark, sf_dir)
    return retrieval.rerank_chunks(c, wide, QUERY, DEPTH.c_top).select("pos", "chunk_uuid", "arxiv_id", F.round("score", 6).alias("score"))


_BEST = f"""{_DEEP}, best AS (
  SELECT * FROM (SELECT chunk_uuid, arxiv_id, score, row_number() OVER (ORDER BY score DESC, before) AS pos FROM (
    SELECT chunk_uuid, arxiv_id, before, {Q.overlap(QUERY, 'chunk_text')} AS score FROM wide)) WHERE pos <= 40
)"""
R_RERANK_CHUNKS = _BEST + " SELECT CAST(pos AS INT) AS pos, chunk_uuid, arxiv_id, round(score, 6) AS score FROM best"


def r_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, meta = retrieval.funnel(papers(spark, sf_dir), chunks(spark, sf_dir), vector(spark, sf_dir), QUERY, DEPTH)
    return best.select("pos", "chunk_uuid", "arxiv_id", F.round("score", 6).alias("score")).join(
        F.broadcast(meta.select("arxiv_id", "title", "year")), "arxiv_id"
    )


R_FUNNEL = _BEST + """ SELECT CAST(pos AS INT) AS pos, chunk_uuid, b.arxiv_id, round(score, 6) AS score, title,
  CAST(2000 + CAST(substr(b.arxiv_id, 1, 2) AS INT) AS INT) AS year FROM best b JOIN papers p ON b.arxiv_id = p.arxiv_id"""


def r_fetch_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = papers(spark, sf_dir).where("doc_id % 20 = 0").select("arxiv_id")
    return retrieval.fetch_papers(papers(spark, sf_dir), ids).select("arxiv_id", "title", "source", "year", F.length("abstract").alias("chars"))


R_FETCH = f"""WITH {Q.PAPERS} SELECT arxiv_id, title, source, CAST(2000 + CAST(substr(arxiv_id, 1, 2) AS INT) AS INT) AS year,
  CAST(length(abstract) AS INT) AS chars FROM papers WHERE doc_id % 20 = 0"""


def r_fetch_paper_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fetch_paper_chunks(chunks(spark, sf_dir, vectors=False)).select("arxiv_id", "rank", "chunk_uuid", "section_type", "section_order")


R_PAPER_CHUNKS = f"""WITH {Q.LINES}, first AS (
  SELECT *, row_number() OVER (PARTITION BY arxiv_id, section_type ORDER BY section_order, chunk_uuid) AS sr FROM chunks
), second AS (
  SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY sr, section_order, chunk_uuid) AS rank FROM first
) SELECT arxiv_id, CAST(rank AS INT) AS rank, chunk_uuid, section_type, CAST(section_order AS INT) AS section_order FROM second WHERE rank <= 8"""


def r_lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir, vectors=False)
    asked = c.where("doc_id < 40 and section_order = 0").select(
        F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring("chunk_uuid", 1, 35), F.lit("z")))
        .when(F.col("doc_id") % 3 == 0, F.concat(F.lit("00000000"), F.substring("chunk_uuid", 9, 28)))
        .otherwise(F.concat(F.lit(" "), F.upper("chunk_uuid"))).alias("chunk_uuid"),
    )
    return retrieval.lookup_chunks(c, asked)


R_LOOKUP = f"""WITH {Q.LINES}, asked AS (
  SELECT doc_id AS pos, lower(trim(CASE WHEN doc_id % 5 = 0 THEN substr(chunk_uuid, 1, 35) || 'z'
    WHEN doc_id % 3 = 0 THEN '00000000' || substr(chunk_uuid, 9, 28) ELSE ' ' || upper(chunk_uuid) END, ' ')) AS chunk_uuid
  FROM chunks WHERE doc_id < 40 AND section_order = 0
) SELECT pos, a.chunk_uuid, CASE WHEN a.chunk_uuid LIKE '%z' THEN 'invalid' WHEN c.chunk_uuid IS NOT NULL THEN 'found' ELSE 'missing' END AS status
FROM asked a LEFT JOIN (SELECT DISTINCT chunk_uuid FROM chunks) c ON a.chunk_uuid = c.chunk_uuid"""


def r_ann_recall_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the exact ten that the cell index finds, for each query."""
    rows, queries = table(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir)
    return recall_many(cell_topk_many(rows, queries, 10, id_="vec_id"), topk_many(rows, queries, 10, id_="vec_id"), "vec_id")


def r_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against the exact search, at three depths, over the whole query set.

    ``reached`` says that 0.9 and more of the exact rows are found, and
    ``few_compared`` that less than a tenth of the vectors was compared.
    """
    rows, queries = table(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir)
    index = build_index(rows, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", id_="vec_id")
    depths = spark.createDataFrame([(1,), (5,), (10,)], "depth int")
    found = written(index_topk(spark, index, queries, 10, id_="vec_id"), "found")
    exact = written(topk_many(rows, queries, 10, id_="vec_id"), "exact")
    both = exact.withColumnRenamed("rank", "place").join(found.select("query_id", "vec_id", "rank"), ["query_id", "vec_id"], "left")
    hit = (F.col("place") <= F.col("depth")) & F.col("rank").isNotNull()
    compared = F.lit(over_fetch(index, 10) / max(1, index.rows))
    return both.join(depths, F.col("place") <= F.col("depth")).groupBy("depth").agg(
        F.count("*").alias("wanted"), (F.sum(hit.cast("int")) >= 0.9 * F.count("*")).alias("reached")
    ).withColumn("few_compared", compared < 0.1)


R_INDEX = """SELECT depth::INT AS depth, count(*) * least(depth, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL)) AS wanted,
  true AS reached, true AS few_compared
FROM embeddings, (SELECT unnest([1, 5, 10]) AS depth) WHERE vec_id % 20 = 0 AND embedding IS NOT NULL GROUP BY depth"""


def r_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_topk(papers(spark, sf_dir), QUERY, 50).select("pos", "arxiv_id", F.round("score", 6).alias("score"))


R_LEXICAL = f"""WITH {Q.PAPERS}, scored AS (SELECT arxiv_id, {Q.overlap(QUERY, 'abstract')} AS score FROM papers)
SELECT CAST(pos AS INT) AS pos, arxiv_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, arxiv_id) AS pos FROM scored WHERE score > 0) WHERE pos <= 50"""


def text_index(spark: SparkSession, sf_dir: str, positions: bool = True) -> text_indexes.TextIndex:
    """First lines, counted ten times, and whole texts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"), "text")
    return text_indexes.build_text_index(docs, f"{shared_dir(spark)}/words-{uuid.uuid4().hex}", {"title": 1.0, "text": 0.1}, positions=positions)


def c_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of lines of every document, by a table function."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unit_windows(docs, budget=200, overlap=40).select("doc_id", "nth", "first", "last", "start", "stop", "tokens")


C_WINDOWS = r"""WITH RECURSIVE split AS (
  SELECT doc_id, unnest(l) AS piece, unnest(generate_series(0, len(l) - 1)) AS nth
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), placed AS (
  SELECT *, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS n,
    coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM split
), units AS (
  SELECT doc_id, list(start ORDER BY nth) AS starts, list(start + length(piece) ORDER BY nth) AS stops, list(total ORDER BY nth) AS totals
  FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY nth) AS total FROM placed WHERE n > 0) GROUP BY doc_id
), w AS (
  SELECT doc_id, totals, 0 AS nth, 1 AS first, 1 AS new, greatest(1, len(list_filter(totals, lambda t: t <= 200))) AS last FROM units
  UNION ALL
  SELECT doc_id, totals, nth + 1, i, last + 1, greatest(last + 1, len(list_filter(totals, lambda t: t <= base + 200)))
  FROM (SELECT *, CASE WHEN i > 1 THEN totals[i - 1] ELSE 0 END AS base FROM (
    SELECT *, CASE WHEN totals[last + 1] - (CASE WHEN s > 1 THEN totals[s - 1] ELSE 0 END) <= 200 THEN s ELSE last + 1 END AS i FROM (
      SELECT *, greatest(first, len(list_filter(totals, lambda t: t < totals[last] - 40)) + CASE WHEN totals[last] <= 40 THEN 1 ELSE 2 END) AS s FROM w WHERE last < len(totals))))
)
SELECT w.doc_id, nth::INT AS nth, (first - 1)::INT AS first, (last - 1)::INT AS last, starts[first]::BIGINT AS start, stops[last]::BIGINT AS stop,
  (w.totals[last] - CASE WHEN first > 1 THEN w.totals[first - 1] ELSE 0 END)::BIGINT AS tokens
FROM w JOIN units u ON w.doc_id = u.doc_id"""


def r_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents by weighted words in any form, from the inverted index."""
    found = text_indexes.search(spark, text_index(spark, sf_dir, positions=False), WORDS, 100)
    return found.select("pos", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def r_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_indexes.phrase(spark, text_index(spark, sf_dir), PHRASE).select(F.col("id").alias("doc_id"), "times")


WORDS, PHRASE = "Evaluations of the thing, and whos with thises oneed: benchmarks", "of the"
_FORMS = """CASE WHEN length(w) < 4 THEN w
    WHEN w LIKE '%ies' AND NOT (w LIKE '%eies' OR w LIKE '%aies') THEN left(w, length(w) - 3) || 'y'
    WHEN w LIKE '%es' AND NOT (w LIKE '%aes' OR w LIKE '%ees' OR w LIKE '%oes') THEN left(w, length(w) - 1)
    WHEN w LIKE '%s' AND NOT (w LIKE '%us' OR w LIKE '%ss') THEN left(w, length(w) - 1) ELSE w END"""


def _fields(field: str, weight: float) -> str:
    norm = f"trim(regexp_replace(lower(coalesce({field}, '')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"SELECT doc_id, {weight} AS weight, list_filter(string_split({norm}, ' '), lambda w: w <> '') AS ws FROM documents"


_TERMS = f"""fields AS ({_fields("string_split(text, chr(10))[1]", 1.0)} UNION ALL {_fields("text", 0.1)}
), terms AS (
  SELECT doc_id, weight, place, {_FORMS} AS term
  FROM (SELECT doc_id, weight, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS place FROM fields)
)"""
R_RANKED = f"""WITH {_TERMS}, asked AS (
  SELECT DISTINCT {_FORMS} AS term FROM (SELECT unnest(string_split(trim(regexp_replace(lower('{WORDS}'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ')) AS w)
), lengths AS (
  SELECT doc_id, sum(len(ws)) AS n FROM fields GROUP BY doc_id
), tf AS (
  SELECT doc_id, term, sum(weight)::DOUBLE AS w FROM terms JOIN asked USING (term) GROUP BY doc_id, term
), df AS (
  SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term
), scored AS (
  SELECT doc_id, round(sum(idf * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM lengths)))), 9) AS score
  FROM tf JOIN df USING (term) JOIN lengths USING (doc_id) GROUP BY doc_id
)
SELECT CAST(pos AS INT) AS pos, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM scored) WHERE pos <= 100"""
R_PHRASES = f"""WITH {_TERMS}
SELECT a.doc_id, CAST(count(*) AS INT) AS times FROM terms a JOIN terms b
  ON a.doc_id = b.doc_id AND a.weight = b.weight AND b.place = a.place + 1 AND a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id"""


def r_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one common word, by how often they have it."""
    return retrieval.phrase_match(papers(spark, sf_dir), "the", 40).select("pos", "arxiv_id", "times")


R_PHRASE = f"""WITH {Q.PAPERS}, b AS (SELECT arxiv_id, ' ' || trim(regexp_replace(lower(coalesce(abstract, '')), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' AS t FROM papers), c AS (
  SELECT arxiv_id, CAST(floor((length(t) - length(replace(t, ' the ', '  '))) / 3) AS INT) AS times FROM b)
SELECT CAST(pos AS INT) AS pos, arxiv_id, times FROM (SELECT *, row_number() OVER (ORDER BY times DESC, arxiv_id) AS pos FROM c WHERE times > 0) WHERE pos <= 40"""


def r_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    dense = retrieval.shallow_match(p, vector(spark, sf_dir), 100).select(F.lit(0).alias("list"), F.col("pos").alias("rank"), F.col("arxiv_id").alias("doc_id"))
    words = retrieval.lexical_topk(p, QUERY, 50).select(F.lit(1).alias("list"), F.col("pos").alias("rank"), F.col("arxiv_id").alias("doc_id"))
    return retrieval.rrf(dense.unionByName(words)).select("rank", "doc_id", F.round("score", 8).alias("score"))


R_RRF = f"""WITH {Q.PAPERS}, {_SHALLOW}, scored AS (SELECT arxiv_id, {Q.overlap(QUERY, 'abstract')} AS score FROM papers), lexical AS (
  SELECT arxiv_id, row_number() OVER (ORDER BY score DESC, arxiv_id) AS pos FROM scored WHERE score > 0
), ranked AS (
  SELECT 0 AS list, pos AS rank, arxiv_id AS doc_id FROM near UNION ALL SELECT 1, pos, arxiv_id FROM lexical WHERE pos <= 50
), fused AS (
  SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 100000 + rank) AS first FROM ranked GROUP BY doc_id
) SELECT CAST(row_number() OVER (ORDER BY score DESC, first) AS INT) AS rank, doc_id, round(score, 8) AS score FROM fused"""


def r_capacity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir, vectors=False).withColumn("n", F.col("doc_id") % 3)
    return retrieval.capacity(c, ["n"], 400).withColumn("median", F.round("median", 3))


R_CAPACITY = f"""WITH {Q.LINES}, per AS (
  SELECT doc_id % 3 AS n, arxiv_id, count(*) AS k, sum(length(chunk_text)) AS chars FROM chunks GROUP BY 1, 2
) SELECT n, min(k) AS least, round(median(k)::DOUBLE, 3) AS median, greatest(0, 400 - count(*))::BIGINT AS starved, CAST(sum(chars) AS BIGINT) AS chars
FROM per GROUP BY n"""


def r_matryoshka(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", matryoshka(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


R_MATRYOSHKA = """WITH base AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, list_sum(embedding::DOUBLE[]) / len(embedding) AS m FROM embeddings
), spread AS (
  SELECT vec_id, v, m, list_sum([(x - m) * (x - m) for x in v]) / len(v) AS var FROM base
), head AS (SELECT vec_id, [(x - m) / sqrt(var + 1e-5) for x in v[1:16]] AS h FROM spread
), unit AS (SELECT vec_id, h, greatest(sqrt(list_sum([x * x for x in h])), 1e-12) AS n FROM head)
SELECT vec_id, CAST(i - 1 AS INT) AS i, round(h[i] / n, 5) AS x FROM (SELECT vec_id, h, n, unnest(generate_series(1, 16)) AS i FROM unit)"""


def r_many_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = topk_many(rows, query_vectors(spark, sf_dir), 10, id_="vec_id")
    return found.select("query_id", "rank", "vec_id", F.round("sim", 6).alias("sim"))


R_MANY = """WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0
) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(sim, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def i_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return retrieval.sample_by_hash(rows, "doc_id", 7, 40)


I_SAMPLE = "SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id LIMIT 40"

QUERIES = {
    "i_manifest_filter": (i_manifest_filter, I_MANIFEST), "i_year_from_id": (i_year_from_id, I_YEAR), "i_upsert_latest": (i_upsert_latest, I_UPSERT),
    "i_resume_antijoin": (i_resume_antijoin, I_RESUME), "i_fk_check": (i_fk_check, I_FK), "i_download_plan": (i_download_plan, I_PLAN),
    "i_sample": (i_sample, I_SAMPLE),
    "c_explode_paragraphs": (c_explode_paragraphs, C_EXPLODE), "c_normalize_head": (c_normalize_head, C_NORMALIZE),
    "c_classify_section": (c_classify_section, _classify_sql()), "c_chunk_uuid5": (c_chunk_uuid5, C_UUID),
    "c_section_histogram": (c_section_histogram, C_HISTOGRAM), "c_packer": (c_packer, None), "c_html_sections": (c_html_sections, None),
    "r_shallow_topk": (r_shallow_topk, R_SHALLOW), "r_rerank_papers": (r_rerank_papers, R_RERANK_PAPERS), "r_deep_match": (r_deep_match, R_DEEP),
    "r_rerank_chunks": (r_rerank_chunks, R_RERANK_CHUNKS), "r_funnel": (r_funnel, R_FUNNEL), "r_fetch_papers": (r_fetch_papers, R_FETCH),
    "r_fetch_paper_chunks": (r_fetch_paper_chunks, R_PAPER_CHUNKS), "r_lookup_missing": (r_lookup_missing, R_LOOKUP),
    "r_ann_recall_lsh": (r_ann_recall_lsh, None), "r_index_recall": (r_index_recall, R_INDEX), "c_line_windows": (c_line_windows, C_WINDOWS), "r_ranked_search": (r_ranked_search, R_RANKED), "r_phrase_search": (r_phrase_search, R_PHRASES), "r_lexical_topk": (r_lexical_topk, R_LEXICAL), "r_phrase_match": (r_phrase_match, R_PHRASE), "r_rrf": (r_rrf, R_RRF),
    "r_capacity_summary": (r_capacity_summary, R_CAPACITY), "r_matryoshka": (r_matryoshka, R_MATRYOSHKA), "r_many_topk": (r_many_topk, R_MANY),
}
