"""Group V: verification of answers that are made of the corpus's own chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import claims as V
from evidentia.operators.eventlog import evidence_cap
from evidentia.plans import sql as Q
from evidentia.sources.corpus import chunks


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer for each document, over the first of its chunks: right, cut, invented
    and abbreviated ids by turns."""
    c = chunks(spark, sf_dir, vectors=False, first=True)
    fake = F.concat(F.substring("chunk_uuid", 1, 8), F.lit("-0000-5000-8000-000000000000"))
    cited = F.when(F.col("doc_id") % 4 == 1, fake).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("["), F.substring("chunk_uuid", 1, 8), F.lit("]"))).when(
        F.col("doc_id") % 4 == 3, F.concat(F.lit("99999999"), F.substring("chunk_uuid", 9, 28))
    ).otherwise(F.col("chunk_uuid"))
    text = F.concat(F.lit("The finding is stated here. It rests on "), cited, F.lit(" and on "), F.col("arxiv_id"), F.lit("v2, as in "), F.col("arxiv_id"), F.lit(" before. Also 0101.00001 says so."))
    return c.select("doc_id", "chunk_uuid", "arxiv_id", "chunk_text", text.alias("answer"))


_ANSWERS = f"""{Q.LINES}, first AS (SELECT * FROM chunks QUALIFY section_order = min(section_order) OVER (PARTITION BY doc_id)), answers AS (
  SELECT doc_id, chunk_uuid, arxiv_id, chunk_text, CASE doc_id % 4 WHEN 0 THEN chunk_uuid WHEN 1 THEN substr(chunk_uuid, 1, 8) || '-0000-5000-8000-000000000000'
    WHEN 3 THEN '99999999' || substr(chunk_uuid, 9, 28) END AS token FROM first)"""


def v_cited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", F.array_join(X.cited_ids("answer"), " ").alias("ids"))


V_CITED = f"WITH {_ANSWERS} SELECT doc_id, coalesce(token || ' ', '') || arxiv_id || ' 0101.00001' AS ids FROM answers"
# The mapping's paper ids begin with the year 15 or later, so 0101.00001 is no one's.


def v_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    known = a.select(F.col("chunk_uuid").alias("id"), F.col("arxiv_id").alias("paper"))
    return V.resolve_citations(a, known, "doc_id", "answer")


V_RESOLVE = f"""WITH {_ANSWERS}, cited AS (
  SELECT doc_id, token FROM answers WHERE token IS NOT NULL UNION ALL SELECT doc_id, arxiv_id FROM answers UNION ALL SELECT doc_id, '0101.00001' FROM answers
), prefix AS (SELECT substr(chunk_uuid, 1, 8) AS p, count(*) AS n, min(chunk_uuid) AS only_ FROM (SELECT DISTINCT chunk_uuid FROM answers) GROUP BY 1)
SELECT doc_id, token, CASE WHEN length(token) < 36 THEN CASE WHEN token <> '0101.00001' THEN token END WHEN k.chunk_uuid IS NOT NULL THEN k.chunk_uuid WHEN n = 1 THEN only_ END AS id,
  CASE WHEN length(token) < 36 THEN CASE WHEN token <> '0101.00001' THEN 'resolved' ELSE 'unresolved' END WHEN k.chunk_uuid IS NOT NULL THEN 'resolved' WHEN n = 1 THEN 'merged'
    ELSE 'unresolved' END AS status
FROM cited LEFT JOIN (SELECT DISTINCT chunk_uuid FROM answers) k ON token = k.chunk_uuid LEFT JOIN prefix ON length(token) = 36 AND substr(token, 1, 8) = p"""


def v_short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    tokens = a.select(F.explode(V.short_tokens("answer")).alias("token"))
    return V.expand_short_ids(tokens, a.select(F.col("chunk_uuid").alias("id")))


V_SHORT = f"""WITH {_ANSWERS}, tokens AS (SELECT DISTINCT substr(chunk_uuid, 1, 8) AS token FROM answers WHERE doc_id % 4 = 2), hits AS (
  SELECT token, count(*) AS n, min(chunk_uuid) AS id FROM tokens JOIN (SELECT DISTINCT chunk_uuid FROM answers) ON starts_with(chunk_uuid, token) GROUP BY token)
SELECT token, CASE WHEN n = 1 THEN id END AS id FROM hits WHERE regexp_matches(token, '[0-9]') AND regexp_matches(token, '[a-f]')"""


def v_claim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = V.explode_units(answers(spark, sf_dir), "doc_id", "answer", include_uncited=True)
    return units.withColumn("ids", F.array_join("ids", " "))


V_UNITS = f"""WITH {_ANSWERS}, u AS (SELECT *, CASE doc_id % 4 WHEN 2 THEN '[' || substr(chunk_uuid, 1, 8) || ']' ELSE token END AS said FROM answers)
SELECT doc_id, 0 AS unit_index, 'It rests on ' || said || ' and on ' || arxiv_id || 'v2, as in ' || arxiv_id || ' before.' AS text, CASE WHEN token IS NULL THEN arxiv_id ELSE token || ' ' || arxiv_id END AS ids FROM u
UNION ALL SELECT doc_id, 1, 'Also 0101.00001 says so.', '0101.00001' FROM u"""


def frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames of every kind over made-up chunks, one set for each document."""
    d = F.col("doc_id")
    base = answers(spark, sf_dir).select("doc_id")
    number = (d % 50).cast("string")
    text = F.concat(F.lit("In tests Alpha Net "), F.when(d % 2 == 0, "outperforms").otherwise("is worse than"), F.lit(" Beta Net by "), number, F.lit(".5 points on Gamma Bench."))
    texts = base.select(F.concat(F.lit("k"), d).alias("chunk_uuid"), text.alias("chunk_text"))
    kinds = F.array(*[
        F.struct(F.lit(i).alias("unit_index"), F.lit(p).alias("predicate"), F.lit(s).alias("subject"), F.lit(o).alias("object"), F.lit(b).alias("benchmark"), F.lit(r).alias("direction"))
        for i, (p, s, o, b, r) in enumerate((
            ("measures", "Alpha Net", "", "gamma bench", ""), ("measures", "Alpha Net", "", "delta", ""), ("compares", "Alpha Net", "Beta Net", "", ">"),
            ("compares", "Beta Net", "Alpha Net", "", ""), ("reports", "alpha net", "points on the Gamma bench", "", ""), ("uses", "Omega", "x", "", ""), ("other", "Alpha Net", "", "", ""),
        ))
    ])
    rows = base.select("doc_id", F.explode(kinds).alias("f")).select(
        "doc_id", "f.*", F.when(d % 5 == 0, F.concat(((d + 1) % 50).cast("string"), F.lit(".5"))).otherwise(F.concat(number, F.lit(".5"))).alias("value"),
        F.lit(None).cast("string").alias("metric"),
        F.when(d % 7 == 0, F.lit("words that are not there")).otherwise(F.concat(F.lit("Alpha Net "), F.when(d % 2 == 0, "outperforms").otherwise("is worse than"), F.lit(" Beta Net by "), number, F.lit(".5 points on Gamma Bench"))).alias("quote"),
        F.concat(F.lit("k"), d).alias("chunk_id"),
    )
    return rows, texts


def v_frame_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = frames(spark, sf_dir)
    return V.verify_frames(rows, texts).select("doc_id", "unit_index", "predicate", "status")


_VERDICT = """verdicts AS (SELECT doc_id, CAST(i AS INT) AS unit_index, p AS predicate, CASE WHEN doc_id % 7 = 0 THEN 'unverifiable'
  WHEN i IN (0, 1) AND doc_id % 5 = 0 THEN 'contradicted' WHEN i = 0 THEN 'grounded' WHEN i = 1 THEN 'unverifiable'
  WHEN i = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'grounded' ELSE 'contradicted' END WHEN i = 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'contradicted' ELSE 'grounded' END
  WHEN i = 4 THEN 'grounded' ELSE 'unverifiable' END AS status
  FROM first, (VALUES (0, 'measures'), (1, 'measures'), (2, 'compares'), (3, 'compares'), (4, 'reports'), (5, 'uses'), (6, 'other')) k(i, p))"""
V_FRAMES = f"WITH {_ANSWERS}, {_VERDICT} SELECT doc_id, unit_index, predicate, status FROM verdicts"


def v_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = frames(spark, sf_dir)
    units = rows.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("unit_index"))
    done = V.verify_frames(rows, texts).where(F.col("doc_id") % 3 != 0)
    return V.coverage(done, units, "doc_id").withColumn("coverage", F.round("coverage", 4))


V_COVERAGE = f"""WITH {_ANSWERS}, {_VERDICT}, per AS (
  SELECT doc_id, count(DISTINCT unit_index) AS covered, count(*) AS frames, count(*) FILTER (status = 'grounded') AS grounded,
    count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (status = 'unverifiable') AS unverifiable FROM verdicts WHERE doc_id % 3 <> 0 GROUP BY doc_id)
SELECT f.doc_id, 10::BIGINT AS units, coalesce(covered, 0) AS covered, coalesce(frames, 0) AS frames, coalesce(grounded, 0) AS grounded, coalesce(contradicted, 0) AS contradicted,
  coalesce(unverifiable, 0) AS unverifiable, round(coalesce(covered, 0) / 10::DOUBLE, 4) AS coverage FROM first f LEFT JOIN per ON f.doc_id = per.doc_id"""


def v_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes in an answer, held by the text or not: whole, elided, changed, cut."""
    n = F.col("doc_id") % 90 + 10
    raw = F.concat(F.lit("The system reaches a score of "), n, F.lit(".6 on every test that we have run so far"))
    said = F.when(F.col("doc_id") % 4 == 0, "reaches a score of on every test that we").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("The system reaches a score of "), n)).when(
        F.col("doc_id") % 4 == 2, "The system reaches a … test that we have run"
    ).otherwise(F.concat(F.lit("a score of "), n, F.lit(".6 on every test")))
    rows = answers(spark, sf_dir).select("doc_id", raw.alias("raw"), F.explode(X.quoted_spans(F.concat(F.lit('It says "'), said, F.lit('" there.')))).alias("span"))
    segments = V.quote_segments(F.col("span"))
    return rows.select("doc_id", "span", F.size(segments).alias("segments"), V.quote_holds(segments, F.col("raw")).alias("held"))


V_QUOTES = f"""WITH {_ANSWERS} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'reaches a score of on every test that we' WHEN 1 THEN 'The system reaches a score of ' || (doc_id % 90 + 10)
  WHEN 2 THEN 'The system reaches a … test that we have run' ELSE 'a score of ' || (doc_id % 90 + 10) || '.6 on every test' END AS span,
  CAST(CASE doc_id % 4 WHEN 2 THEN 2 ELSE 1 END AS INT) AS segments, doc_id % 4 IN (2, 3) AS held FROM answers"""


def v_evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir, vectors=False).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_order", "chunk_text"))).alias("c"))
    kept = evidence_cap(F.transform("c", lambda x: x["chunk_text"]), 200, 1000)
    return c.select("doc_id", F.size(kept).alias("chunks"), F.aggregate(kept, F.lit(0), lambda s, x: s + F.length(x)).alias("chars"))


V_EVIDENCE = f"""WITH {Q.LINES}, cut AS (SELECT doc_id, section_order, least(200, length(chunk_text)) AS n FROM chunks), run AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY section_order) - n AS before FROM cut)
SELECT doc_id, CAST(count(*) AS INT) AS chunks, CAST(least(1000, sum(n)) AS INT) AS chars FROM run WHERE before < 1000 GROUP BY doc_id"""

QUERIES = {
    "v_cited_ids": (v_cited_ids, V_CITED), "v_resolve": (v_resolve, V_RESOLVE), "v_short_ids": (v_short_ids, V_SHORT), "v_claim_units": (v_claim_units, V_UNITS),
    "v_frame_verdicts": (v_frame_verdicts, V_FRAMES), "v_coverage": (v_coverage, V_COVERAGE), "v_quotes": (v_quotes, V_QUOTES), "v_evidence_cap": (v_evidence_cap, V_EVIDENCE),
}
