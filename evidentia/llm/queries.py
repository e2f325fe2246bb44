"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.bpe import bpe_encode
from evidentia.llm.byte_bpe import byte_bpe_decode, byte_bpe_encode
from evidentia.llm.common import bounded, shared_dir
from evidentia.llm.decontaminate import contaminated
from evidentia.llm.fingerprint import fingerprint_edits
from evidentia.llm.hard_negatives import hard_negatives
from evidentia.llm.prefix_trie import conversation_trie
from evidentia.llm.quality import fit_quality, held_out, score_quality
from evidentia.llm.simhash import simhash_components
from evidentia.llm.substring_dedup import substring_dedup
from evidentia.llm.suffix_dedup import suffix_dedup
from evidentia.llm.token_counts import token_counts
from evidentia.llm.token_files import encode_sorted, token_positions, write_tokens
from evidentia.llm.url_filter import url_filter

Query = Callable[[SparkSession, str], DataFrame]


def word_bpe() -> str:
    """Path of the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=4, most=4)


#: Rules of the URL query: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


OP2_SQL = """
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM pages
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/')
      THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/')
      THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM cut
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def example_edits() -> Column:
    """Three edits of every document: words are repeated in its middle, a space
    and what stands around it goes, and its last tenth is cut off."""

    def edit(start: str, stop: str, text: str) -> Column:
        return F.expr(f"struct(cast({start} as int) as start, cast({stop} as int) as stop, {text} as text)")

    n = "length(coalesce(text, ''))"
    return F.array(
        edit(f"{n} div 2", f"{n} div 2", "substring(coalesce(text, ''), 1, 30)"),
        edit(f"{n} div 3", f"{n} div 3 + 2", "''"),
        edit(f"{n} - {n} div 10", "2147483647", "cast(null as string)"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("edits", example_edits())
    return token_counts(docs, word_bpe(), edits="edits")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(table(spark, sf_dir, "documents"), word_bpe(), decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)
), marked AS (
  SELECT s.doc_id, s.i FROM starts s JOIN (SELECT win, min(doc_id) AS m FROM starts GROUP BY win) f
    ON s.win = f.win WHERE f.m < s.doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM marked, (SELECT unnest(generate_series(0, 12)) AS k) ks
), places AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM words WHERE len(w) > 0
), kept AS (
  SELECT pl.doc_id, string_agg(pl.word, ' ' ORDER BY pl.p) AS t, count(*) AS n
  FROM places pl LEFT JOIN gone g ON pl.doc_id = g.doc_id AND pl.p = g.p WHERE g.p IS NULL GROUP BY pl.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), window=50)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(encode_sorted(table(spark, sf_dir, "documents"), word_bpe(), end_id=1), path)
    return token_positions(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), anchors=F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND s.label <> s.anchor_label
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(
        table(spark, sf_dir, "conversations"),
        base=F.expr("conv - conv % 20"), head=F.expr("crc32(cast(conv AS string)) % 4"),
    )


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(concat(length(coalesce(role, '')), ':', role, text))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT c, s, 1 AS i, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)
  UNION ALL
  SELECT c, s, i + 1, (
    WITH RECURSIVE step(k, v) AS (
      SELECT 0, xor(crc, CAST(ascii(substr(s, i, 1)) AS BIGINT))
      UNION ALL
      SELECT k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END FROM step WHERE k < 8
    ) SELECT v FROM step WHERE k = 8
  ) FROM bits WHERE i <= length(s)
), heads AS (
  SELECT c, c - c % 20 AS base, xor(crc, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits WHERE i = length(s) + 1
), joined AS (
  SELECT heads.c, 0 AS part, pos, role, text FROM heads JOIN t ON t.c = heads.base AND pos <= h
  UNION ALL
  SELECT heads.c, 1, pos, role, text FROM heads JOIN t ON t.c = heads.c AND pos > h
), turns AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM joined
), ways AS (
  SELECT c, d, text, string_agg(sha256(concat(length(role), ':', role, text)), '/') OVER (PARTITION BY c ORDER BY d) AS way FROM turns
), all_ways AS (
  SELECT c, d, text, way FROM ways UNION ALL SELECT c, 0, '', '' FROM heads
), lengths AS (
  SELECT c, max(d) AS n FROM all_ways GROUP BY c
), nodes AS (
  SELECT way, d, min(a.c) AS c, count(*) AS n, string_agg(CAST(a.c AS VARCHAR), ',' ORDER BY a.c) FILTER (WHERE l.n = d) AS ends,
    (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saves
  FROM all_ways a JOIN lengths l ON a.c = l.c GROUP BY way, d
), linked AS (
  SELECT n.*, p.c AS parent, p.way AS above FROM nodes n LEFT JOIN nodes p
    ON p.d = n.d - 1 AND p.way = CASE WHEN n.d > 1 THEN left(n.way, length(n.way) - 65) ELSE '' END
), children AS (
  SELECT above, d - 1 AS d, count(*) AS k FROM linked WHERE d > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(k, 0) AS k FROM linked l LEFT JOIN children ch ON ch.above = l.way AND ch.d = l.d
)
SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, a.parent AS parent_conv_id, a.n AS n_convs, CAST(a.k AS BIGINT) AS n_children,
  count(*) FILTER (WHERE b.k = 0) AS n_leaves, CAST(sum(b.saves) AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM counted a JOIN counted b ON b.d >= a.d AND starts_with(b.way, a.way)
GROUP BY ALL
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = byte_bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    out = byte_bpe_decode(docs.select("doc_id", "ids"), path, pattern, packed="packed")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Query]:
    every = (
        op1_simhash, op2_url_filter, op3_decontaminate, op4_token_counts, op5_bpe, op6_substring_dedup, op7_suffix_dedup,
        op8_quality, op9_fingerprint, op10_token_files, op11_hard_negatives, op12_prefix_trie,
        op13_byte_bpe,
    )
    return {query.__name__: bounded(query) for query in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": OP2_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
    }
