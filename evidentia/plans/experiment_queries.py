"""Plans, forks, regrades and reports, over the orders, the log and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import experiments as P
from evidentia.plans import sql as Q
from evidentia.plans.run_queries import _FRAMES, _LINES, _ledgers, _text, lines
from evidentia.sources.corpus import chunks, papers, table


def a_scope_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules over made-up citations of every part."""
    k = F.col("p_partkey")
    ids = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(_text("21", F.lpad(k % 12 + 1, 2, "0"), ".00001"), _text(F.when(k % 3 == 0, "14").otherwise("22"), "01.00002")))
    units = F.array(F.struct(F.lit("a").alias("text"), ids.alias("ids")))
    allowed = F.array(_text("21", F.lpad(k % 12 + 1, 2, "0"), ".00001"), F.lit("2201.00002"))
    rule = F.explode(F.array(*[F.lit(r) for r in ("papers", "years", "cited", "other")]))
    rows = table(spark, sf_dir, "part").select("p_partkey", ids.alias("ids"), units.alias("units"), allowed.alias("allowed")).withColumn("rule", rule)
    return rows.select("p_partkey", "rule", P.scope_verdict(F.col("rule"), F.col("allowed"), F.col("ids"), F.col("units"), F.lit(2015), F.lit(2026)).alias("verdict"))


A_SCOPE = """SELECT p_partkey, rule, CASE WHEN rule = 'other' THEN 'human' WHEN rule = 'cited' THEN CASE WHEN p_partkey % 7 = 0 THEN 'fail' ELSE 'pass' END
  WHEN p_partkey % 7 = 0 THEN 'human' WHEN p_partkey % 3 = 0 THEN 'fail' ELSE 'pass' END AS verdict FROM part, (SELECT unnest(['papers', 'years', 'cited', 'other']) AS rule)"""


def e_regraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("run_id"), F.col("line_no").alias("seq"), F.when(F.col("l_partkey") % 3 != 0, "final").otherwise("plan").alias("stage"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit(None).cast("string")).when(F.col("l_suppkey") % 2 == 0, "pass").otherwise("fail").alias("verdict"), F.col("l_discount").alias("confidence"),
    )
    scores = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 10 / 10).alias("score"))
    return P.regraded(events, scores)


E_REGRADED = f"""WITH {_LINES}, o AS (SELECT l_orderkey AS run_id, arg_max(CASE WHEN l_suppkey % 2 = 0 THEN 'pass' ELSE 'fail' END, line_no) FILTER (l_partkey % 3 <> 0 AND l_suppkey % 4 <> 0) AS old_verdict,
  arg_max(l_discount, line_no) FILTER (l_partkey % 3 <> 0 AND l_suppkey % 4 <> 0) AS old_score FROM li GROUP BY l_orderkey), n AS (
  SELECT o_orderkey AS run_id, o_custkey % 10 / 10 AS score, CASE WHEN o_custkey % 10 < 5 THEN 'pass' ELSE 'fail' END AS new_verdict FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o.run_id, old_verdict, old_score, score, new_verdict, coalesce(old_verdict <> new_verdict, false) AS turned FROM o JOIN n ON o.run_id = n.run_id"""


def l_fork_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("query"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost_usd"), F.col("o_custkey").alias("unknown")
    )
    forks = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(
        F.col("o_orderkey").alias("parent_run_id"), _text("child", F.col("o_orderkey")).alias("run_id"), F.when(F.col("o_orderkey") % 20 == 0, "other query").alias("query")
    )
    return P.fork_runs(runs, forks)


L_FORK = """SELECT o_orderkey AS parent_run_id, 'child' || o_orderkey AS run_id, CASE WHEN o_orderkey % 20 = 0 THEN 'other query' ELSE o_orderpriority END AS query, 'running' AS status,
  0.0::DOUBLE AS cost_usd, o_custkey AS unknown FROM orders WHERE o_orderkey % 10 = 0"""


def e_wave_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("place"), F.col("n_name").alias("cell"), F.lit(2).alias("arms"), (F.col("n_regionkey") + 1).alias("queries"), F.lit(10).alias("repeats")
    )
    recorded = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("cell"), (F.col("s_suppkey") * 0.5).alias("cost"))
    first, last = (table(spark, sf_dir, "nation").where(F.col("n_nationkey") == k).first()["n_name"] for k in (3, 20))
    return P.wave_cells(cells, recorded, first, last)


E_CELLS = """WITH r AS (SELECT s_nationkey AS k, count(*) AS runs, sum(s_suppkey * 0.5::DOUBLE) AS cost FROM supplier GROUP BY 1)
SELECT n_nationkey AS place, n_name AS cell, 2 AS arms, n_regionkey + 1 AS queries, 10 AS repeats, 2 * (n_regionkey + 1) * 10 AS expected, coalesce(runs, 0) AS runs, coalesce(cost, 0) AS cost,
  coalesce(runs, 0) >= 2 * (n_regionkey + 1) * 10 AS complete FROM nation LEFT JOIN r ON n_nationkey = k WHERE n_nationkey BETWEEN 3 AND 20"""


def a_accepted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = lines(spark, sf_dir).select(F.col("l_orderkey").alias("task"), F.col("line_no").alias("place"), (F.col("l_partkey") % 5).alias("id"), "l_suppkey")
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.explode(F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("id"))
    kept, missing = P.accepted_records(records, wanted)
    return kept.select("task", "id", "l_suppkey").unionByName(missing.withColumn("l_suppkey", F.lit(None).cast("long")))


A_RECORDS = f"""WITH {_LINES}, k AS (SELECT l_orderkey AS task, l_partkey % 5 AS id, arg_min(l_suppkey, line_no) AS l_suppkey FROM li GROUP BY 1, 2)
SELECT o_orderkey AS task, w.id, l_suppkey FROM orders CROSS JOIN (SELECT unnest([1, 3]) AS id) w LEFT JOIN k ON k.task = o_orderkey AND k.id = w.id"""


def a_unit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order in batches of two, the second batch halved."""
    items = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line_no")).alias("items"))
    made = items.select("l_orderkey", F.posexplode(P.batches(F.col("items"), 2, F.array(F.lit(1)))).alias("batch", "b"))
    return made.select("l_orderkey", "batch", F.array_join(F.transform("b", lambda x: x.cast("string")), " ").alias("items"))


A_BATCHES = f"""WITH {_LINES}, b AS (SELECT l_orderkey, line_no, CASE WHEN line_no <= 2 THEN 0 WHEN line_no = 3 THEN 1 WHEN line_no = 4 THEN 2 ELSE (line_no - 1) // 2 + 1 END AS batch FROM li)
SELECT l_orderkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY batch) - 1 AS INT) AS batch, string_agg(line_no, ' ' ORDER BY line_no) AS items FROM b GROUP BY l_orderkey, batch"""


def v_frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frame_rows(_ledgers(spark, sf_dir)).select("run_id", "number", "unit_index", "quote", "chunk_id", "status")


V_FRAME_ROWS = f"WITH {_FRAMES} SELECT run_id, CAST(frame_index - 1 AS INT) AS number, CAST(unit_index AS INT) AS unit_index, quote, chunk_id, status FROM frames"


def v_evidence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.evidence_set(chunks(spark, sf_dir, vectors=False).withColumn("set_id", F.col("section_type")), F.col("token_count"))


V_SET = f"WITH {Q.LINES} SELECT section_type AS set_id, count(*) AS chunks, CAST(sum(token_count + 8) AS BIGINT) AS tokens FROM chunks GROUP BY section_type"


def v_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("note", F.concat(F.lit("a|b\n"), F.col("n_name")))
    return P.markdown_table(rows, "n_regionkey", "n_nationkey", ("n_nationkey", "note"), _text("Region ", F.col("n_regionkey")))


V_MARKDOWN = """SELECT n_regionkey, '# Region ' || n_regionkey || chr(10) || chr(10) || '| n_nationkey | note |' || chr(10) || '|-|-|' || chr(10) ||
  string_agg('| ' || n_nationkey || ' | a\\|b ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation GROUP BY n_regionkey"""


def i_pending_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("id"))
    return P.pending_targets(failed, table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("id")))


I_PENDING = "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity < 3 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)"


def r_short_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.short_fields(papers(spark, sf_dir)).select("arxiv_id", "title", F.sha2("abstract", 256).alias("abstract"))


R_SHORT = f"""WITH {Q.PAPERS} SELECT arxiv_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'), ' ') AS title,
  sha256(substr(trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g'), ' '), 1, 900)) AS abstract FROM papers"""


def i_head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.head_sample(chunks(spark, sf_dir, vectors=False), 12).select("arxiv_id", "chunk_uuid")


I_HEAD = f"WITH {Q.LINES} SELECT arxiv_id, chunk_uuid FROM chunks WHERE arxiv_id IN (SELECT DISTINCT arxiv_id FROM chunks ORDER BY arxiv_id LIMIT 12)"


def e_scored_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") % 2).cast("int")).alias("truth"))
    scores = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(
        F.col("p_partkey").alias("pair_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") / 50).alias("claim"), F.lit(0.5).alias("aggregate")
    )
    return P.scored_worksheet(labels, scores, labels.where("pair_id % 3 = 0").select("pair_id"))


E_WORKSHEET = """WITH l AS (SELECT p_partkey AS pair_id, 'pair' AS kind, CAST(p_partkey % 2 AS INT) AS truth, p_size FROM part WHERE p_partkey % 4 <> 0 UNION ALL
  SELECT p_partkey, 'variant', 0, p_size FROM part WHERE p_partkey % 3 = 0)
SELECT pair_id, kind, truth, p_size / 50 AS claim, 0.5::DOUBLE AS aggregate FROM l WHERE pair_id % 5 <> 0 AND pair_id % 7 <> 0"""


def l_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(_text(F.when(F.col("user_id") % 2 == 0, "gate-").otherwise("run-"), F.col("user_id")).alias("run_id")).agg(F.max("ts").alias("updated_at"))
    return P.companions(runs, ("gate-", "probe-"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("run_id")


L_COMPANIONS = "SELECT 'gate-' || user_id AS run_id FROM events WHERE user_id % 2 = 0 GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-20 00:00:00'"

QUERIES = {
    "a_scope_verdict": (a_scope_verdict, A_SCOPE), "e_regraded": (e_regraded, E_REGRADED), "l_fork_runs": (l_fork_runs, L_FORK), "e_wave_cells": (e_wave_cells, E_CELLS),
    "a_accepted_records": (a_accepted_records, A_RECORDS), "a_unit_batches": (a_unit_batches, A_BATCHES), "v_frame_rows": (v_frame_rows, V_FRAME_ROWS), "v_evidence_set": (v_evidence_set, V_SET),
    "v_markdown": (v_markdown, V_MARKDOWN), "i_pending_targets": (i_pending_targets, I_PENDING), "r_short_fields": (r_short_fields, R_SHORT), "i_head_sample": (i_head_sample, I_HEAD),
    "e_scored_worksheet": (e_scored_worksheet, E_WORKSHEET), "l_companions": (l_companions, L_COMPANIONS),
}
