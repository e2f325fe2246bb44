"""Runs, ledgers and campaigns as rows, over the log, the orders and the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import answers as A
from evidentia.functions import lexicons as lex
from evidentia.functions import text as X
from evidentia.operators import eventlog as L
from evidentia.operators import runs as U
from evidentia.plans import sql as Q
from evidentia.plans.evaluation_queries import _W, RANKED, qrels, rankings
from evidentia.plans.log_queries import LOG, log
from evidentia.sources.corpus import chunks, papers, query_vectors, table

#: Order of an order's lines; rows that are equal in it are equal altogether here.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
_LINES = f"li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) AS line_no FROM lineitem)"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    return table(spark, sf_dir, "lineitem").withColumn("line_no", number)


def l_replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.replay_summary(L.turns(log(spark, sf_dir)))
    return out.withColumn("cost_usd", F.round("cost_usd", 6)).withColumn("chat_cost_usd", F.round("chat_cost_usd", 6))


L_REPLAY = f"""WITH {LOG} SELECT run_id, count(DISTINCT seq // 5) AS turns, CAST(coalesce(sum(tokens) FILTER (call_type = 'chat'), 0) AS BIGINT) AS tokens_in, CAST(0 AS BIGINT) AS tokens_out,
  CAST(coalesce(sum(cached_tokens) FILTER (call_type = 'chat'), 0) AS BIGINT) AS cached_tokens, CAST(coalesce(sum(reasoning_tokens) FILTER (call_type = 'chat'), 0) AS BIGINT) AS reasoning_tokens,
  CAST(coalesce(sum(tokens) FILTER (call_type = 'jev'), 0) AS BIGINT) AS jev_tokens_in, round(coalesce(sum(cost_usd) FILTER (call_type IN ('chat', 'jev')), 0), 6) AS cost_usd,
  round(coalesce(sum(cost_usd) FILTER (call_type = 'chat'), 0), 6) AS chat_cost_usd, count(*) FILTER (call_type = 'tool') AS tool_calls,
  count(*) FILTER (call_type = 'chat' AND actor = 'sub') AS sub_tasks, count(DISTINCT call_id) FILTER (call_type = 'chat' AND actor = 'sub') AS sub_calls,
  count(DISTINCT CASE WHEN call_type = 'exec' THEN seq // 5 END) AS code_blocks, count(*) FILTER (call_type = 'emit') AS emits,
  count(*) FILTER (call_type = 'note' AND event_id % 5 = 0) AS gates_passed, count(*) FILTER (call_type = 'note' AND event_id % 5 <> 0 AND event_id % 7 = 0) AS gates_failed,
  CAST(0 AS BIGINT) AS missing_refs FROM log GROUP BY run_id"""


def l_evidence_upto(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select("run_id", "step_idx", F.col("seq").alias("pos"), F.col("code_ref").alias("chunk_uuid"))
    return U.evidence_upto(rows, 3)


L_EVIDENCE = f"""WITH {LOG} SELECT run_id, CAST(seq // 5 AS INT) AS step_idx, CAST(seq AS INT) AS pos, 'x' || (event_id % 50) AS chunk_uuid FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, event_id % 50 ORDER BY seq) AS r FROM log WHERE seq // 5 <= 3) WHERE r = 1"""


def l_budget_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = log(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("i"), F.sum("tokens").alias("t"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("c"))
    limits = {"iterations": 60, "tokens": 2400, "cost_usd": 0.2, "backtracks": 0}
    used = {"iterations": F.col("i"), "tokens": F.col("t"), "cost_usd": F.col("c"), "backtracks": F.lit(3)}
    return runs.select("run_id", A.budget_warning(used, limits).alias("w")).select("run_id", "w.cap", X.rounded("w.share", 5).alias("share"))


L_WARNING = f"""WITH {LOG}, r AS (SELECT run_id, count(*) / 60 AS i, sum(tokens) / 2400 AS t, sum(cost_usd::DECIMAL(18,6))::DOUBLE / 0.2::DOUBLE AS c FROM log GROUP BY run_id), m AS (SELECT *, greatest(i, t, c) AS top FROM r)
SELECT run_id, CASE WHEN top < 0.8 THEN NULL WHEN i = top THEN 'iterations' WHEN t = top THEN 'tokens' ELSE 'cost_usd' END AS cap, CASE WHEN top >= 0.8 THEN round(top, 5) END AS share FROM m"""


def r_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir, vectors=False).withColumn("run_id", F.floor(F.col("doc_id") / 20)).withColumn("pos", F.col("section_order") * 100 + F.col("doc_id") * 7 % 20)
    return U.round_robin(c, 600, 80).select("run_id", "arxiv_id", "chunk_uuid", "depth", "used")


R_ROBIN = f"""WITH {Q.LINES}, c AS (
  SELECT *, doc_id // 20 AS run_id, section_order * 100 + doc_id * 7 % 20 AS pos, substr(trim(regexp_replace(chunk_text, '\\s+', ' ', 'g'), ' '), 1, 80) AS sample FROM chunks
), d AS (SELECT *, row_number() OVER (PARTITION BY run_id, arxiv_id ORDER BY pos) AS depth, min(pos) OVER (PARTITION BY run_id, arxiv_id) AS f FROM c
), u AS (SELECT *, coalesce(sum(length(sample)) OVER (PARTITION BY run_id ORDER BY depth, f, arxiv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM d)
SELECT run_id, arxiv_id, chunk_uuid, CAST(depth AS INT) AS depth, CAST(used AS BIGINT) AS used FROM u WHERE used < 600 AND sample <> ''"""


def l_run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("run_id") % 3 == 0, "done").otherwise("running")
    runs = log(spark, sf_dir).groupBy("run_id").agg(F.max("ts").alias("updated_at")).withColumn("status", state)
    return U.list_runs(runs, "done").limit(10).select("run_id", "status")


L_LISTING = "SELECT user_id AS run_id, 'done' AS status FROM events WHERE user_id % 3 = 0 GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 10"


def l_gate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    gates = rows.where("call_type = 'note'").select("run_id", "seq", F.col("event_id").alias("gate"))
    return U.zipped(gates, rows.where("call_type = 'jev'").select("run_id", "seq", F.col("event_id").alias("request")), "run_id", "seq").drop("seq")


L_GATES = f"""WITH {LOG}, g AS (SELECT run_id, event_id AS gate, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM log WHERE call_type = 'note'),
j AS (SELECT run_id, event_id AS request, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM log WHERE call_type = 'jev')
SELECT g.run_id, CAST(g.place AS INT) AS place, gate, request FROM g JOIN j ON g.run_id = j.run_id AND g.place = j.place"""


def e_wave_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.status_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O"), "o_totalprice").withColumn("cost", F.round("cost", 1))


E_WAVE = """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other, round(sum(o_totalprice), 1) AS cost FROM orders GROUP BY o_orderpriority"""


def l_campaign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    calls = L.totals(rows.where("run_id % 4 <> 0"), "run_id").select("run_id", "calls", "tool_calls")
    gates = rows.where("run_id % 5 <> 0 and call_type = 'note'").groupBy("run_id").agg(F.count("verdict").alias("verdicts"))
    return U.campaign_rows(rows.select("run_id").distinct(), totals=calls, gates=gates)


L_CAMPAIGN = f"""WITH {LOG}, t AS (SELECT run_id, count(*) FILTER (call_type IN ('chat', 'jev') AND error IS NULL) AS calls, count(*) FILTER (call_type = 'tool') AS tools FROM log WHERE run_id % 4 <> 0 GROUP BY run_id),
g AS (SELECT run_id, count(*) FILTER (event_id % 5 = 0 OR event_id % 7 = 0) AS v FROM log WHERE run_id % 5 <> 0 AND call_type = 'note' GROUP BY run_id)
SELECT j.run_id, calls AS totals_calls, tools AS totals_tool_calls, v AS gates_verdicts, concat_ws(', ', CASE WHEN t.run_id IS NULL THEN 'no totals' END, CASE WHEN g.run_id IS NULL THEN 'no gates' END) AS note
FROM (SELECT DISTINCT run_id FROM log) j LEFT JOIN t ON j.run_id = t.run_id LEFT JOIN g ON j.run_id = g.run_id"""


def l_run_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("run_id")
    runs = log(spark, sf_dir).groupBy("run_id").agg(F.round(F.sum("cost_usd"), 6).alias("log_cost"), F.collect_set("call_type").alias("call_types"))
    return U.run_contract(
        runs.select(
            "*", F.when(r % 2 == 0, "loop").otherwise("flat").alias("shape"), F.when(r % 7 == 0, "failed").otherwise("done").alias("status"),
            (F.col("log_cost") + F.when(r % 9 == 0, 0.5).otherwise(0.0)).alias("manifest_cost"), F.when(r % 5 == 0, " ").otherwise("text").alias("answer"),
            F.when(r % 6 == 0, 1).otherwise(0).alias("open_tasks"), F.when(r % 8 == 1, F.lit(None).cast("int")).otherwise(0).alias("unresolved"), F.lit(0).alias("containers"),
        )
    )


L_CONTRACT = f"""WITH {LOG}, r AS (SELECT run_id, count(*) FILTER (call_type = 'chat') > 0 AS chat, count(*) FILTER (call_type = 'exec') > 0 AS ex, count(*) FILTER (call_type = 'tool') > 0 AS tool FROM log GROUP BY run_id), c AS (
  SELECT run_id, run_id % 7 <> 0 AS finished, run_id % 9 <> 0 AS cost_agrees, chat AND (run_id % 2 = 1 OR (ex AND tool)) AS events_complete, run_id % 5 <> 0 AS answered, run_id % 6 <> 0 AS tasks_closed,
    run_id % 8 <> 1 AS citations_resolved, true AS nothing_running FROM r)
SELECT *, finished AND cost_agrees AND events_complete AND answered AND tasks_closed AND citations_resolved AS ok FROM c"""


def l_tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.tool_usage(log(spark, sf_dir), "t1", "note")


L_USAGE = f"""WITH {LOG}, k AS (SELECT *, call_type = 'tool' AND event_id % 4 = 1 AS mine FROM log)
SELECT run_id, count(*) FILTER (mine AND error IS NULL) AS builds, count(*) FILTER (mine AND error IS NOT NULL) AS failed, count(*) FILTER (mine AND error IS NULL) AS results,
  arg_max('r' || event_id, seq) FILTER (mine AND error IS NULL) AS last_result, count(*) FILTER (call_type = 'note') AS notes FROM k GROUP BY run_id"""


def l_task_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("run_id"), _text("t", F.col("l_partkey") % 3).alias("task_id"), "line_no",
        F.when(F.col("l_partkey") % 4 != 0, F.concat("l_linestatus", "l_returnflag")).alias("status"), (F.col("l_partkey") % 10).alias("tokens"),
        _text("e", F.col("l_suppkey") % 3).alias("evidence_ref"),
    )
    return U.task_snapshot(updates, "line_no").withColumn("evidence", F.array_join("evidence", " "))


L_TASKS = f"""WITH {_LINES}, u AS (SELECT l_orderkey AS run_id, 't' || (l_partkey % 3) AS task_id, line_no, CASE WHEN l_partkey % 4 <> 0 THEN l_linestatus || l_returnflag END AS status, l_partkey % 10 AS tokens,
  'e' || (l_suppkey % 3) AS ref FROM li), e AS (SELECT run_id, task_id, string_agg(ref, ' ' ORDER BY f) AS evidence FROM (SELECT run_id, task_id, ref, min(line_no) AS f FROM u GROUP BY ALL) GROUP BY ALL), t AS (
  SELECT run_id, task_id, min(line_no) AS f, arg_max(status, line_no) FILTER (status IS NOT NULL) AS status, count(*) AS attempts, CAST(sum(tokens) AS BIGINT) AS tokens FROM u GROUP BY run_id, task_id)
SELECT t.run_id, t.task_id, status, attempts, tokens, evidence, CAST(row_number() OVER (PARTITION BY t.run_id ORDER BY f, t.task_id) AS INT) AS place FROM t JOIN e ON t.run_id = e.run_id AND t.task_id = e.task_id"""


def _blobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = L.with_blobs(table(spark, sf_dir, "documents"))
    return docs, docs.where("doc_id % 3 <> 0")


def l_blob_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, have = _blobs(spark, sf_dir)
    return U.load_blobs(docs.select("doc_id", "ref"), have).select("doc_id", F.length("text").alias("chars"))


L_BLOBS = "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 3 <> 0) THEN CAST(length(text) AS INT) END AS chars FROM documents"


def l_bundle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, have = _blobs(spark, sf_dir)
    spoilt = have.withColumn("text", F.when(F.length("text") % 10 == 1, F.concat("text", F.lit("\r"))).otherwise(F.col("text")))
    return U.bundle_status(docs.select(F.col("source").alias("run_id"), "ref"), spoilt, "[Pp]assword|AKIA")


L_BUNDLE = """WITH h AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 <> 0), r AS (SELECT DISTINCT source AS run_id, d.text AS t, h.text AS have FROM documents d LEFT JOIN h ON d.text = h.text), c AS (
  SELECT run_id, count(*) AS refs, count(*) FILTER (have IS NULL) AS missing, count(*) FILTER (length(have) % 10 = 1) AS corrupt, count(*) FILTER (regexp_matches(have, '[Pp]assword|AKIA')) AS leaks FROM r GROUP BY run_id)
SELECT *, missing = 0 AND corrupt = 0 AND leaks = 0 AS ok FROM c"""

_STATUS = {"R": "grounded", "A": "contradicted", "N": "unverifiable"}
_STATUS_SQL = "CASE l_returnflag " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATUS.items()) + " END"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each order: its lines, by unit."""
    status = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("run_id"), F.col("line_no").alias("frame_index"), (F.col("l_linenumber") % 4).cast("int").alias("unit_index"), _text("a  claim ", F.col("l_suppkey") % 2).alias("text"),
        F.lit("reports").alias("predicate"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(_text("q ", F.col("l_partkey") % 2)).alias("quote"),
        _text("chunk", F.col("l_suppkey") % 5, "-long").alias("chunk_id"), F.try_element_at(status, F.col("l_returnflag")).alias("status"),
    )


_FRAMES = f"""{_LINES}, frames AS (SELECT l_orderkey AS run_id, line_no AS frame_index, l_linenumber % 4 AS unit_index, 'a  claim ' || (l_suppkey % 2) AS text,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'q ' || (l_partkey % 2) END AS quote, 'chunk' || (l_suppkey % 5) || '-long' AS chunk_id, {_STATUS_SQL} AS status FROM li)"""


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    names = [c for c in f.columns if c not in ("run_id", "frame_index")]
    return f.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("frame_index", *names))).alias("frames"), F.lit(4).alias("units"), F.count_distinct("unit_index").alias("covered")
    )


def v_ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.ledger_rows(_ledgers(spark, sf_dir))


V_LEDGER = f"""WITH {_FRAMES}, e AS (
  SELECT run_id, u, row_number() OVER (PARTITION BY run_id ORDER BY u) AS k FROM (SELECT DISTINCT run_id FROM frames), (SELECT unnest([0, 1, 2, 3]) AS u)
  WHERE (run_id, u) NOT IN (SELECT (run_id, unit_index) FROM frames)
), n AS (SELECT run_id, count(*) AS n FROM frames GROUP BY run_id)
SELECT run_id, CAST(frame_index AS INT) AS number, status, replace(text, '  ', ' ') AS claim, 'reports' AS predicate, quote, substr(chunk_id, 1, 8) AS chunk FROM frames
UNION ALL SELECT e.run_id, CAST(n + k AS INT), 'uncovered', 'unit ' || u || ' produced no frame', NULL, '', '' FROM e JOIN n ON e.run_id = n.run_id"""


def v_claim_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.claim_totals(_ledgers(spark, sf_dir))


V_TOTALS = f"""WITH {_FRAMES}, r AS (SELECT run_id, count(DISTINCT unit_index) AS covered, count(*) AS n, count(*) FILTER (status = 'grounded') AS g, count(*) FILTER (status = 'contradicted') AS c,
  count(*) FILTER (status = 'unverifiable') AS u FROM frames GROUP BY run_id)
SELECT count(*) AS runs, count(*) * 4 AS units, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS claims, CAST(sum(g) AS BIGINT) AS grounded, CAST(sum(c) AS BIGINT) AS contradicted,
  CAST(sum(u) AS BIGINT) AS unverifiable, round(sum(covered) / (count(*) * 4), 4) AS coverage FROM r"""


def v_distinct_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([("chunk0-long", "x"), ("chunk1-long", ""), ("chunk2-long", "y"), ("chunk2-long", "z")], "chunk_uuid string, chunk_text string")
    return U.distinct_frames(frames(spark, sf_dir), texts).select("run_id", "frame_index", "unit_index", "quote", "chunk_id", "status")


V_DISTINCT = f"""WITH {_FRAMES} SELECT run_id, CAST(frame_index AS INT) AS frame_index, CAST(unit_index AS INT) AS unit_index, quote, chunk_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, unit_index, chunk_id, CASE WHEN quote = '' THEN replace(text, '  ', ' ') ELSE quote END ORDER BY frame_index) AS r
  FROM frames WHERE chunk_id IN ('chunk0-long', 'chunk2-long')) WHERE r = 1"""


def e_flagged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lines(spark, sf_dir).select(F.col("l_orderkey").alias("run_id"), _text("n", F.col("line_no")).alias("name"), (F.col("l_discount") * 10).alias("p"))
    return U.flagged_claims(scores).select("run_id", "name", "place")


E_FLAGGED = f"""WITH {_LINES} SELECT run_id, name, CAST(place AS INT) AS place FROM (SELECT l_orderkey AS run_id, 'n' || line_no AS name,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount * 10 DESC, 'n' || line_no) AS place FROM li WHERE l_discount * 10 >= 0.5) WHERE place <= 3"""


def e_judge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("p_partkey") % 5 == 0, "no verdicts").otherwise(_text("Sure: {\"clarity\": \"Pass \", \"depth\": \"", F.col("p_brand"), "\", \"scope\": \"fail\"} done"))
    return U.judged(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), reply.alias("reply")), ("clarity", "depth", "scope", "style"))


E_JUDGE = """SELECT p_partkey AS run_id, facet, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN facet = 'clarity' THEN 'pass' WHEN facet = 'scope' THEN 'fail' ELSE 'unknown' END AS verdict
FROM part, (SELECT unnest(['clarity', 'depth', 'scope', 'style']) AS facet)"""


def r_sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 2 * 100).alias("k"), F.lit(20).alias("n"), (F.col("l_partkey") % 2).alias("c"), F.lit(100).alias("c_top"), F.col("l_quantity").alias("chunks"),
        (F.col("l_partkey") % 20).alias("papers_with_chunks"), (20 - F.col("l_partkey") % 20).alias("papers_without_chunks"), (F.col("l_suppkey") % 7).alias("chunks_per_paper_min"),
        F.col("l_extendedprice").alias("bundle_chars"),
    )
    return U.sweep_summary(rows)


R_SWEEP = """SELECT l_linenumber % 2 * 100 AS k, 20 AS n, l_partkey % 2 AS c, 100 AS c_top, count(*) AS queries, round(avg(l_quantity), 1) AS chunks_mean, round(avg(l_partkey % 20), 1) AS papers_mean,
  max(20 - l_partkey % 20) AS starved_worst, min(l_suppkey % 7) AS chunks_min_worst, round(avg(l_extendedprice) / 1000, 1) AS kchars_mean FROM lineitem GROUP BY ALL"""


def r_relevance_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = qrels(spark, sf_dir).where("rel > 0").select("query_id", "doc_id", F.col("rel").alias("grade"))
    return U.relevance_grid(rankings(spark, sf_dir).where("config = 'dense'"), grades, (3, 10))


R_GRID = f"""WITH {RANKED}, g AS (SELECT query_id, count(*) AS a, count(*) FILTER (rel >= 2) AS c FROM qrels WHERE rel > 0 GROUP BY query_id), cells AS (SELECT *, unnest([3, 10]) AS n FROM g), per AS (
  SELECT r.query_id, n, count(*) AS have, count(rel) AS hit, count(*) FILTER (rel >= 2) AS core FROM (SELECT *, unnest([3, 10]) AS n FROM rankings WHERE config = 'dense') r
  LEFT JOIN (SELECT * FROM qrels WHERE rel > 0) q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE rank <= n GROUP BY r.query_id, n)
SELECT cells.query_id, cells.n, round(coalesce(coalesce(core, 0) / nullif(c, 0), 0), 3) AS recall_core, round(coalesce(hit, 0) / a, 3) AS recall_all, round(coalesce(hit, 0) / greatest(1, coalesce(have, 0)), 3) AS precision
FROM cells LEFT JOIN per ON cells.query_id = per.query_id AND cells.n = per.n"""


def r_target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = query_vectors(spark, sf_dir).select("query_id", (F.col("query_id") + F.when(F.col("query_id") % 40 == 0, 0).otherwise(1)).alias("target"))
    return U.rank_of(rankings(spark, sf_dir).where("config = 'dense'"), wanted)


R_TARGET = f"""WITH {RANKED} SELECT t.query_id, target, CAST(rank AS INT) AS rank FROM (SELECT vec_id AS query_id, vec_id + CASE WHEN vec_id % 40 = 0 THEN 0 ELSE 1 END AS target FROM embeddings WHERE vec_id % 20 = 0) t
LEFT JOIN (SELECT * FROM rankings WHERE config = 'dense') r ON t.query_id = r.query_id AND t.target = r.doc_id"""


def r_paper_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    d = F.col("doc_id")
    asked = p.where("doc_id % 20 = 0").select(
        d.alias("pos"), F.when(d % 60 == 0, F.concat(F.lit("x"), F.col("arxiv_id"))).when(d % 60 == 20, F.lit("0000.00000")).otherwise(F.concat(F.lit(" "), F.col("arxiv_id"))).alias("arxiv_id")
    )
    out = U.paper_envelope(p, chunks(spark, sf_dir, vectors=False), asked, f"^{lex.PAPER_ID}$")
    return out.select("pos", "arxiv_id", "status", F.col("paper.source").alias("source"), F.size("chunks").alias("chunks"), F.try_element_at("chunks", F.lit(1))["preview"].alias("preview"))


R_ENVELOPE = f"""WITH {Q.LINES}, a AS (SELECT doc_id AS pos, CASE WHEN doc_id % 60 = 0 THEN 'x' || {Q.PAPER_ID} WHEN doc_id % 60 = 20 THEN '0000.00000' ELSE {Q.PAPER_ID} END AS arxiv_id FROM documents WHERE doc_id % 20 = 0),
p AS (SELECT {Q.PAPER_ID} AS arxiv_id, source FROM documents), c AS (SELECT arxiv_id, count(*) AS n, substr(arg_min(chunk_text, section_order), 1, 160) AS preview FROM chunks GROUP BY arxiv_id)
SELECT pos, a.arxiv_id, CASE WHEN a.arxiv_id LIKE 'x%' THEN 'invalid' WHEN p.arxiv_id IS NOT NULL THEN 'found' ELSE 'missing' END AS status, source, CAST(least(500, coalesce(n, 0)) AS INT) AS chunks, preview
FROM a LEFT JOIN p ON a.arxiv_id = p.arxiv_id LEFT JOIN c ON a.arxiv_id = c.arxiv_id"""


def i_corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.corpus_counts(papers(spark, sf_dir), chunks(spark, sf_dir))


I_COUNTS = f"""WITH {Q.LINES} SELECT 'papers' AS kind, count(*) AS n, count(embedding) AS vectors FROM documents LEFT JOIN embeddings ON doc_id = vec_id
UNION ALL SELECT 'chunks', count(*), count(chunk_embedding) FROM vector_chunks"""


def c_line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.line_records(table(spark, sf_dir, "documents"), "doc_id", "text")


C_RECORDS = """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS k FROM documents), r AS (SELECT doc_id, unnest(range(len(k))) AS pos, unnest(k) AS text FROM l)
SELECT doc_id, CAST(pos AS INT) AS pos, printf('rec-%04d', pos) AS id, trim(text, ' ') AS text FROM r"""


def e_score_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("arm"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_linestatus")).alias("answer_type"), (F.col("l_suppkey") % 9 != 0).alias("usable"), F.col("l_discount").alias("score")
    )
    return U.score_means(rows, "arm", "answer_type").withColumn("mean", F.round("mean", 6))


E_MEANS = """WITH r AS (SELECT l_returnflag AS arm, coalesce(CASE WHEN l_partkey % 4 <> 0 THEN l_linestatus END, '?') AS t, l_suppkey % 9 <> 0 AS u, l_discount AS s FROM lineitem)
SELECT 'arm' AS kind, arm AS name, count(*) FILTER (u) AS n, round(avg(s) FILTER (u), 6) AS mean, count(*) FILTER (NOT u) AS excluded FROM r GROUP BY arm
UNION ALL SELECT 'answer_type', t, count(*) FILTER (u), round(avg(s) FILTER (u), 6), count(*) FILTER (NOT u) FROM r GROUP BY t"""

_LABELS = ("supported", "not supported", "cannot judge", "other")


def e_truth_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return U.truth_by_status(table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("status"), label.alias("label")))


E_TRUTH = f"""WITH r AS (SELECT coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, 'unknown') AS status, l_partkey % 4 AS p FROM lineitem WHERE l_partkey % 4 < 3), c AS (
  SELECT status, count(*) FILTER (p = 0) AS k, count(*) FILTER (p = 1) AS nk, count(*) FILTER (p = 2) AS cj, count(*) FILTER (p < 2) AS n FROM r GROUP BY status)
SELECT status, k AS supported, nk AS not_supported, cj AS cannot_judge, n AS decided, round(k / n, 4) AS rate, round(greatest(0, {_W.format(s='-')}), 4) AS low, round(least(1, {_W.format(s='+')}), 4) AS high FROM c"""


def e_claim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("ok", "stale", "empty", "missing_ledger")])
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("arm"), (F.col("l_partkey") % 6 == 0).alias("missing"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_discount")).alias("recall"), F.col("l_quantity").alias("precision"), F.element_at(kinds, (F.col("l_partkey") % 4 + 1).cast("int")).alias("ledger"),
    )
    return U.claim_summary(rows, ("recall", "precision"))


E_CLAIMS = """SELECT l_returnflag AS arm, count(*) AS runs, count(*) FILTER (l_partkey % 6 <> 0) AS usable, round(avg(l_discount) FILTER (l_partkey % 6 <> 0 AND l_suppkey % 3 <> 0), 4) AS recall,
  round(avg(l_quantity) FILTER (l_partkey % 6 <> 0), 4) AS precision, count(*) FILTER (l_partkey % 4 = 0) AS ok, count(*) FILTER (l_partkey % 4 = 1) AS stale, count(*) FILTER (l_partkey % 4 = 2) AS empty,
  count(*) FILTER (l_partkey % 4 = 3) AS missing_ledger FROM lineitem GROUP BY l_returnflag"""


def i_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<struct<version: string>>")).otherwise(F.array(*[F.struct(v.alias("version")) for v in (F.lit("v1"), _text("v", F.col("p_size")))]))
    return U.targets(table(spark, sf_dir, "part").select(_text("id", F.col("p_partkey")).alias("id"), versions.alias("versions"), "p_name"), F.contains("p_name", F.lit("red")), 40)


I_TARGETS = "SELECT 'id' || p_partkey AS id, 'v' || p_size AS version FROM part WHERE contains(p_name, 'red') AND p_partkey % 5 <> 0 ORDER BY 1 LIMIT 40"


def i_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cursor(chunks(spark, sf_dir, vectors=False), ("Methodology", "Experiment"), 100).select("chunk_uuid", "section_type", F.length("chunk_text").alias("chars"))


I_CURSOR = f"WITH {Q.LINES} SELECT chunk_uuid, section_type, CAST(length(chunk_text) AS INT) AS chars FROM chunks WHERE section_type IN ('Methodology', 'Experiment') ORDER BY chunk_uuid LIMIT 100"


def a_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question line of each part, as annotators get it, and its cache key."""
    p = table(spark, sf_dir, "part")
    line = A.triple_question(F.col("p_name"), F.lit("Method"), F.lit("uses"), F.col("p_brand"), F.lit("Dataset"), _text(F.col("p_partkey")))
    return p.select("p_partkey", line.alias("question"), A.cache_key(F.col("p_name"), F.col("p_brand")).alias("key"), A.truncated(X.collapse("p_name"), 5).alias("short"))


A_QUESTION = """SELECT p_partkey, 'Is it true that ' || p_name || ' (Method) uses ' || p_brand || ' (Dataset) at arxiv paper ' || p_partkey AS question,
  sha256(length(p_name) || ':' || p_name || length(p_brand) || ':' || p_brand) AS key, CASE WHEN length(p_name) > 5 THEN substr(p_name, 1, 5) || '… [truncated]' ELSE p_name END AS short FROM part"""

QUERIES = {
    "l_replay_summary": (l_replay_summary, L_REPLAY), "l_evidence_upto": (l_evidence_upto, L_EVIDENCE), "l_budget_warning": (l_budget_warning, L_WARNING),
    "r_round_robin": (r_round_robin, R_ROBIN), "l_run_listing": (l_run_listing, L_LISTING), "l_gate_calls": (l_gate_calls, L_GATES), "e_wave_status": (e_wave_status, E_WAVE),
    "l_campaign_rows": (l_campaign_rows, L_CAMPAIGN), "l_run_contract": (l_run_contract, L_CONTRACT), "l_tool_usage": (l_tool_usage, L_USAGE), "l_task_snapshot": (l_task_snapshot, L_TASKS),
    "l_blob_load": (l_blob_load, L_BLOBS), "l_bundle_status": (l_bundle_status, L_BUNDLE), "v_ledger_rows": (v_ledger_rows, V_LEDGER), "v_claim_totals": (v_claim_totals, V_TOTALS),
    "v_distinct_frames": (v_distinct_frames, V_DISTINCT), "e_flagged_claims": (e_flagged_claims, E_FLAGGED), "e_judge_rows": (e_judge_rows, E_JUDGE), "r_sweep_summary": (r_sweep_summary, R_SWEEP),
    "r_relevance_grid": (r_relevance_grid, R_GRID), "r_target_rank": (r_target_rank, R_TARGET), "r_paper_envelope": (r_paper_envelope, R_ENVELOPE), "i_corpus_counts": (i_corpus_counts, I_COUNTS),
    "c_line_records": (c_line_records, C_RECORDS), "e_score_means": (e_score_means, E_MEANS), "e_truth_by_status": (e_truth_by_status, E_TRUTH), "e_claim_summary": (e_claim_summary, E_CLAIMS),
    "i_targets": (i_targets, I_TARGETS), "i_cursor": (i_cursor, I_CURSOR), "a_question": (a_question, A_QUESTION),
}
