"""Group L: the run log, over ``events`` and ``conversations``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import eventlog as L
from evidentia.sources.corpus import table
from evidentia.sources.shared import shared_dir

#: Event types as call types of the log.
CALLS = {"click": "tool", "view": "chat", "purchase": "jev", "error": "exec", "signup": "emit"}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for pair in CALLS.items() for x in pair])
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("event_id") % 17 == 0, "note").otherwise(F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("note")))
    none = F.lit(None).cast("string")
    return e.select(
        F.col("user_id").alias("run_id"), seq.alias("seq"), "event_id", "ts", F.col("event_type").alias("action"), kind.alias("call_type"),
        (F.col("value") / 10000).alias("cost_usd"), F.get_json_object("props", "$.k").cast("int").alias("tokens"),
    ).select(
        "*", F.col("tokens").alias("tokens_in"), F.lit(0).alias("tokens_out"), (F.col("seq") / 5).cast("int").alias("step_idx"),
        F.when(F.col("event_id") % 11 == 0, F.lit("failed")).alias("error"), F.when(F.col("event_id") % 2 == 0, "root").otherwise("sub").alias("actor"),
        F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), F.concat(F.lit("c"), F.col("event_id")).alias("completion_ref"),
        F.concat(F.lit("p"), F.col("event_id")).alias("prompt_ref"), F.concat(F.lit("x"), F.col("event_id") % 50).alias("code_ref"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("s"), F.col("event_id"))).alias("stdout_ref"), none.alias("stderr_ref"),
        F.concat(F.lit("r"), F.col("event_id")).alias("result_ref"), none.alias("args_ref"), none.alias("reasoning_ref"),
        F.concat(F.lit("t"), F.col("event_id") % 4).alias("tool"), F.md5((F.col("tokens") % 5).cast("string")).alias("args_hash"),
        F.lit(10).alias("latency_ms"), F.when(F.col("event_id") % 5 == 0, "pass").when(F.col("event_id") % 7 == 0, "fail").alias("verdict"),
        (F.col("tokens") / 2).cast("int").alias("cached_tokens"), (F.col("event_id") % 3).cast("int").alias("reasoning_tokens"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"var": "v'), F.col("event_id") % 4, F.lit('", "call_id": "k'), F.col("event_id") % 9, F.lit('"}')))
        .when(F.col("event_id") % 13 == 0, F.concat(F.lit('{"budget": '), F.col("event_id"), F.lit("}"))).alias("extra"),
    )


_CASE = "CASE WHEN event_id % 17 = 0 THEN 'note' " + " ".join(f"WHEN event_type = '{a}' THEN '{b}'" for a, b in CALLS.items()) + " ELSE 'note' END"
LOG = f"""log AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, event_type AS action,
    {_CASE} AS call_type, value / 10000 AS cost_usd, CAST(props->>'$.k' AS INT) AS tokens,
    CASE WHEN event_id % 11 = 0 THEN 'failed' END AS error, CASE WHEN event_id % 2 = 0 THEN 'root' ELSE 'sub' END AS actor,
    CAST(props->>'$.k' AS INT) // 2 AS cached_tokens, event_id % 3 AS reasoning_tokens, CASE WHEN event_id % 3 = 0 THEN 'v' || (event_id % 4) END AS var,
    CASE WHEN event_id % 3 = 0 THEN 'k' || (event_id % 9) END AS call_id, CASE WHEN event_id % 3 <> 0 AND event_id % 13 = 0 THEN CAST(event_id AS VARCHAR) END AS budget
  FROM events
)"""


def l_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.totals(log(spark, sf_dir), "run_id").withColumn("cost_usd", F.round("cost_usd", 4))


L_TOTALS = f"""WITH {LOG} SELECT run_id, count(*) AS events, round(sum(coalesce(cost_usd, 0)), 4) AS cost_usd, CAST(sum(tokens) AS BIGINT) AS tokens_in,
  CAST(0 AS BIGINT) AS tokens_out, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
  count(*) FILTER (call_type IN ('chat', 'jev') AND error IS NULL) AS calls, count(*) FILTER (call_type = 'tool') AS tool_calls FROM log GROUP BY run_id"""


def l_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_action(log(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 3))


L_ACTION = f"""WITH {LOG} SELECT action, count(*) AS events, round(sum(coalesce(cost_usd, 0)), 3) AS cost_usd, CAST(sum(tokens) AS BIGINT) AS tokens_in, CAST(0 AS BIGINT) AS tokens_out
FROM log GROUP BY GROUPING SETS ((action), ())"""


def l_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.turns(log(spark, sf_dir))
    return t.select(
        "run_id", "step_idx", F.round("cost_usd", 6).alias("cost_usd"), "tokens", "model", "completion_ref", "code_ref", "ok",
        F.array_join("tools", ",").alias("tools"), F.size("emits").alias("emits"), F.size("verdicts").alias("verdicts"),
    )


L_TURNS = f"""WITH {LOG} SELECT run_id, CAST(seq // 5 AS INT) AS step_idx, round(sum(cost_usd) FILTER (call_type = 'chat'), 6) AS cost_usd,
  CAST(sum(tokens) FILTER (call_type = 'chat') AS BIGINT) AS tokens, arg_min('m' || (event_id % 3), seq) FILTER (call_type = 'chat') AS model,
  coalesce(arg_max('c' || event_id, seq) FILTER (call_type = 'chat' AND actor = 'root'), arg_max('c' || event_id, seq) FILTER (call_type = 'chat')) AS completion_ref,
  arg_max('x' || (event_id % 50), seq) FILTER (call_type = 'exec') AS code_ref,
  CASE arg_max(CASE WHEN error IS NOT NULL THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END, seq) FILTER (call_type = 'exec')
    WHEN 0 THEN false WHEN 1 THEN true END AS ok,
  coalesce(string_agg('t' || (event_id % 4), ',' ORDER BY seq) FILTER (call_type = 'tool'), '') AS tools,
  CAST(count(*) FILTER (call_type = 'emit') AS INT) AS emits, CAST(count(*) FILTER (call_type = 'note' AND (event_id % 5 = 0 OR event_id % 7 = 0)) AS INT) AS verdicts
FROM log GROUP BY run_id, seq // 5"""


def l_stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.running(log(spark, sf_dir), "seq")
    reason = L.stop_reason(F.col("iterations"), F.col("tokens_so_far"), F.col("cost_so_far"), (40, 1500, 0.12))
    return rows.select("run_id", "seq", "tokens_so_far", reason.alias("reason")).where("reason is not null")


L_STOP = f"""WITH {LOG}, r AS (SELECT run_id, seq, sum(tokens) OVER w AS tokens_so_far, sum(cost_usd) OVER w AS c FROM log
  WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT run_id, CAST(seq AS INT) AS seq, CAST(tokens_so_far AS BIGINT) AS tokens_so_far,
  CASE WHEN seq >= 40 THEN 'iterations' WHEN tokens_so_far >= 1500 THEN 'tokens' ELSE 'cost' END AS reason
FROM r WHERE seq >= 40 OR tokens_so_far >= 1500 OR c >= 0.12"""


def l_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = log(spark, sf_dir).groupBy("run_id").agg(F.max("ts").alias("last_event")).withColumn("status", F.lit("running"))
    return L.heartbeat(runs, F.lit("2024-01-27 00:00:00").cast("timestamp_ntz"), 86400).groupBy("status").agg(F.count("*").alias("n"))


L_HEART = """WITH r AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id)
SELECT CASE WHEN epoch(TIMESTAMP '2024-01-27 00:00:00') - floor(epoch(t)) > 86400 THEN 'interrupted' ELSE 'running' END AS status, count(*) AS n FROM r GROUP BY 1"""


def l_tool_cache_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tool_cache(log(spark, sf_dir))


L_CACHE = f"""WITH {LOG} SELECT run_id, 't' || (event_id % 4) AS tool, md5(CAST(tokens % 5 AS VARCHAR)) AS args_hash, arg_max('r' || event_id, seq) AS result_ref,
  CAST(max(seq) AS INT) AS seq FROM log WHERE call_type = 'tool' AND error IS NULL GROUP BY 1, 2, 3"""


def l_refs_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.refs(log(spark, sf_dir)).groupBy("run_id").agg(F.count("*").alias("refs"))


L_REFS = f"""WITH {LOG}, f AS (SELECT * FROM log), refs AS (
  SELECT run_id, 'c' || event_id AS ref FROM f UNION SELECT run_id, 'p' || event_id FROM f UNION SELECT run_id, 'x' || (event_id % 50) FROM f
  UNION SELECT run_id, 's' || event_id FROM f WHERE event_id % 3 = 0 UNION SELECT run_id, 'r' || event_id FROM f
) SELECT run_id, count(*) AS refs FROM refs GROUP BY run_id"""


def l_blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = L.with_blobs(texts.where("doc_id % 10 = 0"))
    return L.new_blobs(texts, stored).select("ref", F.length("text").alias("chars"))


L_BLOB = """SELECT DISTINCT 'sha256:' || sha256(text) AS ref, CAST(length(text) AS INT) AS chars FROM documents
WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0)"""


def l_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").withColumn("tokens", X.token_estimate("text"))
    return L.compaction(messages, trigger=300, target=200, system_tokens=20, start=F.col("conv_id") % 4)


L_COMPACTION = """WITH m AS (SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM conversations),
l AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS newest FROM m), k AS (SELECT * FROM l WHERE turn >= least(conv_id % 4, newest)),
w AS (SELECT *, 20 + sum(tokens) OVER (PARTITION BY conv_id) AS total,
  20 + sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS suffix FROM k)
SELECT conv_id, min(turn) FILTER (total <= 300 OR suffix <= 200 OR turn = newest) AS start, CAST(max(total) AS BIGINT) AS total FROM w GROUP BY conv_id"""


def l_budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").cast("int").alias("pos"), X.token_estimate("text").cast("long").alias("cost")).alias("m"))
    lists = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("items"))
    return lists.select("conv_id", F.array_join(F.transform(L.budget_select(F.col("items"), 250), lambda x: x.cast("string")), " ").alias("kept"))


L_BUDGET = """WITH RECURSIVE m AS (
  SELECT conv_id, turn, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, tokens) AS k FROM (
    SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM conversations)
), r AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST(250 AS BIGINT) AS room, '' AS kept FROM m
  UNION ALL SELECT r.conv_id, m.k, CASE WHEN tokens <= room THEN room - tokens ELSE room END, CASE WHEN tokens <= room THEN kept || ' ' || turn ELSE kept END
  FROM r JOIN m ON m.conv_id = r.conv_id AND m.k = r.k + 1
) SELECT conv_id, trim(arg_max(kept, k), ' ') AS kept FROM r GROUP BY conv_id"""


def l_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = L.rebuild(log(spark, sf_dir))
    listed = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return state.select(
        "run_id", "last_seq", "prompt_ref", "completion_ref", "budget", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"),
        listed("emits").alias("emits"), listed("tool_results").alias("tool_results"),
    )


L_REBUILD = f"""WITH {LOG}, c AS (
  SELECT *, max(CASE WHEN call_type = 'chat' AND actor = 'root' AND error IS NULL THEN seq END) OVER (PARTITION BY run_id) AS chat FROM log
), outs AS (
  SELECT run_id, string_agg('user:' || CASE WHEN event_id % 3 = 0 THEN 's' || event_id WHEN error IS NOT NULL THEN '[block failed: ' || error || ']' ELSE '[block interrupted; effects unknown]' END,
    '|' ORDER BY seq) AS o FROM c WHERE call_type = 'exec' AND seq > coalesce(chat, -1) GROUP BY run_id
), emitted AS (
  SELECT run_id, string_agg(var || '=' || v, ' ' ORDER BY var) AS e FROM (SELECT run_id, var, arg_max('r' || event_id, seq) AS v FROM log
    WHERE call_type = 'emit' AND error IS NULL AND var IS NOT NULL GROUP BY run_id, var) GROUP BY run_id
), called AS (
  SELECT run_id, string_agg(k || '=' || v, ' ' ORDER BY k) AS t FROM (SELECT run_id, 't' || (event_id % 4) || ':' || md5(CAST(tokens % 5 AS VARCHAR)) AS k, arg_max('r' || event_id, seq) AS v
    FROM log WHERE call_type = 'tool' AND error IS NULL GROUP BY 1, 2) GROUP BY run_id
), base AS (
  SELECT run_id, CAST(max(seq // 5) + 1 AS INT) AS last_seq, arg_max('p' || event_id, CASE WHEN seq = chat THEN seq END) AS prompt_ref,
    arg_max('c' || event_id, CASE WHEN seq = chat THEN seq END) AS completion_ref, arg_max(budget, CASE WHEN budget IS NOT NULL THEN seq END) AS budget FROM c GROUP BY run_id
)
SELECT b.run_id, last_seq, prompt_ref, completion_ref, budget, concat_ws('|', 'assistant:' || completion_ref, o) AS messages, e AS emits, t AS tool_results
FROM base b LEFT JOIN outs ON b.run_id = outs.run_id LEFT JOIN emitted ON b.run_id = emitted.run_id LEFT JOIN called ON b.run_id = called.run_id"""


def l_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals again, as a stream over the file that ends when it is read."""
    from evidentia.streaming.eventlog import stream_totals

    batch = table(spark, sf_dir, "events")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(
        F.col("user_id").alias("run_id"), (F.col("value") / 10000).alias("cost_usd"), F.get_json_object("props", "$.k").cast("int").alias("tokens_in"),
        F.lit(0).alias("tokens_out"), F.lit(1).alias("cached_tokens"), F.lit(None).cast("int").alias("reasoning_tokens"),
        F.when(F.col("event_type") == "click", "tool").otherwise("chat").alias("call_type"),
        F.when(F.col("event_id") % 11 == 0, "failed").alias("error"),
    )

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out")

    query = (
        stream_totals(events, "run_id").writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("cost_usd", F.round("cost_usd", 4))


L_STREAM = """SELECT user_id AS run_id, count(*) AS events, round(sum(value / 10000), 4) AS cost_usd, CAST(sum(CAST(props->>'$.k' AS INT)) AS BIGINT) AS tokens_in,
  CAST(0 AS BIGINT) AS tokens_out, count(*) AS cached_tokens, CAST(0 AS BIGINT) AS reasoning_tokens,
  count(*) FILTER (event_type <> 'click' AND event_id % 11 <> 0) AS calls, count(*) FILTER (event_type = 'click') AS tool_calls FROM events GROUP BY user_id"""

QUERIES = {
    "l_totals": (l_totals, L_TOTALS), "l_by_action": (l_by_action, L_ACTION), "l_turns": (l_turns, L_TURNS), "l_stop_reason": (l_stop_reason, L_STOP),
    "l_heartbeat": (l_heartbeat, L_HEART), "l_tool_cache_last": (l_tool_cache_last, L_CACHE), "l_refs_distinct": (l_refs_distinct, L_REFS),
    "l_blob_dedup": (l_blob_dedup, L_BLOB), "l_compaction": (l_compaction, L_COMPACTION), "l_budget_select": (l_budget_select, L_BUDGET),
    "l_rebuild": (l_rebuild, L_REBUILD), "l_stream_totals": (l_stream_totals, L_STREAM),
}
