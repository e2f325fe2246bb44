"""The run log: totals, turns, budgets, rebuilt state, compaction, blobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import EVIDENCE_CHUNK_CHARS, EVIDENCE_CHUNKS, EVIDENCE_TOTAL_CHARS, HEARTBEAT_STALE_S, MAX_BACKTRACKS, MAX_COST_USD, MAX_ITERATIONS, MAX_TOKENS
from evidentia.sources.tables import REFS

#: Call types that are model calls.
MODEL_CALLS = ("chat", "jev")


def _sum(c: str) -> Column:
    return F.sum(F.coalesce(F.col(c), F.lit(0)))


def counts() -> list[Column]:
    """Every event costs; a failed model call (it is tried again) is no call, a
    failed tool was called all the same."""
    spent = ("cost_usd", "tokens_in", "tokens_out", "cached_tokens", "reasoning_tokens")
    return [
        *[_sum(c).alias(c) for c in spent],
        F.count_if(F.col("call_type").isin(*MODEL_CALLS) & F.col("error").isNull()).alias("calls"),
        F.count_if(F.col("call_type") == "tool").alias("tool_calls"),
    ]


def totals(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("events"), *counts())


def by_action(events: DataFrame) -> DataFrame:
    """Per action, and over all (null), in one aggregation."""
    named = events.withColumn("action", F.coalesce(F.when(F.col("action") != "", F.col("action")), F.lit("unknown")))
    return named.rollup("action").agg(F.count("*").alias("events"), *[_sum(c).alias(c) for c in ("cost_usd", "tokens_in", "tokens_out")])


def turns(events: DataFrame) -> DataFrame:
    """One row for each run and step, folded by call type in order of ``seq``.

    Chats add up; of a chat's texts the root's is preferred; the last code,
    output, gate and budget count; emits, tools and verdicts are listed.
    """

    def when(kind: str, value: str | Column) -> Column:
        return F.when(F.col("call_type") == kind, F.col(value) if isinstance(value, str) else value)

    def last(kind: str, value: str) -> Column:
        is_ = (F.col("call_type") == kind) & F.col(value).isNotNull()
        return F.max_by(F.when(is_, F.col(value)), F.when(is_, F.col("seq")))

    def listed(kind: str, value: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.when((F.col("call_type") == kind) & F.col(value).isNotNull(), F.struct("seq", F.col(value).alias("v")))))
        return F.transform(pairs, lambda p: p["v"])

    chat = F.col("call_type") == "chat"
    root = chat & (F.col("actor") == "root") & F.col("completion_ref").isNotNull()
    any_ = chat & F.col("completion_ref").isNotNull()
    return events.groupBy("run_id", "step_idx").agg(
        F.sum(when("chat", "cost_usd")).alias("cost_usd"), F.sum(when("jev", "cost_usd")).alias("judge_cost_usd"),
        F.sum(when("chat", F.col("tokens_in") + F.col("tokens_out"))).alias("tokens"), F.sum(when("chat", "latency_ms")).alias("latency_ms"),
        *[F.sum(when("chat", c)).alias(c) for c in ("tokens_in", "tokens_out", "cached_tokens", "reasoning_tokens")],
        F.sum(when("jev", "tokens_in")).alias("jev_tokens_in"),
        F.count_if(chat & (F.col("actor") == "sub")).alias("sub_tasks"),
        F.collect_set(F.when(chat & (F.col("actor") == "sub"), F.get_json_object("extra", "$.call_id"))).alias("sub_calls"),
        F.max_by(F.get_json_object("extra", "$.budget"), F.when(F.get_json_object("extra", "$.budget").isNotNull(), F.col("seq"))).alias("budget"),
        F.array_compact(F.collect_list("error")).alias("errors"),
        F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*REFS))))).alias("refs"),
        F.min_by(F.when(chat & F.col("model").isNotNull(), F.col("model")), F.when(chat & F.col("model").isNotNull(), F.col("seq"))).alias("model"),
        F.coalesce(
            F.max_by(F.when(root, F.col("completion_ref")), F.when(root, F.col("seq"))),
            F.max_by(F.when(any_, F.col("completion_ref")), F.when(any_, F.col("seq"))),
        ).alias("completion_ref"),
        last("exec", "code_ref").alias("code_ref"), last("exec", "stdout_ref").alias("stdout_ref"),
        F.max_by(
            F.when(F.col("call_type") == "exec", F.when(F.col("error").isNotNull(), False).when(F.col("stdout_ref").isNotNull(), True)),
            F.when(F.col("call_type") == "exec", F.col("seq")),
        ).alias("ok"),
        listed("tool", "tool").alias("tools"), listed("emit", "action").alias("emits"), listed("note", "verdict").alias("verdicts"),
    )


def running(events: DataFrame, *order: str) -> DataFrame:
    """Running cost, tokens and iterations of each run."""
    w = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("cost_so_far", F.sum("cost_usd").over(w)).withColumn("tokens_so_far", F.sum("tokens").over(w)).withColumn(
        "iterations", F.count("*").over(w)
    )


def stop_reason(
    iterations: Column, tokens: Column, cost: Column, caps: tuple[int, int, float] = (MAX_ITERATIONS, MAX_TOKENS, MAX_COST_USD),
    backtracks: Column | None = None, most_backtracks: int = MAX_BACKTRACKS,
) -> Column:
    """The first cap that is used up, in fixed order; null while all hold."""
    out = F.when(iterations >= caps[0], "iterations").when(tokens >= caps[1], "tokens").when(cost >= caps[2], "cost")
    return out if backtracks is None else out.when(backtracks >= most_backtracks, "backtracks")


def heartbeat(runs: DataFrame, now: Column, stale_s: int = HEARTBEAT_STALE_S) -> DataFrame:
    """``status`` of runs (``status, last_event``): running ones without a sign
    of life for longer than ``stale_s`` are interrupted."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_event").cast("timestamp"))
    return runs.withColumn("age_s", age).withColumn("status", F.when((F.col("status") == "running") & (age > stale_s), "interrupted").otherwise(F.col("status")))


def tool_cache(events: DataFrame) -> DataFrame:
    """The last recorded result of each tool and argument hash, errors left out."""
    good = events.where("call_type = 'tool' and error is null and result_ref is not null")
    return good.groupBy("run_id", "tool", "args_hash").agg(F.max_by("result_ref", "seq").alias("result_ref"), F.max("seq").alias("seq"))


def refs(events: DataFrame, columns: tuple[str, ...] = REFS) -> DataFrame:
    found = events.select("run_id", F.explode(F.array(*[F.col(c) for c in columns])).alias("ref")).where("ref is not null")
    return found.distinct()


def with_blobs(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.withColumn("ref", F.concat(F.lit("sha256:"), F.sha2(column, 256)))


def new_blobs(texts: DataFrame, stored: DataFrame, column: str = "text") -> DataFrame:
    """Content-addressed texts that are not stored yet, each once."""
    rows = with_blobs(texts, column).select("ref", F.col(column).alias("text")).dropDuplicates(["ref"])
    return rows.join(stored.select("ref"), "ref", "left_anti")


def blob_status(blobs: DataFrame) -> DataFrame:
    """ok, repaired (line ends only) or corrupt, by the hash in ``ref``."""
    wanted = F.regexp_replace("ref", "^sha256:", "")
    fixed = F.regexp_replace("text", "\r\n", "\n")
    status = F.when(F.sha2("text", 256) == wanted, "ok").when(F.sha2(fixed, 256) == wanted, "repaired").otherwise("corrupt")
    return blobs.withColumn("status", status)


def rebuild(events: DataFrame) -> DataFrame:
    """State of each run at its end, as one that goes on would see it.

    The last good root chat's request replaces all messages before
    (``prompt_ref``); what follows is ``messages``: its completion, then one user
    message for each execution. ``last_seq`` is the step after the last, of all
    events; ``budget`` the last that an event's ``extra`` holds; ``emits`` (by
    variable) and ``tool_results`` (by tool and argument hash) have the last
    good reference. Without a chat, the executions alone are the messages.
    """
    good = F.col("error").isNull()
    root = F.when((F.col("call_type") == "chat") & (F.col("actor") == "root") & good, F.col("seq"))
    marked = events.withColumn("chat_seq", F.max(root).over(Window.partitionBy("run_id")))
    after = F.when((F.col("call_type") == "exec") & (F.col("seq") > F.coalesce("chat_seq", F.lit(-1))), F.struct("seq", "stdout_ref", "error"))
    budget = F.get_json_object("extra", "$.budget")
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    outputs = F.transform(
        F.sort_array(F.collect_list(after)),
        lambda e: said("user", F.coalesce(e["stdout_ref"], F.concat(F.lit("[block failed: "), e["error"], F.lit("]")), F.lit("[block interrupted; effects unknown]"))),
    )
    state = marked.groupBy("run_id").agg(
        F.coalesce(F.max("step_idx") + 1, F.lit(0)).alias("last_seq"), F.max_by("prompt_ref", root).alias("prompt_ref"),
        F.max_by("completion_ref", root).alias("completion_ref"), outputs.alias("outputs"),
        F.max_by(budget, F.when(budget.isNotNull(), F.col("seq"))).alias("budget"),
    )
    own = F.filter(F.array(said("assistant", F.col("completion_ref"))), lambda m: m["content"].isNotNull())
    state = state.withColumn("messages", F.concat(own, "outputs")).drop("outputs")

    def last_of(kind: str, key: Column, name: str) -> DataFrame:
        rows = events.where((F.col("call_type") == kind) & good & F.col("result_ref").isNotNull()).withColumn("_k", key).where("_k is not null")
        last = rows.groupBy("run_id", "_k").agg(F.max_by("result_ref", "seq").alias("_v"))
        return last.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(name))

    emits = last_of("emit", F.get_json_object("extra", "$.var"), "emits")
    tools = last_of("tool", F.concat("tool", F.lit(":"), "args_hash"), "tool_results")
    return state.join(emits, "run_id", "left").join(tools, "run_id", "left")


def compaction(
    messages: DataFrame, trigger: int, target: int, key: str = "conv_id", order: str = "turn", tokens: str = "tokens",
    system_tokens: int = 0, start: Column | None = None,
) -> DataFrame:
    """First message that stays, for conversations over the trigger: the longest
    suffix within the target, and the newest message whatever it costs.

    ``start`` is where the conversation began before; it never moves back, and
    not at all while what it keeps, with the system's tokens, is within the trigger.
    """
    total = Window.partitionBy(key)
    back = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = messages.withColumn("newest", F.max(order).over(total))
    if start is not None:
        rows = rows.where(F.col(order) >= F.least(F.coalesce(start, F.col(order)), F.col("newest")))
    rows = rows.withColumn("total", F.sum(tokens).over(total) + system_tokens).withColumn("suffix", F.sum(tokens).over(back) + system_tokens)
    keep = (F.col("total") <= trigger) | (F.col("suffix") <= target) | (F.col(order) == F.col("newest"))
    return rows.groupBy(key).agg(F.min(F.when(keep, F.col(order))).alias("start"), F.max("total").alias("total"))


def budget_select(items: Column, budget: int) -> Column:
    """Positions of an ordered array of ``struct<pos, cost>`` that fit: one that
    is too large is passed over, not the end."""
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<int>").alias("kept"))
    end = F.aggregate(
        items, start,
        lambda s, x: F.when(
            x["cost"] <= s["left"],
            F.struct((s["left"] - x["cost"]).cast("long").alias("left"), F.concat(s["kept"], F.array(x["pos"].cast("int"))).alias("kept")),
        ).otherwise(s),
    )
    return end["kept"]


def evidence_cap(items: Column, per_item: int, total: int) -> Column:
    """Ordered texts cut to ``per_item`` characters, and in all to ``total``,
    where the list ends."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def add(s: Column, x: Column) -> Column:
        cut = F.substring(x, F.lit(1), F.least(F.lit(per_item), F.lit(total) - s["used"]))
        return F.when(s["used"] >= total, s).otherwise(
            F.struct((s["used"] + F.length(cut)).alias("used"), F.concat(s["kept"], F.array(cut)).alias("kept"))
        )

    return F.aggregate(items, start, add)["kept"]


def cited_evidence(items: Column, most: int = EVIDENCE_CHUNKS, per_item: int = EVIDENCE_CHUNK_CHARS, total: int = EVIDENCE_TOTAL_CHARS) -> Column:
    """``kept`` texts of ``struct<mentions, pos, text>``, most mentioned first, and
    whether anything was ``truncated``: items, ends of texts, or what came after ``total``."""
    ranked = F.array_sort(items, lambda a, b: F.when(a["mentions"] != b["mentions"], (b["mentions"] - a["mentions"]).cast("int")).otherwise((a["pos"] - b["pos"]).cast("int")))
    texts = F.transform(ranked, lambda x: F.coalesce(x["text"], F.lit("")))
    kept = evidence_cap(F.slice(texts, 1, most), per_item, total)
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return F.struct(kept.alias("kept"), (size(kept) < size(texts)).alias("truncated"))


def first_not_null(*columns: str) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), [F.col(c) for c in columns])
