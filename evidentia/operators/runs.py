"""Runs as rows: replay, evidence over time, contracts, campaigns, tasks, blobs, ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X


def _zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def replay_summary(turns: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Header numbers of each run, from its turns (``eventlog.turns``).

    ``cost_usd`` is of chats and judge calls, ``chat_cost_usd`` and the tokens of
    chats alone. ``missing_refs`` counts references of turns that are not among
    ``blobs`` (``ref``); 0 without them.
    """
    verdict = lambda v: F.sum(F.size(F.filter("verdicts", lambda x: x == v)))
    spent = ("tokens_in", "tokens_out", "cached_tokens", "reasoning_tokens", "jev_tokens_in")
    out = turns.groupBy("run_id").agg(
        F.count("*").alias("turns"), *[F.sum(_zero(c)).alias(c) for c in spent],
        F.sum(_zero("cost_usd") + _zero("judge_cost_usd")).alias("cost_usd"), F.sum(_zero("cost_usd")).alias("chat_cost_usd"),
        F.sum(F.size("tools")).alias("tool_calls"), F.sum("sub_tasks").alias("sub_tasks"),
        F.count_if(F.col("code_ref").isNotNull()).alias("code_blocks"), F.sum(F.size("emits")).alias("emits"),
        verdict("pass").alias("gates_passed"), verdict("fail").alias("gates_failed"),
    )
    calls = turns.select("run_id", F.explode("sub_calls").alias("_c")).groupBy("run_id").agg(F.count_distinct("_c").alias("_calls"))
    out = out.join(calls, "run_id", "left").withColumn("sub_calls", _zero("_calls")).drop("_calls")
    if blobs is None:
        return out.withColumn("missing_refs", F.lit(0).cast("long"))
    named = turns.select("run_id", "step_idx", F.explode("refs").alias("ref"))
    lost = named.join(blobs.select("ref").distinct(), "ref", "left_anti").groupBy("run_id").agg(F.count("*").alias("_lost"))
    return out.join(lost, "run_id", "left").withColumn("missing_refs", _zero("_lost")).drop("_lost")


def evidence_upto(evidence: DataFrame, cursor: int, key: str = "chunk_uuid") -> DataFrame:
    """Rows (``run_id, step_idx, pos``, key) of steps up to a cursor, each key once, where it came first."""
    order = Window.partitionBy("run_id", key).orderBy("step_idx", "pos")
    seen = evidence.where(F.col("step_idx") <= cursor).withColumn("_r", F.row_number().over(order))
    return seen.where("_r = 1").drop("_r")


def round_robin(chunks: DataFrame, most: int, per_text: int, group: str = "run_id", paper: str = "arxiv_id", order: str = "pos", text: str = "chunk_text") -> DataFrame:
    """A sample of each group's chunks that takes papers in turn, in order of their
    first chunk, until ``most`` characters are used; texts are collapsed and cut."""
    cut = chunks.withColumn("sample", F.substring(X.collapse(F.coalesce(text, F.lit(""))), 1, per_text))
    by_paper = Window.partitionBy(group, paper)
    ranked = cut.withColumn("depth", F.row_number().over(by_paper.orderBy(order))).withColumn("_first", F.min(order).over(by_paper))
    turn = Window.partitionBy(group).orderBy("depth", "_first", paper).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("sample")).over(turn), F.lit(0))
    return ranked.withColumn("used", used).where((F.col("used") < most) & (F.col("sample") != "")).drop("_first")


def list_runs(manifests: DataFrame, status: str | None = None) -> DataFrame:
    """Runs by last change, the newest first; ties by id."""
    rows = manifests if status is None else manifests.where(F.col("status") == status)
    return rows.orderBy(F.desc("updated_at"), "run_id")


def zipped(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """The k-th row of ``left`` with the k-th of ``right`` in each group: answers
    and the requests that they belong to. What has no partner is left out."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return left.withColumn("place", number).join(right.withColumn("place", number).drop(order), [by, "place"])


def status_counts(rows: DataFrame, by: str, status: str, values: Sequence[str], cost: str | None = None) -> DataFrame:
    """Rows of each group by status, others apart, and their cost."""
    named = [F.count_if(F.col(status) == v).alias(v) for v in values]
    other = F.count_if(~F.coalesce(F.col(status).isin(*values), F.lit(False))).alias("other")
    spent = [F.sum(_zero(cost)).alias("cost")] if cost else []
    return rows.groupBy(by).agg(F.count("*").alias("n"), *named, other, *spent)


def campaign_rows(jobs: DataFrame, **artefacts: DataFrame) -> DataFrame:
    """One wide row for each job: every artefact (one row a ``run_id``) by its
    name, null where a run left none; ``note`` lists what is missing."""
    out, missing = jobs, []
    for name, table in artefacts.items():
        has = f"_{name}"
        out = out.join(table.select("run_id", *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != "run_id"], F.lit(True).alias(has)), "run_id", "left")
        missing.append(F.when(F.col(has).isNull(), F.lit(f"no {name}")))
    return out.withColumn("note", F.array_join(F.array_compact(F.array(*missing)), ", ")).drop(*[f"_{name}" for name in artefacts])


#: Call types that a run of each shape has to have.
RUN_SHAPES: Mapping[str, Sequence[str]] = {"loop": ("chat", "exec", "tool"), "flat": ("chat",)}


def run_contract(runs: DataFrame, shapes: Mapping[str, Sequence[str]] = RUN_SHAPES, tolerance: float = 1e-9) -> DataFrame:
    """Checks that a finished run has to pass, and whether it passes ``ok``.

    ``runs``: run_id, shape, status, manifest_cost, log_cost, call_types (array),
    answer, open_tasks, unresolved, containers. A null fails its check.
    """
    needs = F.lit(False)
    for shape, types in shapes.items():
        needs = F.when(F.col("shape") == shape, F.size(F.array_except(F.array(*[F.lit(t) for t in types]), "call_types")) == 0).otherwise(needs)
    checks = {
        "finished": F.col("status") == "done", "cost_agrees": F.abs(F.col("manifest_cost") - F.col("log_cost")) <= tolerance, "events_complete": needs,
        "answered": F.trim("answer") != "", "tasks_closed": F.col("open_tasks") == 0, "citations_resolved": F.col("unresolved") == 0, "nothing_running": F.col("containers") == 0,
    }
    out = runs.select("run_id", *[F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()])
    whole = F.lit(True)
    for name in checks:
        whole = whole & F.col(name)
    return out.withColumn("ok", whole)


def tool_usage(events: DataFrame, tool: str, notes: str) -> DataFrame:
    """Of each run: good and failed calls of a tool, distinct results, its last result, notes of a kind."""
    mine, good = F.col("tool") == tool, F.col("error").isNull()
    is_call = (F.col("call_type") == "tool") & mine
    return events.groupBy("run_id").agg(
        F.count_if(is_call & good).alias("builds"), F.count_if(is_call & ~good).alias("failed"),
        F.count_distinct(F.when(is_call & good, F.col("result_ref"))).alias("results"),
        F.max_by(F.when(is_call & good, F.col("result_ref")), F.when(is_call & good, F.col("seq"))).alias("last_result"),
        F.count_if(F.col("call_type") == notes).alias("notes"),
    )


def task_snapshot(updates: DataFrame, *order: str) -> DataFrame:
    """Tasks of each run in the order of their first update: the last status that
    one gave, tokens of all, evidence once each in order (``evidence_ref``)."""
    at = F.struct(*order)
    rows = updates.groupBy("run_id", "task_id").agg(
        F.min(at).alias("_first"), F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), F.count("*").alias("attempts"),
        F.sum(_zero("tokens")).alias("tokens"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("evidence_ref").isNotNull(), F.struct(at.alias("at"), F.col("evidence_ref").alias("ref"))))), lambda x: x["ref"])).alias("evidence"),
    )
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("_first", "task_id"))
    return rows.withColumn("place", place).drop("_first")


def load_blobs(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """``refs`` (``ref``) with their texts, null where the blob is gone."""
    return refs.join(blobs.select("ref", "text").dropDuplicates(["ref"]), "ref", "left")


def bundle_status(refs: DataFrame, blobs: DataFrame, secrets: str | None = None) -> DataFrame:
    """Of each run (``run_id, ref``): referenced blobs, how many are missing or do
    not fit their hash, how many hold a secret (a pattern), and whether it may be
    exported or installed."""
    named = refs.select("run_id", "ref").distinct()
    have = blobs.select("ref", "text").dropDuplicates(["ref"]).withColumn("_ok", F.concat(F.lit("sha256:"), F.sha2("text", 256)) == F.col("ref"))
    rows = named.join(have, "ref", "left")
    leak = F.coalesce(F.col("text").rlike(secrets), F.lit(False)) if secrets else F.lit(False)
    out = rows.groupBy("run_id").agg(
        F.count("*").alias("refs"), F.count_if(F.col("_ok").isNull()).alias("missing"), F.count_if(F.col("_ok") == F.lit(False)).alias("corrupt"), F.count_if(leak).alias("leaks")
    )
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("corrupt") == 0) & (F.col("leaks") == 0))


def export_bundle(refs: DataFrame, blobs: DataFrame, path: str, secrets: str | None = None) -> None:
    """Write the blobs that runs refer to, each once; refused where one is missing, does not fit its hash or holds a secret."""
    bad = bundle_status(refs, blobs, secrets).where("not ok").select("run_id").limit(5).collect()
    if bad:
        raise ValueError(f"not exported: {', '.join(str(r['run_id']) for r in bad)}")
    load_blobs(refs.select("ref").distinct(), blobs).write.mode("errorifexists").parquet(path)


def import_bundle(bundle: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs (``ref, text``) of a bundle that are not stored yet; one that does not fit its hash is an error."""
    fits = F.concat(F.lit("sha256:"), F.sha2("text", 256)) == F.col("ref")
    checked = bundle.withColumn("text", F.when(fits, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("a blob does not fit "), F.col("ref")))))
    return checked.dropDuplicates(["ref"]).join(stored.select("ref"), "ref", "left_anti")


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Time that is left at the pace so far; null before anything is done."""
    return F.try_divide(elapsed * F.greatest(F.lit(0), total - done), done)


def ledger_rows(ledgers: DataFrame) -> DataFrame:
    """Display rows of ledgers (``run_id, units, frames``): one a frame, then one
    ``uncovered`` for each unit that no frame is of, numbered in that order.

    A frame has unit_index, text, predicate, quote, chunk_id and status.
    """
    blank = F.lit("")
    shown = F.transform(
        "frames",
        lambda f: F.struct(
            F.coalesce(f["status"], blank).alias("status"), F.substring(X.collapse(F.coalesce(f["text"], blank)), 1, 220).alias("claim"), f["predicate"].alias("predicate"),
            F.substring(X.collapse(F.coalesce(f["quote"], blank)), 1, 160).alias("quote"), F.substring(F.coalesce(f["chunk_id"], blank), 1, 8).alias("chunk"),
        ),
    )
    covered = F.transform("frames", lambda f: f["unit_index"])
    empty = F.array_except(F.when(F.col("units") > 0, F.sequence(F.lit(0), F.col("units") - 1)).otherwise(F.array().cast("array<int>")), covered)
    lost = F.transform(
        empty,
        lambda u: F.struct(
            F.lit("uncovered").alias("status"), F.concat(F.lit("unit "), u.cast("string"), F.lit(" produced no frame")).alias("claim"), F.lit(None).cast("string").alias("predicate"),
            blank.alias("quote"), blank.alias("chunk"),
        ),
    )
    return ledgers.select("run_id", F.posexplode(F.concat(shown, lost)).alias("number", "row")).select("run_id", (F.col("number") + 1).alias("number"), "row.*")


def claim_totals(reports: DataFrame) -> DataFrame:
    """Sums over reports (``units, covered, frames`` with a status): frames by status and coverage."""
    status = lambda s: F.sum(F.size(F.filter("frames", lambda f: f["status"] == s))).alias(s)
    out = reports.agg(
        F.count("*").alias("runs"), F.sum("units").alias("units"), F.sum("covered").alias("covered"), F.sum(F.size("frames")).alias("claims"),
        *[status(s) for s in ("grounded", "contradicted", "unverifiable")],
    )
    return out.withColumn("coverage", X.rate(F.col("covered"), F.col("units")))


def distinct_frames(frames: DataFrame, texts: DataFrame) -> DataFrame:
    """One frame for each unit, quote (or claim where there is none) and chunk, of
    those whose chunk has a text; the first by ``frame_index``."""
    quote = X.collapse(F.coalesce("quote", F.lit("")))
    keyed = frames.withColumn("_q", F.when(quote == "", X.collapse(F.coalesce("text", F.lit("")))).otherwise(quote))
    first = Window.partitionBy("run_id", "unit_index", "_q", "chunk_id").orderBy("frame_index")
    have = texts.where(F.coalesce("chunk_text", F.lit("")) != "").select(F.col("chunk_uuid").alias("chunk_id")).distinct()
    return keyed.join(have, "chunk_id", "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_q")


def flagged_claims(scores: DataFrame, least: float = 0.5, most: int = 3, by: str = "run_id") -> DataFrame:
    """The claims (``name, p``) of each run to name: ``least`` and more, the highest first, ties by name."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("p"), "name"))
    return scores.where(F.col("p") >= least).withColumn("place", place).where(F.col("place") <= most)


def judged(answers: DataFrame, facets: Sequence[str], text: str = "reply") -> DataFrame:
    """One row for each run and facet: the verdict that a judge's JSON reply gives, unknown where it gives none."""
    from evidentia.functions.answers import json_in_prose

    body = json_in_prose(F.col(text))
    verdicts = F.array(*[F.struct(F.lit(f).alias("facet"), F.lower(F.trim(F.get_json_object(body, f"$.{f}"))).alias("verdict")) for f in facets])
    rows = answers.select("run_id", F.explode(verdicts).alias("v")).select("run_id", "v.*")
    return rows.withColumn("verdict", F.when(F.col("verdict").isin("pass", "partial", "fail"), F.col("verdict")).otherwise("unknown"))


def sweep_summary(rows: DataFrame) -> DataFrame:
    """Means over queries of each point of a sweep, and its worst cases."""
    mean = lambda c, scale=1: F.round(F.avg(c) / scale, 1)
    return rows.groupBy("k", "n", "c", "c_top").agg(
        F.count("*").alias("queries"), mean("chunks").alias("chunks_mean"), mean("papers_with_chunks").alias("papers_mean"), F.max("papers_without_chunks").alias("starved_worst"),
        F.min("chunks_per_paper_min").alias("chunks_min_worst"), mean("bundle_chars", 1000).alias("kchars_mean"),
    )


def relevance_grid(found: DataFrame, grades: DataFrame, points: Sequence[int], core: int = 2) -> DataFrame:
    """Of each query and depth ``n`` of a ranked result (``query_id, rank, doc_id``):
    recall of the documents of grade ``core`` and more, of all judged ones, and precision."""
    grid = F.explode(F.array(*[F.lit(n) for n in points]))
    judged_ = grades.groupBy("query_id").agg(F.count("*").alias("all_"), F.count_if(F.col("grade") >= core).alias("core_"))
    hits = found.select("query_id", "rank", "doc_id", grid.alias("n")).where("rank <= n").join(grades, ["query_id", "doc_id"], "left")
    per = hits.groupBy("query_id", "n").agg(F.count("*").alias("have"), F.count("grade").alias("hit"), F.count_if(F.col("grade") >= core).alias("hit_core"))
    cells = judged_.select("query_id", "all_", "core_", grid.alias("n"))
    zero = F.lit(0.0)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(_zero(a), F.col(b)), zero), 3)
    return cells.join(per, ["query_id", "n"], "left").select(
        "query_id", "n", share("hit_core", "core_").alias("recall_core"), share("hit", "all_").alias("recall_all"),
        F.round(_zero("hit") / F.greatest(F.lit(1), _zero("have")), 3).alias("precision"),
    )


def rank_of(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Rank of each query's target in its result, null where it is not found."""
    ranks = found.select("query_id", F.col("doc_id").alias("target"), "rank")
    return targets.join(ranks, ["query_id", "target"], "left")


def paper_envelope(papers: DataFrame, chunks: DataFrame, asked: DataFrame, pattern: str, chunk_limit: int = 500, preview: int = 160) -> DataFrame:
    """For each asked-for id (``pos, arxiv_id``): whether it is valid and found, its
    paper without vectors, and previews of its first chunks."""
    order = Window.partitionBy("arxiv_id").orderBy(F.col("section_order").asc_nulls_last(), "chunk_uuid")
    wanted = asked.select("pos", F.trim("arxiv_id").alias("arxiv_id"))
    scoped = chunks.join(wanted.select("arxiv_id").distinct(), "arxiv_id", "left_semi")
    listed = scoped.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= chunk_limit).groupBy("arxiv_id").agg(
        F.sort_array(F.collect_list(F.struct("_r", "chunk_uuid", "section_type", F.substring("chunk_text", 1, preview).alias("preview"), F.length("chunk_text").alias("chars")))).alias("chunks")
    )
    known = papers.drop("abstract_embedding")
    found = known.select("arxiv_id", F.struct(*[c for c in known.columns if c != "arxiv_id"]).alias("paper"))
    out = wanted.join(found, "arxiv_id", "left").join(listed, "arxiv_id", "left")
    status = F.when(~F.col("arxiv_id").rlike(pattern), "invalid").when(F.col("paper").isNotNull(), "found").otherwise("missing")
    return out.select("pos", "arxiv_id", status.alias("status"), "paper", F.coalesce("chunks", F.array().cast(listed.schema["chunks"].dataType)).alias("chunks"))


def corpus_counts(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows and vectors of both tables."""
    one = lambda df, name, vector: df.agg(F.count("*").alias("n"), F.count(vector).alias("vectors")).select(F.lit(name).alias("kind"), "n", "vectors")
    return one(papers, "papers", "abstract_embedding").unionByName(one(chunks, "chunks", "chunk_embedding"))


def line_records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``rec-0000`` and so on: the lines of each document that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return docs.select(key, F.posexplode(lines).alias("pos", "text")).select(
        key, "pos", F.format_string("rec-%04d", "pos").alias("id"), F.trim("text").alias("text")
    )


def score_means(rows: DataFrame, *by: str) -> DataFrame:
    """Means of usable rows (``usable, score``) along each column by itself, and how many are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("?")).alias("name")) for c in by]))
    return rows.select(cells.alias("c"), "usable", "score").groupBy("c.kind", "c.name").agg(
        F.count_if("usable").alias("n"), F.avg(F.when(F.col("usable"), F.col("score"))).alias("mean"), F.count_if(~F.col("usable")).alias("excluded")
    )


def truth_by_status(rows: DataFrame) -> DataFrame:
    """Labels (supported, not supported, cannot judge) by verifier ``status``, with the rate among those decided and its interval."""
    kept = rows.where(F.col("label").isin("supported", "not supported", "cannot judge")).withColumn("status", F.coalesce("status", F.lit("unknown")))
    out = kept.groupBy("status").agg(*[F.count_if(F.col("label") == v).alias(v.replace(" ", "_")) for v in ("supported", "not supported", "cannot judge")])
    out = out.withColumn("decided", F.col("supported") + F.col("not_supported"))
    low, high = X.wilson(F.col("supported"), F.col("decided"))
    return out.withColumn("rate", X.rate(F.col("supported"), F.col("decided"))).withColumn("low", F.round(low, 4)).withColumn("high", F.round(high, 4))


def claim_summary(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Means of each arm over what is measured (``missing`` rows and nulls left out), and ledgers by status."""
    use = ~F.col("missing")
    return rows.groupBy("arm").agg(
        F.count("*").alias("runs"), F.count_if(use).alias("usable"), *[F.round(F.avg(F.when(use, F.col(m))), 4).alias(m) for m in measures],
        *[F.count_if(F.col("ledger") == s).alias(s) for s in ("ok", "stale", "empty", "missing_ledger")],
    )


def targets(metadata: DataFrame, candidate: Column, limit: int | None = None) -> DataFrame:
    """``id, version`` of records to fetch, in order of their id, the first ``limit``."""
    rows = metadata.where(candidate & F.col("id").isNotNull() & (F.size("versions") > 0))
    out = rows.select("id", F.element_at("versions", -1)["version"].alias("version"))
    return out.orderBy("id").limit(limit) if limit is not None else out


def cursor(chunks: DataFrame, section_types: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` chunks of some section types, by id."""
    return chunks.where(F.col("section_type").isin(*section_types)).orderBy("chunk_uuid").limit(limit)
