"""Retrieval metrics, agreement, intervals, thresholds and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import CREDIT_FEE
from evidentia.functions import text as X


def gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def score_queries(rankings: DataFrame, qrels: DataFrame, k: int = 10, wide: int = 100) -> DataFrame:
    """Metrics of each config and judged query.

    ``rankings``: config, query_id, rank (from 1), doc_id; ``qrels``: query_id,
    doc_id, rel. Every config is scored on every judged query: one that it did
    not answer scores zero. Unjudged documents count as not relevant.
    """
    ideal = qrels.where("rel > 0").withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")))
    judged = qrels.select("query_id").distinct().join(
        ideal.groupBy("query_id").agg(
            F.sum(F.when(F.col("p") <= k, gain(F.col("rel")) / F.log2(F.col("p") + 1))).alias("idcg"), F.count("*").alias("relevant")
        ),
        "query_id", "left",
    )
    cells = rankings.select("config").distinct().join(judged, how="cross")
    hits = rankings.join(qrels.where("rel > 0"), ["query_id", "doc_id"]).groupBy("config", "query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("rel")) / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count_if(F.col("rank") <= k).alias("top"), F.count_if(F.col("rank") <= wide).alias("within"), F.min("rank").alias("first"),
    )
    zero = F.lit(0.0)
    return cells.join(hits, ["config", "query_id"], "left").select(
        "config", "query_id",
        F.coalesce(F.try_divide("dcg", "idcg"), zero).alias("ndcg"),
        F.coalesce(F.try_divide("within", "relevant"), zero).alias("recall"),
        F.coalesce(F.try_divide("top", "relevant"), zero).alias("recall_k"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), zero).alias("rr"),
        (F.coalesce("top", F.lit(0)) / F.lit(float(k))).alias("precision"),
    )


def score_config(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("config").agg(
        F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in ("ndcg", "recall", "recall_k", "rr", "precision")]
    )


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two binary raters; NaN where it is not defined."""
    pa, pb = F.avg(a), F.avg(b)
    seen, chance = F.avg((F.col(a) == F.col(b)).cast("double")), pa * pb + (1 - pa) * (1 - pb)
    value = F.when((F.count("*") == 0) | (chance >= 1), F.lit(float("nan"))).otherwise(F.try_divide(seen - chance, 1 - chance))
    return pairs.agg(F.count("*").alias("n"), value.alias("kappa"))


#: Decision rules over an aggregate and a claim score.
RULES = ("aggregate", "claim", "both")
THRESHOLDS = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9)
CLAIM_THRESHOLD = 0.7


def accepts(rule: Column, aggregate: Column, claim: Column, tau: Column, tau_claim: float = CLAIM_THRESHOLD) -> Column:
    """A missing aggregate never rejects."""
    by_aggregate = aggregate.isNull() | (aggregate < tau)
    by_claim = claim < F.when(rule == "claim", tau).otherwise(F.lit(tau_claim))
    return F.when(rule == "aggregate", by_aggregate).when(rule == "claim", by_claim).otherwise(by_aggregate & by_claim)


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS, rules: Sequence[str] = RULES) -> DataFrame:
    """Confusion counts and rates of ``truth, aggregate, claim`` at each rule and threshold."""
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(t)).alias("tau")) for r in rules for t in thresholds]))
    cells = rows.withColumn("g", grid).select("truth", "g.*", accepts(F.col("g.rule"), F.col("aggregate"), F.col("claim"), F.col("g.tau")).alias("ok"))
    t, ok = F.col("truth") == 1, F.col("ok")
    out = cells.groupBy("rule", "tau").agg(
        F.count_if(t & ok).alias("tp"), F.count_if(t & ~ok).alias("fn"), F.count_if(~t & ok).alias("fp"), F.count_if(~t & ~ok).alias("tn")
    )
    return (
        out.withColumn("tpr", F.try_divide("tp", F.col("tp") + F.col("fn")))
        .withColumn("tnr", F.try_divide("tn", F.col("tn") + F.col("fp")))
        .withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))
        .withColumn("pass_rate", F.try_divide(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))
    )


def choose(sweep: DataFrame, least_pass: float = 0.25, least_tpr: float = 0.5, least_tnr: float = 0.6) -> DataFrame:
    """The best cell within the constraints: by precision, then TNR, then order."""
    fit = sweep.where((F.col("pass_rate") >= least_pass) & (F.col("tpr") >= least_tpr) & (F.col("tnr") >= least_tnr))
    return fit.orderBy(F.desc("precision"), F.desc("tnr"), "rule", "tau").limit(1)


def stratified(rows: DataFrame, stratum: str, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows, ``max(1, round(n * share))`` of each stratum, by hash: cut to
    ``n`` if these are more, and topped up in the same order if they are fewer."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    total = rows.agg(F.count("*").alias("_all"))
    sized = rows.join(rows.groupBy(stratum).agg(F.count("*").alias("_size")), stratum).join(total, how="cross")
    ranked = sized.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    quota = F.greatest(F.lit(1), F.round(n * F.col("_size") / F.col("_all")))
    within = ranked.withColumn("_late", F.col("_r") > quota).withColumn("_o", order)
    return within.orderBy("_late", "_o", key).limit(n).drop("_r", "_o", "_late", "_size", "_all")


#: Bands of scores for calibration: half open, the last one closed by its bound.
BANDS = ((0.0, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 1.01))


def band(score: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(BANDS))):
        out = F.when((score >= low) & (score < high), F.lit(i)).otherwise(out)
    return out


def per_stratum(rows: DataFrame, stratum: Column, k: int, seed: int, key: str) -> DataFrame:
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    ranked = rows.withColumn("stratum", stratum).withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy(order, key)))
    return ranked.where(F.col("_r") <= k).drop("_r")


def mean_sd(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and sample deviation, zero of one value; NaN and null are left out."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return good.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")
    )


def pooled_sd(groups: DataFrame, sd: str = "sd") -> DataFrame:
    return groups.agg(F.sqrt(F.avg(F.col(sd) * F.col(sd))).alias("pooled_sd"))


def triple_precision(rows: DataFrame) -> DataFrame:
    """Strict precision of relation, types and whole triples, with intervals,
    by relation and over all (null)."""
    whole = F.col("relation_ok") & F.col("head_ok") & F.col("tail_ok")
    out = rows.withColumn("triple_ok", whole).rollup("relation").agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("relation_ok", "head_ok", "tail_ok", "triple_ok")]
    )
    low, high = X.wilson(F.col("triple_ok"), F.col("n"))
    return out.withColumn("precision", F.try_divide("triple_ok", "n")).withColumn("low", low).withColumn("high", high)


def lenient_types(rows: DataFrame) -> DataFrame:
    """Type flags (``head_ok, tail_ok``) that let a benchmark be a Dataset or a Method."""
    from evidentia.operators.graph import is_benchmark

    def flag(side: str) -> Column:
        return F.col(f"{side}_ok") | (is_benchmark(F.col(side)) & F.col(f"{side}_type").isin("Dataset", "Method"))

    return rows.withColumns({f"{side}_ok": flag(side) for side in ("head", "tail")})


def entity_recall_by_type(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Of each gold type: entities, those found, and those found with their type."""
    g = gold.select("chunk", X.fold("name").alias("name"), "type").dropDuplicates(["chunk", "name"])
    p = predicted.select("chunk", X.fold("name").alias("name"), F.col("type").alias("_t")).dropDuplicates(["chunk", "name"])
    out = g.join(p, ["chunk", "name"], "left").groupBy("type").agg(
        F.count("*").alias("gold"), F.count("_t").alias("untyped"), F.count_if(F.col("_t") == F.col("type")).alias("typed")
    )
    return out.withColumn("recall", X.rate(F.col("untyped"), F.col("gold"))).withColumn("typed_recall", X.rate(F.col("typed"), F.col("gold")))


def confusion_intervals(sweep: DataFrame) -> DataFrame:
    """Wilson bounds of the true positive and negative rates of each cell."""
    for rate, hit, miss in (("tpr", "tp", "fn"), ("tnr", "tn", "fp")):
        low, high = X.wilson(F.col(hit), F.col(hit) + F.col(miss))
        sweep = sweep.withColumn(f"{rate}_low", low).withColumn(f"{rate}_high", high)
    return sweep


def entity_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Recall and precision of (chunk, folded name), typed and not."""
    g = gold.select("chunk", X.fold("name").alias("name"), F.col("type").alias("g_type")).dropDuplicates(["chunk", "name"])
    p = predicted.select("chunk", X.fold("name").alias("name"), F.col("type").alias("p_type")).dropDuplicates(["chunk", "name"])
    both = g.join(p, ["chunk", "name"], "full")
    hit, typed = F.col("g_type").isNotNull() & F.col("p_type").isNotNull(), F.col("g_type") == F.col("p_type")
    out = both.agg(
        F.count("g_type").alias("gold"), F.count("p_type").alias("predicted"), F.count_if(hit).alias("untyped"), F.count_if(typed).alias("typed")
    )
    return out.select(
        "*", X.rate(F.col("untyped"), F.col("gold")).alias("recall"), X.rate(F.col("typed"), F.col("gold")).alias("typed_recall"),
        X.rate(F.col("untyped"), F.col("predicted")).alias("precision"), X.rate(F.col("typed"), F.col("predicted")).alias("typed_precision"),
    )


def job_matrix(arms: DataFrame, queries: DataFrame, repeats: int) -> DataFrame:
    """Arms by queries by repeats, with merged settings: the query's win."""
    merged = F.map_from_entries(
        F.concat(
            F.filter(F.map_entries("arm_env"), lambda e: ~F.map_contains_key(F.col("query_env"), e["key"])), F.map_entries("query_env")
        )
    )
    return arms.join(queries, how="cross").select(
        "arm", "query_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"), merged.alias("env")
    )


def cost_rollup(cells: DataFrame, fee: float = CREDIT_FEE, companions: DataFrame | None = None) -> DataFrame:
    """Runs and cost of each arm and of all (null); runs beside the campaign are an arm of their own."""
    if companions is not None:
        cells = cells.select("arm", "cost").unionByName(companions.select(F.lit("companions").alias("arm"), "cost"))
    return cells.rollup("arm").agg(F.count("*").alias("runs"), F.sum("cost").alias("cost"), (F.sum("cost") * fee).alias("with_fee"))


def arm_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arm").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def usable(status: Column, stop: Column, answer: Column) -> Column:
    return (F.trim(F.coalesce(answer, F.lit(""))) != "") & (status != "failed") & (stop != "error")


#: What an answer may say of two frequencies.
FREQUENCIES = ("more common", "less common", "same frequency")


def oolong_answer(answer: Column) -> Column:
    """What a reply answers: the part behind its last colon without marks, or the
    phrase about frequencies in a long one; without a colon the reply if it is
    short, else its last word."""
    text = F.coalesce(answer, F.lit(""))
    behind = F.regexp_replace(F.regexp_replace(F.substring_index(text, ":", -1), r"^\s+|\s+$", ""), r"[*\[\]]", "")
    long = F.lit(None).cast("string")
    for phrase in reversed(FREQUENCIES):
        long = F.when(F.contains(behind, F.lit(phrase)), phrase).otherwise(long)
    last = F.regexp_extract(text, r"(\S+)\s*$", 1)
    return F.when(~F.contains(text, F.lit(":")), F.when(F.length(text) < 20, text).otherwise(last)).when(
        F.length(behind) < 20, behind
    ).otherwise(F.coalesce(long, behind))


def oolong_score(answer: Column, gold: Column, kind: Column) -> Column:
    """1 of the gold answer, or of the phrase about frequencies that it holds;
    whole numbers lose a quarter for each step away."""
    said = oolong_answer(answer)
    whole = lambda c: F.when(c.rlike(r"^\s*[-+]?\d+\s*$"), F.trim(c).try_cast("long"))
    steps = F.abs(whole(said) - whole(gold))
    numeric = F.when((kind == "numeric") & steps.isNotNull(), F.pow(F.lit(0.75), steps)).otherwise(0.0)
    phrase = F.contains(gold, said).cast("double")
    return F.when(said == gold, 1.0).when(said.isin(*FREQUENCIES), F.coalesce(phrase, F.lit(0.0))).otherwise(numeric)


def pool(rankings: DataFrame, depth: int = 10) -> DataFrame:
    return rankings.where(F.col("rank") <= depth).select("query_id", "doc_id").distinct()


def frozen_drift(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """Fields (``field, key, value``) that differ, or are on one side only."""
    both = now.withColumnRenamed("value", "now").join(frozen.withColumnRenamed("value", "frozen"), ["field", "key"], "full")
    return both.where(~F.col("now").eqNullSafe(F.col("frozen")))
