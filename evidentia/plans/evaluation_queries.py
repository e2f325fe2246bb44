"""Group E: metrics, agreement, thresholds, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions.vectors import topk_many
from evidentia.operators import evaluation as E
from evidentia.sources.corpus import query_vectors, table


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configs: the nearest ten vectors, and the first ten by a hash."""
    vectors = table(spark, sf_dir, "embeddings")
    dense = topk_many(vectors, query_vectors(spark, sf_dir), 10, id_="vec_id").select(F.lit("dense").alias("config"), "query_id", "rank", F.col("vec_id").alias("doc_id"))
    size = F.lit(max(1, vectors.count()))
    plain = query_vectors(spark, sf_dir).where("query_id % 100 <> 0").select("query_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")).select(
        F.lit("plain").alias("config"), "query_id", "rank", ((F.col("query_id") * 13 + F.col("rank") * 7) % size).alias("doc_id")
    )
    return dense.unionByName(plain)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged are the 30 nearest and the plain list of each query: equal labels
    are relevant, and twice so with a good document of that id."""
    vectors = table(spark, sf_dir, "embeddings")
    near = topk_many(vectors, query_vectors(spark, sf_dir), 30, id_="vec_id").select("query_id", F.col("vec_id").alias("doc_id"))
    plain = rankings(spark, sf_dir).where("config = 'plain'").select("query_id", "doc_id")
    judged = near.unionByName(plain).distinct().where("doc_id <> query_id")
    v = vectors.select(F.col("vec_id").alias("doc_id"), "label")
    q = query_vectors(spark, sf_dir).select("query_id", "query_label")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("_g", F.lit(1))
    return judged.join(v, "doc_id").join(q, "query_id").join(good, "doc_id", "left").select(
        "query_id", "doc_id", F.when(F.col("label") == F.col("query_label"), 1 + F.coalesce("_g", F.lit(0))).otherwise(0).alias("rel")
    )


RANKED = """sims AS (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0
), near AS (
  SELECT query_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, doc_id) AS rank FROM sims) WHERE rank <= 30
), rankings AS (
  SELECT 'dense' AS config, query_id, rank, doc_id FROM near WHERE rank <= 10
  UNION ALL SELECT 'plain', query_id, rank, (query_id * 13 + rank * 7) % (SELECT count(*) FROM embeddings)
    FROM (SELECT vec_id AS query_id, unnest(generate_series(1, 10)) AS rank FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 100 <> 0)
), judged AS (
  SELECT query_id, doc_id FROM near UNION SELECT query_id, doc_id FROM rankings WHERE config = 'plain'
), qrels AS (
  SELECT query_id, j.doc_id, CASE WHEN e.label = q.label THEN 1 + CASE WHEN j.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END ELSE 0 END AS rel
  FROM judged j JOIN embeddings e ON j.doc_id = e.vec_id JOIN embeddings q ON j.query_id = q.vec_id WHERE j.doc_id <> query_id
), ideal AS (
  SELECT query_id, count(*) FILTER (rel > 0) AS relevant, sum(CASE WHEN rel > 0 AND p <= 10 THEN (pow(2, rel) - 1) / log2(p + 1) END) AS idcg FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS p FROM qrels) GROUP BY query_id
), hits AS (
  SELECT config, r.query_id, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg, count(*) AS top, min(rank) AS first
  FROM rankings r JOIN qrels j ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE rel > 0 GROUP BY config, r.query_id
), scored AS (
  SELECT c.config, i.query_id, coalesce(dcg / idcg, 0) AS ndcg, coalesce(top / nullif(relevant, 0), 0) AS recall, coalesce(top / nullif(relevant, 0), 0) AS recall_k,
    coalesce(1.0::DOUBLE / first, 0) AS rr, coalesce(top, 0) / 10.0::DOUBLE AS precision
  FROM (SELECT DISTINCT config FROM rankings) c CROSS JOIN ideal i LEFT JOIN hits h ON h.config = c.config AND h.query_id = i.query_id
)"""
_METRICS = ("ndcg", "recall", "recall_k", "rr", "precision")


def e_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.score_queries(rankings(spark, sf_dir), qrels(spark, sf_dir))
    return s.select("config", "query_id", F.round("ndcg", 6).alias("ndcg"))


E_NDCG = f"WITH {RANKED} SELECT config, query_id, round(ndcg, 6) AS ndcg FROM scored"


def e_recall_mrr_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.score_queries(rankings(spark, sf_dir), qrels(spark, sf_dir))
    return s.select("config", "query_id", *[F.round(m, 6).alias(m) for m in _METRICS[1:]])


E_RECALL = f"WITH {RANKED} SELECT config, query_id, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS[1:])} FROM scored"


def e_score_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.score_config(E.score_queries(rankings(spark, sf_dir), qrels(spark, sf_dir)))
    return s.select("config", "queries", *[F.round(m, 6).alias(m) for m in _METRICS])


E_CONFIG = f"WITH {RANKED} SELECT config, count(*) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)} FROM scored GROUP BY config"


def e_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.kappa(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("kappa", F.round("kappa", 6))


E_KAPPA = """SELECT n, round((seen - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM (
  SELECT count(*) AS n, avg(quality) AS a, avg(toxic) AS b, avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END) AS seen FROM labels)"""


def e_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return rows.select("l_suppkey", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_W = "((k / n + 3.8416::DOUBLE / (2 * n)) {s} 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n))) / (1 + 3.8416::DOUBLE / n)"
E_WILSON = f"""SELECT l_suppkey, n, k, round(greatest(0, {_W.format(s='-')}), 6) AS low, round(least(1, {_W.format(s='+')}), 6) AS high FROM (
  SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY l_suppkey)"""


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        "doc_id", F.col("quality").alias("truth"), F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") * 37 % 1000) / 1000).alias("aggregate"),
        ((F.col("n_chars") * 91 % 1000) / 1000).alias("claim"),
    )


GATES = """gates AS (SELECT d.doc_id, quality AS truth, CASE WHEN d.doc_id % 7 <> 0 THEN (n_chars * 37 % 1000) / 1000 END AS aggregate,
  (n_chars * 91 % 1000) / 1000 AS claim FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_TAUS = ", ".join(f"({t}::DOUBLE)" for t in E.THRESHOLDS)
SWEEP = f"""{GATES}, cells AS (
  SELECT rule, tau, truth, CASE WHEN rule = 'aggregate' THEN aggregate IS NULL OR aggregate < tau WHEN rule = 'claim' THEN claim < tau
    ELSE (aggregate IS NULL OR aggregate < tau) AND claim < 0.7::DOUBLE END AS ok
  FROM gates, (VALUES ('aggregate'), ('claim'), ('both')) r(rule), (VALUES {_TAUS}) t(tau)
), counts AS (
  SELECT rule, tau, count(*) FILTER (truth = 1 AND ok) AS tp, count(*) FILTER (truth = 1 AND NOT ok) AS fn, count(*) FILTER (truth <> 1 AND ok) AS fp,
    count(*) FILTER (truth <> 1 AND NOT ok) AS tn FROM cells GROUP BY rule, tau
), sweep AS (
  SELECT *, tp / nullif(tp + fn, 0) AS tpr, tn / nullif(tn + fp, 0) AS tnr, tp / nullif(tp + fp, 0) AS precision, (tp + fp) / (tp + fp + tn + fn) AS pass_rate FROM counts
)"""
_RATES = ("tpr", "tnr", "precision", "pass_rate")


def e_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_sweep(gates(spark, sf_dir)).select("rule", "tau", "tp", "fn", "fp", "tn", *[F.round(r, 6).alias(r) for r in _RATES])


E_SWEEP = f"WITH {SWEEP} SELECT rule, tau, tp, fn, fp, tn, {', '.join(f'round({r}, 6) AS {r}' for r in _RATES)} FROM sweep"


def e_sweep_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = ("tpr_low", "tpr_high", "tnr_low", "tnr_high")
    return E.confusion_intervals(E.threshold_sweep(gates(spark, sf_dir))).select("rule", "tau", *[F.round(c, 6).alias(c) for c in bounds])


_BOUND = "CASE WHEN {n} = 0 THEN 0 ELSE round({cut}({edge}, (({k} / {n} + 3.8416::DOUBLE / (2 * {n})) {s} 1.96::DOUBLE * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416::DOUBLE / (4.0::DOUBLE * {n} * {n}))) / (1 + 3.8416::DOUBLE / {n})), 6) END"
E_INTERVALS = f"WITH {SWEEP} SELECT rule, tau, " + ", ".join(
    _BOUND.format(k=k, n=f"({k} + {m})", cut="greatest" if s == "-" else "least", edge=0 if s == "-" else 1, s=s) + f" AS {name}_{'low' if s == '-' else 'high'}"
    for name, k, m in (("tpr", "tp", "fn"), ("tnr", "tn", "fp")) for s in "-+"
) + " FROM sweep"


def e_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.choose(E.threshold_sweep(gates(spark, sf_dir)), 0.25, 0.3, 0.3).select("rule", "tau", "tp", F.round("precision", 6).alias("precision"))


E_CHOOSE = f"""WITH {SWEEP} SELECT rule, tau, tp, round(precision, 6) AS precision FROM sweep WHERE pass_rate >= 0.25 AND tpr >= 0.3 AND tnr >= 0.3
ORDER BY sweep.precision DESC, tnr DESC, rule, tau LIMIT 1"""


def e_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 60, 7, "doc_id")


E_STRATIFIED = """WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR) || '7') AS o, count(*) OVER (PARTITION BY source) AS size, count(*) OVER () AS total
  FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, doc_id) AS rn FROM d)
SELECT doc_id, source FROM r ORDER BY rn > greatest(1, round(60 * size / total)), o, doc_id LIMIT 60"""


def e_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_stratum(gates(spark, sf_dir), E.band(F.col("claim")), 8, 7, "doc_id").select("doc_id", "stratum")


E_BANDS = f"""WITH {GATES}, b AS (SELECT doc_id, CASE WHEN claim < 0.2 THEN 0 WHEN claim < 0.5 THEN 1 WHEN claim < 0.8 THEN 2 ELSE 3 END AS stratum,
  md5(CAST(doc_id AS VARCHAR) || '7') AS o FROM gates)
SELECT doc_id, CAST(stratum AS INT) AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY o, doc_id) AS r FROM b) WHERE r <= 8"""


def e_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mean_sd(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").select("p_brand", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


E_MEAN = "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 4) AS sd FROM part GROUP BY p_brand"


def e_pooled_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pooled_sd(E.mean_sd(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")).withColumn("pooled_sd", F.round("pooled_sd", 4))


E_POOLED = "SELECT round(sqrt(avg(s * s)), 4) AS pooled_sd FROM (SELECT coalesce(stddev_samp(p_retailprice), 0) AS s FROM part GROUP BY p_brand)"


def e_triple_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_linenumber") % 8).alias("relation"), (F.col("l_partkey") % 5 != 0).alias("relation_ok"),
        (F.col("l_suppkey") % 7 != 0).alias("head_ok"), (F.col("l_quantity") > 6).alias("tail_ok"),
    )
    return E.triple_precision(rows).select("relation", "n", "triple_ok", *[F.round(c, 6).alias(c) for c in ("precision", "low", "high")])


E_TRIPLES = f"""SELECT relation, n, k AS triple_ok, round(k / n, 6) AS precision, round(greatest(0, {_W.format(s='-')}), 6) AS low, round(least(1, {_W.format(s='+')}), 6) AS high
FROM (SELECT relation, count(*) AS n, count(*) FILTER (ok) AS k FROM (SELECT 'r' || (l_linenumber % 8) AS relation,
  l_partkey % 5 <> 0 AND l_suppkey % 7 <> 0 AND l_quantity > 6 AS ok FROM lineitem) GROUP BY ROLLUP (relation))"""


def e_triple_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision where a benchmark may be a dataset or a method, beside the strict one."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("r").alias("relation"), F.lit(True).alias("relation_ok"), (F.col("l_partkey") % 5 != 0).alias("head_ok"), (F.col("l_suppkey") % 7 != 0).alias("tail_ok"),
        F.when(F.col("l_partkey") % 2 == 0, "HotpotQA").otherwise("Net").alias("head"), F.when(F.col("l_linenumber") % 2 == 0, "Dataset").otherwise("Task").alias("head_type"),
        F.lit("BERT").alias("tail"), F.lit("Method").alias("tail_type"),
    )
    strict, kind = E.triple_precision(rows), E.triple_precision(E.lenient_types(rows))
    return strict.where("relation is null").select(F.lit("strict").alias("view"), "n", "triple_ok").unionByName(
        kind.where("relation is null").select(F.lit("lenient").alias("view"), "n", "triple_ok")
    )


E_LENIENT = """SELECT 'strict' AS view, count(*) AS n, count(*) FILTER (l_partkey % 5 <> 0 AND l_suppkey % 7 <> 0) AS triple_ok FROM lineitem UNION ALL
SELECT 'lenient', count(*), count(*) FILTER ((l_partkey % 5 <> 0 OR (l_partkey % 2 = 0 AND l_linenumber % 2 = 0)) AND l_suppkey % 7 <> 0) FROM lineitem"""


def e_entity_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    named = li.select(F.col("l_orderkey").alias("chunk"), F.concat(F.lit("N "), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_partkey") % 3).alias("t"), "l_partkey")
    kind = F.element_at(F.array(F.lit("Method"), F.lit("Task"), F.lit("Metric")), (F.col("t") + 1).cast("int"))
    found = named.where("l_partkey % 4 <> 0").select("chunk", F.upper("name").alias("name"), F.when(F.col("l_partkey") % 5 == 0, "Other").otherwise(kind).alias("type"))
    return E.entity_recall_by_type(named.select("chunk", "name", kind.alias("type")), found)


E_BY_TYPE = """WITH g AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem), k AS (SELECT ['Method', 'Task', 'Metric'][p % 3 + 1] AS type, count(*) AS gold, count(*) FILTER (p % 4 <> 0) AS untyped,
  count(*) FILTER (p % 4 <> 0 AND p % 5 <> 0) AS typed FROM g GROUP BY 1) SELECT *, round(untyped / gold, 4) AS recall, round(typed / gold, 4) AS typed_recall FROM k"""


def e_entity_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    gold = rows.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("chunk"), F.col("p_name").alias("name"), F.lit("Method").alias("type"))
    found = rows.where("l_linenumber between 2 and 3").select(
        F.col("l_orderkey").alias("chunk"), F.upper("p_name").alias("name"), F.when(F.ascii(F.substring("p_name", 1, 1)) % 2 == 0, "Method").otherwise("Task").alias("type")
    )
    return E.entity_scores(gold, found)


E_ENTITY = """WITH r AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT DISTINCT l_orderkey AS c, lower(p_name) AS n FROM r WHERE l_linenumber <= 2), p AS (
  SELECT DISTINCT l_orderkey AS c, lower(p_name) AS n, CASE WHEN ascii(substr(upper(p_name), 1, 1)) % 2 = 0 THEN 'Method' ELSE 'Task' END AS t FROM (
    SELECT l_orderkey, p_name, l_linenumber FROM r) WHERE l_linenumber BETWEEN 2 AND 3),
x AS (SELECT count(g.c) AS gold, count(p.c) AS predicted, count(*) FILTER (g.c IS NOT NULL AND p.c IS NOT NULL) AS untyped,
  count(*) FILTER (g.c IS NOT NULL AND p.t = 'Method') AS typed FROM g FULL JOIN p ON g.c = p.c AND g.n = p.n)
SELECT *, round(untyped / gold, 4) AS recall, round(typed / gold, 4) AS typed_recall, round(untyped / predicted, 4) AS precision, round(typed / predicted, 4) AS typed_precision FROM x"""
E_ENTITY = E_ENTITY.replace("ascii(substr(upper(p_name), 1, 1))", "ascii(substr(p_name, 1, 1))")

def e_value_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices near and far from the stated one, names in other case and order, blanks."""
    price, name = F.col("p_retailprice"), F.col("p_name")
    words = F.array_join(F.reverse(F.split("p_name", " ")), ", then ")
    stated = lambda x: F.concat(F.lit("it cost about "), F.format_number(x, 2), F.lit(" in all"))
    cases = [
        (F.format_number(price, 2), stated(price * 1.004)), (F.format_number(price, 2), stated(price * 1.02)), (name, F.concat(F.lit("The "), F.upper(name), F.lit("!"))),
        (name, F.concat(F.lit("so "), words)), (F.concat(name, F.lit(" quux")), name), (F.lit(""), name),
    ]
    pairs = F.array(*[F.struct(g.alias("gold"), t.alias("text")) for g, t in cases])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(pairs).alias("i", "p"))
    return rows.select("p_partkey", "i", X.value_matches(F.col("p.gold"), F.col("p.text")).alias("ok"))


E_VALUE = """SELECT p_partkey, CAST(i AS INT) AS i, ok FROM part, (VALUES (0, true), (1, false), (2, true), (3, true), (4, false), (5, false)) v(i, ok)"""


def e_clause_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    said = F.concat(F.lit("A "), F.reverse(F.split("p_name", " "))[0], F.lit(" thing, "), F.split("p_name", " ")[0], F.lit("!"))
    return p.select("p_partkey", X.clause_matches(F.col("p_name"), said).alias("same"), X.clause_matches(F.lit("red ring"), F.col("p_name")).alias("red_ring"))


E_CLAUSE = "SELECT p_partkey, true AS same, p_name = 'red ring' AS red_ring FROM part"


def e_oolong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("answer"), F.lit("3").alias("gold"),
        F.when(F.col("l_partkey") % 2 == 0, "numeric").otherwise("label").alias("kind"), "l_partkey",
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(E.oolong_score(F.col("answer"), F.col("gold"), F.col("kind")), 6).alias("score"))


E_OOLONG = """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_partkey % 2 = 0 THEN pow(0.75, abs(l_linenumber - 3)) WHEN l_linenumber = 3 THEN 1 ELSE 0 END::DOUBLE, 6) AS score
FROM lineitem"""


def e_oolong_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of several shapes about each part."""
    k, n = F.col("p_partkey"), F.col("p_size")
    reply = (
        F.when(k % 5 == 0, F.concat(F.lit("Reasoning first: Answer: **["), n.cast("string"), F.lit("]**"))).when(k % 5 == 1, F.concat(F.lit("I count them all as "), (n + 2).cast("string")))
        .when(k % 5 == 2, "Label: it is clearly the more common one of the two").when(k % 5 == 3, F.col("p_name")).otherwise("Date: a long reply that says nothing of use")
    )
    gold = F.when(k % 5 == 2, F.when(k % 2 == 0, "more common than").otherwise("less common than")).when(k % 5 == 3, F.col("p_name")).otherwise(n.cast("string"))
    kind = F.when(k % 5 < 2, "numeric").otherwise("label")
    return table(spark, sf_dir, "part").select("p_partkey", E.oolong_answer(reply).alias("said"), F.round(E.oolong_score(reply, gold, kind), 6).alias("score"))


E_PARSE = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size + 2 AS VARCHAR) WHEN 2 THEN 'more common'
    WHEN 3 THEN CASE WHEN length(p_name) < 20 THEN p_name ELSE list_last(string_split(p_name, ' ')) END ELSE 'a long reply that says nothing of use' END AS said,
  CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.5625 WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END WHEN 3 THEN CASE WHEN length(p_name) < 20 THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS score FROM part"""


def e_job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = table(spark, sf_dir, "region").select(F.col("r_name").alias("arm"), F.create_map(F.lit("a"), F.lit("arm"), F.lit("b"), F.col("r_name")).alias("arm_env"))
    queries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("query_id"), F.create_map(F.lit("b"), F.col("n_name")).alias("query_env"))
    return E.job_matrix(arms, queries, 2).select("arm", "query_id", "repeat", F.col("env")["a"].alias("a"), F.col("env")["b"].alias("b"))


E_JOBS = "SELECT r_name AS arm, n_name AS query_id, CAST(repeat AS INT) AS repeat, 'arm' AS a, n_name AS b FROM region, nation, (SELECT unnest([1, 2]) AS repeat)"


def e_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 10000).alias("cost"))
    return E.cost_rollup(cells).select("arm", "runs", F.round("cost", 3).alias("cost"), F.round("with_fee", 3).alias("with_fee"))


E_COST = "SELECT event_type AS arm, count(*) AS runs, round(sum(value / 10000), 3) AS cost, round(sum(value / 10000) * 1.055, 3) AS with_fee FROM events GROUP BY ROLLUP (event_type)"


def e_arm_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_orderstatus") == "F").alias("correct"))
    return E.arm_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


E_ACCURACY = "SELECT o_orderpriority AS arm, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM orders GROUP BY 1"


def e_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pool(rankings(spark, sf_dir), 5)


E_POOL = f"WITH {RANKED} SELECT DISTINCT query_id, doc_id FROM rankings WHERE rank <= 5"

QUERIES = {
    "e_ndcg": (e_ndcg, E_NDCG), "e_recall_mrr_p": (e_recall_mrr_p, E_RECALL), "e_score_config": (e_score_config, E_CONFIG), "e_kappa": (e_kappa, E_KAPPA),
    "e_wilson": (e_wilson, E_WILSON), "e_threshold_sweep": (e_threshold_sweep, E_SWEEP), "e_choose": (e_choose, E_CHOOSE),
    "e_sweep_intervals": (e_sweep_intervals, E_INTERVALS), "e_triple_lenient": (e_triple_lenient, E_LENIENT), "e_entity_by_type": (e_entity_by_type, E_BY_TYPE),
    "e_stratified": (e_stratified, E_STRATIFIED), "e_bands": (e_bands, E_BANDS), "e_mean_sd": (e_mean_sd, E_MEAN), "e_pooled_sd": (e_pooled_sd, E_POOLED),
    "e_triple_precision": (e_triple_precision, E_TRIPLES), "e_entity_recall": (e_entity_recall, E_ENTITY), "e_value_match": (e_value_match, E_VALUE),
    "e_clause_match": (e_clause_match, E_CLAUSE), "e_oolong": (e_oolong, E_OOLONG), "e_oolong_parse": (e_oolong_parse, E_PARSE), "e_job_matrix": (e_job_matrix, E_JOBS),
    "e_cost_rollup": (e_cost_rollup, E_COST), "e_arm_accuracy": (e_arm_accuracy, E_ACCURACY), "e_pool": (e_pool, E_POOL),
}
