"""Group G: the knowledge graph, over triples made of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import lexicons as lex
from evidentia.operators import graph as G
from evidentia.operators.components import strong_components
from evidentia.sources.corpus import table

TAILS = (" model", " dataset", " task", "", "QA", " score", "", " corpus")
RELATIONS = (*lex.RELATION_SCHEMA,)


def name(i):
    return F.concat(F.lit("E"), i.cast("string"), F.element_at(G.any_of(TAILS), (i % len(TAILS) + 1).cast("int")))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve entities, nine relations (one unknown), contexts of several orders."""
    li = table(spark, sf_dir, "lineitem")
    h, t = F.col("l_suppkey") % 12, F.col("l_partkey") % 12
    kinds = G.any_of(lex.ENTITY_TYPES)
    relation = F.element_at(G.any_of(RELATIONS), (F.col("l_linenumber") % 8 + 1).cast("int"))
    none = F.lit(None)
    return li.select(
        (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("ord"),
        name(h).alias("head"), F.element_at(kinds, (h % 6 + 1).cast("int")).alias("head_type"),
        F.when(F.col("l_partkey") % 11 == 0, "improves").otherwise(relation).alias("relation"),
        name(t).alias("tail"), F.element_at(kinds, (t % 6 + 1).cast("int")).alias("tail_type"),
        F.round(F.col("l_quantity") / 100 + F.col("l_discount"), 4).alias("score"),
        F.concat(F.lit("c"), F.col("l_orderkey") % 300).alias("chunk_uuid"), F.concat(F.lit("a"), F.col("l_orderkey") % 50).alias("arxiv_id"),
        *[none.cast(k).alias(f"{s}_type_{n}") for s in G.SIDES for n, k in (("source", "string"), ("confidence", "double"))],
        (F.col("l_tax") - 0.03).alias("direction_margin"),
        F.when(F.col("l_partkey") % 3 == 0, True).when(F.col("l_partkey") % 3 == 1, False).alias("direction_verified"),
    )


def _name(i: str) -> str:
    return f"('E' || ({i}) || {list(TAILS)}[({i}) % {len(TAILS)} + 1])"


_TYPES = list(lex.ENTITY_TYPES)
TRIPLES = f"""t AS (
  SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS ord, {_name('l_suppkey % 12')} AS head,
    {_TYPES}[(l_suppkey % 12) % 6 + 1] AS head_type, CASE WHEN l_partkey % 11 = 0 THEN 'improves' ELSE {list(RELATIONS)}[l_linenumber % 8 + 1] END AS relation,
    {_name('l_partkey % 12')} AS tail, {_TYPES}[(l_partkey % 12) % 6 + 1] AS tail_type, round(l_quantity / 100 + l_discount, 4) AS score,
    'c' || (l_orderkey % 300) AS chunk_uuid, 'a' || (l_orderkey % 50) AS arxiv_id, l_tax - 0.03 AS direction_margin,
    CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS direction_verified FROM lineitem
)"""
_SCHEMA = "schema_(relation, heads, tails) AS (VALUES " + ", ".join(f"('{r}', {list(s[0])}, {list(s[1])})" for r, s in lex.RELATION_SCHEMA.items()) + ")"
REASON = f"""{_SCHEMA}, judged AS (
  SELECT t.*, CASE WHEN s.relation IS NULL THEN 'relation' WHEN NOT list_contains(heads, head_type) THEN 'head_type'
    WHEN NOT list_contains(tails, tail_type) THEN 'tail_type' END AS reason FROM t LEFT JOIN schema_ s ON t.relation = s.relation)"""


def g_ontology_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_ontology(triples(spark, sf_dir)).select("ord", "head", "relation", "tail")


G_ONTOLOGY = f"WITH {TRIPLES}, {REASON} SELECT ord, head, relation, tail FROM judged WHERE reason IS NULL"


def g_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.drop_counts(triples(spark, sf_dir))


G_COUNTS = f"WITH {TRIPLES}, {REASON} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1"
GAZETTEER = (("E1 DATASET", "Dataset", 0.95), ("e3", "Metric", 0.9), ("E4-QA", "Task", 0.99), ("E6", "Concept", 0.5))


def g_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(list(GAZETTEER), "name string, type string, confidence double")
    return G.apply_gazetteer(triples(spark, sf_dir), known).select("ord", "head_type", "head_type_source", "tail_type", "tail_type_source", "head_type_confidence")


def _known(side: str) -> str:
    key = f"regexp_replace(lower({side}), '[^a-z0-9]', '', 'g')"
    return f"CASE {key} WHEN 'e1dataset' THEN 'Dataset' WHEN 'e3' THEN 'Metric' WHEN 'e4qa' THEN 'Task' END"


G_GAZETTEER = f"""WITH {TRIPLES} SELECT ord, coalesce({_known('head')}, head_type) AS head_type, CASE WHEN {_known('head')} IS NOT NULL THEN 'gazetteer' END AS head_type_source,
  coalesce({_known('tail')}, tail_type) AS tail_type, CASE WHEN {_known('tail')} IS NOT NULL THEN 'gazetteer' END AS tail_type_source,
  CASE WHEN {_known('head')} IS NOT NULL THEN 0.9::DOUBLE END AS head_type_confidence FROM t"""


def g_suffix_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.suffix_types(triples(spark, sf_dir)).select("ord", "head_type", "tail_type", "tail_type_source")


def _suffix(side: str) -> str:
    word = f"regexp_extract({side}, '([a-z]+)$', 1)"
    return f"CASE {word} WHEN 'model' THEN 'Method' WHEN 'dataset' THEN 'Dataset' WHEN 'task' THEN 'Task' WHEN 'score' THEN 'Metric' WHEN 'corpus' THEN 'Dataset' END"


G_SUFFIX = f"""WITH {TRIPLES} SELECT ord, coalesce({_suffix('head')}, head_type) AS head_type, coalesce({_suffix('tail')}, tail_type) AS tail_type,
  CASE WHEN {_suffix('tail')} IS NOT NULL THEN 'suffix' END AS tail_type_source FROM t"""


def g_relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relation_types(G.with_soft_defaults(triples(spark, sf_dir))).select("ord", "head_type", "tail_type", "tail_type_source", "tail_type_confidence")


_ONE = {r: s[1][0] for r, s in lex.RELATION_SCHEMA.items() if len(s[1]) == 1}
_TAIL = "CASE relation " + " ".join(f"WHEN '{r}' THEN '{k}'" for r, k in _ONE.items()) + " END"
G_RELATION = f"""WITH {TRIPLES} SELECT ord, CASE WHEN relation <> 'improves' THEN 'Method' ELSE head_type END AS head_type, coalesce({_TAIL}, tail_type) AS tail_type,
  CASE WHEN {_TAIL} IS NULL THEN 'model' ELSE 'relation' END AS tail_type_source, CASE WHEN {_TAIL} IS NULL THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS tail_type_confidence FROM t"""


def g_role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).where(G.role_ok()).groupBy("relation").agg(F.count("*").alias("n"))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


G_ROLE = f"""WITH {TRIPLES} SELECT relation, count(*) AS n FROM t WHERE NOT (
  (relation IN {_in(lex.ROLE_HEAD_RELATIONS)} AND (lower(head) LIKE '%qa' OR head_type = 'Task')) OR
  (relation IN {_in(lex.ROLE_TAIL_RELATIONS)} AND (lower(tail) LIKE '%qa' OR (relation <> 'addresses' AND tail_type = 'Task')))) GROUP BY relation"""


def g_direction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir).where(~F.col("relation").isin(*lex.SYMMETRIC_RELATIONS))
    return G.resolve_pairs(rows).select("ord", "head", "relation", "tail", "chunk_uuid")


def g_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir).where(F.col("relation").isin(*lex.SYMMETRIC_RELATIONS))
    return G.resolve_pairs(rows).select("ord", "head", "relation", "tail", "chunk_uuid")


def _pairs(where: str, met: str) -> str:
    return f"""WITH {TRIPLES}, m AS (SELECT *, lower(head) AS a, lower(tail) AS b FROM t WHERE {where} AND head <> tail), d AS (
      SELECT *, {met} AS met FROM m), r AS (
      SELECT *, row_number() OVER (PARTITION BY relation, chunk_uuid, least(a, b), greatest(a, b) ORDER BY score DESC, met, ord) AS r FROM d)
      SELECT ord, head, relation, tail, chunk_uuid FROM r WHERE r = 1"""


G_PAIRS = _pairs("relation <> 'compares_to'", "min(ord) OVER (PARTITION BY relation, chunk_uuid, a, b)")
G_SYMMETRIC = _pairs("relation = 'compares_to'", "ord")


def g_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dedup(triples(spark, sf_dir)).select("ord", "head", "relation", "tail", "arxiv_id")


G_DEDUP = f"""WITH {TRIPLES} SELECT ord, head, relation, tail, arxiv_id FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(head), relation, lower(tail) ORDER BY ord) AS r FROM t) WHERE r = 1"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = G.dedup(G.with_soft_defaults(triples(spark, sf_dir)))
    return G.nodes(rows), G.edges(rows)


_GRAPH = f"""{TRIPLES}, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(head), relation, lower(tail) ORDER BY ord) AS r FROM t) WHERE r = 1),
edges AS (SELECT lower(head) AS src, lower(tail) AS dst, relation, score, chunk_uuid, arxiv_id, direction_verified FROM dd), ends AS (
  SELECT ord, 0 AS side, lower(head) AS key, head AS display, head_type AS type FROM dd UNION ALL SELECT ord, 1, lower(tail), tail, tail_type FROM dd),
nodes AS (SELECT key, display, type, 'model' AS type_source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, side) AS r FROM ends) WHERE r = 1)"""


def g_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[0].select("key", "display", "type", "type_source")


def g_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1]


def g_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbors(graph(spark, sf_dir)[1], "e1  DATASET", direction="both").select("src", "dst", "relation")


def g_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return G.subgraph(e, n.where(F.col("type").isin("Method", "Dataset"))).select("src", "dst", "relation")


def g_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.index_summary(*graph(spark, sf_dir))


def g_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_degree(graph(spark, sf_dir)[1], 5)


G_NODES = f"WITH {_GRAPH} SELECT * FROM nodes"
G_EDGES = f"WITH {_GRAPH} SELECT * FROM edges"
G_NEIGHBORS = f"WITH {_GRAPH} SELECT src, dst, relation FROM edges WHERE src = 'e1 dataset' OR dst = 'e1 dataset'"
G_SUBGRAPH = f"""WITH {_GRAPH}, k AS (SELECT key FROM nodes WHERE type IN ('Method', 'Dataset'))
SELECT src, dst, relation FROM edges WHERE src IN (SELECT key FROM k) AND dst IN (SELECT key FROM k)"""
G_SUMMARY = f"""WITH {_GRAPH} SELECT 'nodes' AS kind, 'all' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', 'all', count(*) FROM edges
UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'type_source', type_source, count(*) FROM nodes GROUP BY type_source
UNION ALL SELECT 'relation', r, count(e.relation) FROM (SELECT unnest({list(RELATIONS)}) AS r) LEFT JOIN edges e ON e.relation = r GROUP BY r
UNION ALL SELECT 'direction', s, count(e.src) FROM (SELECT unnest(['verified', 'unverified', 'unknown']) AS s) LEFT JOIN edges e ON s = CASE WHEN direction_verified THEN 'verified' WHEN NOT direction_verified THEN 'unverified' ELSE 'unknown' END GROUP BY s"""
G_DEGREE = f"""WITH {_GRAPH} SELECT key, count(*) AS degree FROM (SELECT src AS key FROM edges UNION ALL SELECT dst FROM edges) GROUP BY key ORDER BY degree DESC, key LIMIT 5"""


def g_cycle_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_directionality(triples(spark, sf_dir)).select("ord", "head", "relation", "tail", "chunk_uuid")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges between nations: the first five of each by a rule."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    return n.select("src", F.explode(F.array(*[((F.col("src") * k + 3) % 25) for k in (2, 7)])).alias("dst")).where("src <> dst and src % 4 <> 1").distinct()


def g_cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that are on a cycle of the trade edges."""
    return G.cycle_members(trade(spark, sf_dir))


G_CYCLES = """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * k + 3) % 25 AS dst FROM nation, (SELECT unnest([2, 7]) AS k)
  WHERE n_nationkey % 4 <> 1 AND n_nationkey <> (n_nationkey * k + 3) % 25), reach AS (
  SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)
SELECT DISTINCT src AS node FROM reach WHERE src = dst"""


def g_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that returned lines of full discount and tax join in cycles."""
    li, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").count()
    lines = li.where("l_returnflag = 'R' and round(l_discount, 2) = 0.1 and round(l_tax, 2) >= 0.07")
    return strong_components(lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % suppliers + 1).alias("dst")))


G_COMPONENTS = """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) + 1 AS dst FROM lineitem
  WHERE l_returnflag = 'R' AND round(l_discount, 2) = 0.1 AND round(l_tax, 2) >= 0.07), reach AS (
  SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)
SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src
GROUP BY a.src HAVING count(*) > 1"""


def g_coref(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    texts = p.select(F.concat(F.lit("c"), F.col("p_partkey")).alias("chunk_uuid"), F.concat(F.lit("The "), F.col("p_brand"), F.lit(" beats "), F.col("p_name"), F.lit(". It also wins.")).alias("chunk_text"))
    rows = p.select(
        (F.col("p_partkey") * 2).alias("ord"), F.concat(F.lit("c"), F.col("p_partkey")).alias("chunk_uuid"), F.col("p_brand").alias("head"), F.lit("Method").alias("head_type"),
        F.col("p_name").alias("tail"), F.lit("Task").alias("tail_type"),
    ).unionByName(p.select(
        (F.col("p_partkey") * 2 + 1).alias("ord"), F.concat(F.lit("c"), F.col("p_partkey")).alias("chunk_uuid"), F.lit("It").alias("head"),
        F.when(F.col("p_size") % 2 == 0, "Method").otherwise("Task").alias("head_type"), F.lit("wins").alias("tail"), F.lit("Concept").alias("tail_type"),
    ))
    return G.resolve_coref(rows, texts).select("ord", "head", "tail")


G_COREF = """SELECT p_partkey * 2 AS ord, p_brand AS head, p_name AS tail FROM part UNION ALL
SELECT p_partkey * 2 + 1, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END, 'wins' FROM part"""

SPANS = ("it", "the model", "GPT-4", "novel approach", "these results", "data", "42", "our system for QA tasks over text", "deep nets", "better scores", "BERT model", "")


def g_span_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    pick = lambda k: F.element_at(G.any_of(SPANS), ((i * k) % len(SPANS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(1).alias("head"), F.element_at(G.any_of(SPANS), ((i.cast("int") / 12).cast("int") % len(SPANS) + 1).cast("int")).alias("tail"))
    return G.filter_spans(rows)


_GOOD = ("GPT-4", "our system for QA tasks over text", "deep nets", "BERT model")
G_SPANS = f"SELECT * FROM (SELECT p_partkey, {list(SPANS)}[p_partkey % 12 + 1] AS head, {list(SPANS)}[(p_partkey // 12) % 12 + 1] AS tail FROM part) WHERE head IN {_in(_GOOD)} AND tail IN {_in(_GOOD)}"


def g_verify_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful edges by margin; those within the budget get a fixed answer."""
    rows = G.dedup(triples(spark, sf_dir)).withColumn("direction_reasons", F.when(F.abs("direction_margin") < 0.02, F.array(F.lit("small_margin"))).otherwise(F.array().cast("array<string>")))
    first = rows.where(F.size("direction_reasons") > 0).select("ord", F.abs("direction_margin").alias("m")).orderBy("m", "ord").limit(40).select("ord", F.lit(True).alias("_judged"))
    choice = F.element_at(G.any_of(("ab", "ba", "neither")), (F.col("ord") % 3 + 1).cast("int"))
    judged = rows.join(F.broadcast(first), "ord", "left").withColumn(
        "_a", F.when(F.col("_judged"), F.struct(choice.alias("choice"), F.when(F.col("ord") % 2 == 0, 0.8).otherwise(0.5).alias("confidence")))
    )
    return G.settle_direction(judged).select("ord", "head", "tail", "direction_source", "direction_verified")


G_VERIFY = f"""WITH {_GRAPH}, q AS (SELECT *, abs(direction_margin) < 0.02 AS doubt FROM dd), b AS (
  SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY abs(direction_margin), ord) AS r FROM q WHERE doubt) WHERE r <= 40), j AS (
  SELECT q.*, b.ord IS NOT NULL AS judged, ['ab', 'ba', 'neither'][q.ord % 3 + 1] AS choice, q.ord % 2 = 0 AS sure FROM q LEFT JOIN b ON q.ord = b.ord)
SELECT ord, CASE WHEN judged AND sure AND choice = 'ba' THEN tail ELSE head END AS head, CASE WHEN judged AND sure AND choice = 'ba' THEN head ELSE tail END AS tail,
  CASE WHEN NOT doubt THEN 'cue' WHEN judged AND sure THEN 'judge' WHEN judged THEN 'judge_uncertain' ELSE 'unverified' END AS direction_source,
  NOT doubt OR (judged AND sure) AS direction_verified FROM j WHERE NOT (judged AND choice = 'neither')"""


def g_gazetteer_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("We use the "), F.initcap("p_name"), F.lit(" dataset. It has accuracy and F1-score."), F.when(F.col("p_size") > 25, " Also BLEU-4!").otherwise("")).alias("chunk_text")
    )
    return G.build_gazetteer(p).select("key", "type", "count", "name", "confidence")


G_BUILD = """WITH m AS (SELECT lower(p_name) AS key, 'Dataset' AS type, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part
  UNION ALL SELECT 'accuracy', 'Metric', 'accuracy' FROM part UNION ALL SELECT 'f1-score', 'Metric', 'F1-score' FROM part UNION ALL SELECT 'bleu-4', 'Metric', 'BLEU-4' FROM part WHERE p_size > 25)
SELECT key, type, count(*) * CASE type WHEN 'Dataset' THEN 2 ELSE 1 END AS count, min(name) AS name,
  CASE WHEN type = 'Dataset' THEN CASE WHEN 2 * count(*) >= 5 THEN 0.9 ELSE 0.8 END WHEN count(*) >= 10 THEN 0.9 WHEN count(*) >= 5 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence
FROM m GROUP BY key, type HAVING type = 'Dataset' OR count(*) >= 2"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small node-link document of each part."""
    name, brand, key = F.col("p_name"), F.col("p_brand"), F.col("p_partkey").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    json = F.concat(
        F.lit('{"directed": true, "nodes": [{"key": "a", "display": '), quoted(name), F.lit(', "type": "Method"}, {"key": "b", "display": '), quoted(brand),
        F.lit(', "type": "Dataset"}], "links": [{"src": "a", "dst": "b", "relation": "uses", "score": 0.5, "chunk_uuid": "c'), key,
        F.lit('"}, {"src": "b", "dst": "z", "relation": "extends", "score": 1, "chunk_uuid": null}]}'),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload"), json.alias("json"))


def g_payload_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.payload_triples(payloads(spark, sf_dir))


G_PAYLOAD = """SELECT p_partkey AS payload, p_name AS head, 'Method' AS head_type, 'uses' AS relation, p_brand AS tail, 'Dataset' AS tail_type, 0.5::DOUBLE AS score, 'c' || p_partkey AS chunk_uuid FROM part
UNION ALL SELECT p_partkey, p_brand, 'Dataset', 'extends', 'z', 'Concept', 1, NULL FROM part"""


def g_payload_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.payload_entities(payloads(spark, sf_dir))


G_PAYLOAD_ENTITIES = """SELECT p_partkey AS payload, 'c' || p_partkey AS chunk_uuid, p_name AS name, 'Method' AS type FROM part
UNION ALL SELECT p_partkey, 'c' || p_partkey, p_brand, 'Dataset' FROM part"""


def g_gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instance_id"), F.concat(F.lit("c"), F.col("o_orderkey") % 400).alias("chunk_uuid"))
    return G.gold_coverage(gold, graph(spark, sf_dir)[1])


G_COVERAGE = f"""WITH {_GRAPH}, h AS (SELECT DISTINCT chunk_uuid FROM edges) SELECT o_custkey AS instance_id, count(*) AS claims, count(h.chunk_uuid) AS covered, round(count(h.chunk_uuid) / count(*), 4) AS coverage
FROM orders LEFT JOIN h ON 'c' || (o_orderkey % 400) = h.chunk_uuid GROUP BY o_custkey"""


def plain_extractor(text: str) -> list[tuple[str, str, str, str, str, float]]:
    """Triples of made-up texts: ``X outperforms Y on Z.``"""
    out = []
    for line in text.split(". "):
        words = line.rstrip(".").split(" outperforms ")
        if len(words) == 2:
            loser, _, bench = words[1].partition(" on ")
            out += [(words[0], "Method", "outperforms", loser, "Method", 0.9), (words[0], "Method", "evaluated_on", bench, "Dataset", 0.4 if bench.endswith("9") else 0.8)]
    return out


def g_build_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that every stage leaves, over one made-up text of each part."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("Alpha"), k, F.lit(" outperforms "), F.when(F.col("p_partkey") % 4 == 0, F.lit("it")).otherwise(F.concat(F.lit("Beta"), (F.col("p_partkey") % 7).cast("string"))), F.lit(" on Corpus "), k, F.lit("."))
    chunks_ = p.select(F.concat(F.lit("c"), k).alias("chunk_uuid"), F.concat(F.lit("a"), F.col("p_partkey") % 9).alias("arxiv_id"), text.alias("chunk_text"))
    return G.stage_counts(G.build_kg(chunks_, plain_extractor)).select("stage", "n")


G_KG = """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) LIKE '%9' AS low, p_partkey % 4 = 0 AS it FROM part), c AS (SELECT count(*) + count(*) FILTER (NOT low) AS e, count(*) FILTER (it) AS its,
  count(*) FILTER (NOT it) AS wins, count(*) FILTER (NOT low) AS evals, count(DISTINCT CASE WHEN NOT it THEN k % 7 END) AS losers FROM p)
SELECT 'extracted' AS stage, e AS n FROM c UNION ALL SELECT 'coref', e FROM c UNION ALL SELECT 'spans', e FROM c UNION ALL SELECT 'processed', e - its FROM c UNION ALL SELECT 'ontology', e - its FROM c
UNION ALL SELECT 'dedup', e - its FROM c UNION ALL SELECT 'nodes', (SELECT count(*) FROM p WHERE NOT it OR NOT low) + losers + evals FROM c UNION ALL SELECT 'edges', e - its FROM c"""

QUERIES = {
    "g_ontology_filter": (g_ontology_filter, G_ONTOLOGY), "g_drop_counts": (g_drop_counts, G_COUNTS), "g_gazetteer": (g_gazetteer, G_GAZETTEER),
    "g_suffix_types": (g_suffix_types, G_SUFFIX), "g_relation_types": (g_relation_types, G_RELATION), "g_role_filter": (g_role_filter, G_ROLE),
    "g_direction_pairs": (g_direction_pairs, G_PAIRS), "g_symmetric": (g_symmetric, G_SYMMETRIC), "g_dedup": (g_dedup, G_DEDUP), "g_nodes": (g_nodes, G_NODES),
    "g_edges": (g_edges, G_EDGES), "g_neighbors": (g_neighbors, G_NEIGHBORS), "g_subgraph": (g_subgraph, G_SUBGRAPH), "g_index_summary": (g_index_summary, G_SUMMARY),
    "g_top_degree": (g_top_degree, G_DEGREE), "g_cycle_break": (g_cycle_break, None), "g_cycle_members": (g_cycle_members, G_CYCLES), "g_components": (g_components, G_COMPONENTS),
    "g_coref": (g_coref, G_COREF), "g_span_filter": (g_span_filter, G_SPANS), "g_verify_budget": (g_verify_budget, G_VERIFY),
    "g_gazetteer_build": (g_gazetteer_build, G_BUILD), "g_payload_triples": (g_payload_triples, G_PAYLOAD), "g_payload_entities": (g_payload_entities, G_PAYLOAD_ENTITIES),
    "g_gold_coverage": (g_gold_coverage, G_COVERAGE), "g_build_kg": (g_build_kg, G_KG),
}
