"""Group A: scoring of answers, ledgers and sub-task results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import answers as A
from evidentia.functions import text as X
from evidentia.operators import spans
from evidentia.plans.claim_queries import _ANSWERS, answers
from evidentia.sources.corpus import table

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"


def rows_of(names: str, *rows: tuple) -> Column:
    """An array of structs with these fields."""
    return F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, names.split(), strict=True)]) for row in rows])


def a_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", A.snippet(F.col("text"), F.array(F.lit(""), F.lit("zebra"), F.lit("Ted "), F.lit("er ")), 60).alias("snippet"))


A_SNIPPET = f"""WITH t AS (SELECT doc_id, {COLLAPSE.format("coalesce(text, '')")} AS w FROM documents), h AS (
  SELECT *, CASE WHEN instr(lower(w), 'zebra') > 0 THEN instr(lower(w), 'zebra') WHEN instr(lower(w), 'ted ') > 0 THEN instr(lower(w), 'ted ') ELSE instr(lower(w), 'er ') END AS p FROM t
), s AS (SELECT *, greatest(0, p - 21) AS st FROM h)
SELECT doc_id, CASE WHEN p = 0 THEN substr(w, 1, 60) ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || substr(w, st + 1, 60) ||
  CASE WHEN st + 60 < length(w) THEN '...' ELSE '' END END AS snippet FROM s"""


def a_gold_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(":Method; "), F.col("p_brand"), F.lit(" ;; a:"), F.col("p_name"), F.lit(":Task ; x: ;"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(A.gold_entities(text)).alias("i", "e")).select("p_partkey", "i", "e.name", "e.type")


A_ENTITIES = """SELECT p_partkey, CAST(i AS INT) AS i, CASE i WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN 'a:' || p_name ELSE 'x' END AS name,
  CASE i WHEN 0 THEN 'Method' WHEN 2 THEN 'Task' ELSE 'Concept' END AS type FROM part, (SELECT unnest([0, 1, 2, 3]) AS i)"""


def a_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part asked in every format, with an answer that is off for some."""
    p, key, wrong = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_partkey") % 3 == 0
    uuid = F.concat(F.lit("3b4365f9-1111-5222-8333-"), F.lpad(key.cast("string"), 12, "0"))
    cases = rows_of(
        "kind answer gold",
        (F.lit("integer"), F.concat(F.lit("It has "), F.when(wrong, key + 1).otherwise(key), F.lit(" pieces.")), key.cast("string")),
        (F.lit("sorted-id-list"), F.concat(F.lit("['z9', "), F.col("p_brand"), F.when(wrong, ", extra").otherwise(""), F.lit("]")), F.concat(F.col("p_brand"), F.lit("; z9"))),
        (F.lit("uuid"), F.concat(F.lit("see "), F.upper(uuid)), F.when(wrong, F.lit("none")).otherwise(uuid)),
        (F.lit("free"), F.concat(F.lit("The  "), F.upper("p_name"), F.lit(" it is.")), F.when(wrong, F.lit("other")).otherwise(F.concat(F.col("p_name"), F.lit("!")))),
    )
    rows = p.select("p_partkey", F.explode(cases).alias("c")).select("p_partkey", "c.*")
    return rows.select("p_partkey", "kind", A.score_answer(F.col("answer"), F.col("gold"), F.col("kind")).alias("s")).select("p_partkey", "kind", "s.*")


A_SCORES = """WITH k AS (SELECT *, p_partkey % 3 = 0 AS w, '3b4365f9-1111-5222-8333-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS u FROM part)
SELECT p_partkey, kind, NOT w AS correct, CASE kind WHEN 'integer' THEN CAST(CASE WHEN w THEN p_partkey + 1 ELSE p_partkey END AS VARCHAR)
  WHEN 'sorted-id-list' THEN array_to_string(list_sort(CASE WHEN w THEN string_split(p_brand, ' ') || ['extra', 'z9'] ELSE string_split(p_brand, ' ') || ['z9'] END), ',')
  WHEN 'uuid' THEN u ELSE 'the ' || lower(p_name) || ' it is' END AS predicted
FROM k, (SELECT unnest(['integer', 'sorted-id-list', 'uuid', 'free']) AS kind)"""


def a_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions with blocks of several languages and markers inside and outside them."""
    t = F.coalesce("text", F.lit(""))
    reply = F.concat(
        F.lit("FINAL_ANSWER: draft\n```json\n{\"a\": 1}\n```\nWords.\n```Py extra\n\n  x = "), F.col("turn").cast("string"),
        F.lit("\nprint('FINAL_ANSWER: no')\n```\nFINAL_ANSWER:  "), t,
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", A.code_block(reply).alias("code"), A.final_answer(reply).alias("answer"), F.length(A.prose(reply)).alias("prose"),
        A.json_in_prose(F.concat(F.lit("so {\"t\": "), F.col("turn").cast("string"), F.lit("} it is"))).alias("json"),
        A.unfenced(F.concat(F.lit("```json\n"), F.col("turn").cast("string"), F.lit("\n```"))).alias("bare"),
    )


_TAIL = STRIP.format("coalesce(text, '')")
A_BLOCKS = f"""WITH c AS (SELECT *, {_TAIL} AS t FROM conversations WHERE coalesce(text, '') NOT LIKE '%```%' AND coalesce(text, '') NOT LIKE '%FINAL_ANSWER%')
SELECT conv_id, turn, role, '  x = ' || turn || chr(10) || 'print(''FINAL_ANSWER: no'')' AS code, CASE WHEN t <> '' THEN t END AS answer,
  CAST(length({STRIP.format("regexp_replace('FINAL_ANSWER: draft' || chr(10) || ' ' || chr(10) || 'Words.' || chr(10) || ' ' || chr(10) || 'FINAL_ANSWER:  ' || coalesce(text, ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS INT) AS prose,
  '{{"t": ' || turn || '}}' AS json, CAST(turn AS VARCHAR) AS bare FROM c"""


def a_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast(A.STRINGS)
    raw = rows_of(
        "bucket clauses",
        (F.lit("Problems "), F.array(F.lit("old"))), (F.lit("other"), F.array(F.col("p_name"))),
        (F.lit(" OBJECT ives"), F.array(F.col("p_name"), F.lit("  "), F.concat(F.lit(" "), F.upper("p_name")), F.lit("plain"))),
        (F.lit("problems"), F.array(F.col("p_brand"), F.lit("Plain"))), (F.lit("constraints"), none),
    )
    buckets = A.normal_buckets(raw)
    rows = table(spark, sf_dir, "part").select("p_partkey", buckets.alias("b"))
    return rows.select("p_partkey", A.flat_clauses(F.col("b")).alias("query"), F.posexplode("b").alias("i", "x")).select(
        "p_partkey", "query", "i", "x.bucket", F.array_join("x.clauses", "|").alias("clauses")
    )


A_BUCKETS = """SELECT p_partkey, p_name || ' plain ' || p_brand AS query, CAST(i AS INT) AS i, ['objectives', 'problems', 'constraints', 'requirements'][i + 1] AS bucket,
  CASE i WHEN 0 THEN p_name || '|plain' WHEN 1 THEN p_brand ELSE '' END AS clauses FROM part, (SELECT unnest([0, 1, 2, 3]) AS i)"""


def a_bucket_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.array(F.col("p_name"), F.lit("zebra crossing"), F.lit(" "))
    produced = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("nothing of it"))).otherwise(
        F.array(F.concat(F.lit("about "), F.reverse(F.split("p_name", " "))[0], F.lit(" and "), F.split("p_name", " ")[0]), F.lit("unrelated words"), F.lit(""))
    )
    return table(spark, sf_dir, "part").select("p_partkey", A.bucket_scores(gold, produced).alias("s")).select("p_partkey", "s.*")


A_BUCKET_SCORES = """SELECT p_partkey, 2 AS gold, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS produced, m AS matched_gold, m AS matched_produced,
  round(m / 2, 4) AS recall, round(m / CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END, 4) AS precision FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS m FROM part)"""


def a_claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the corpus's own chunks against two gold claims each."""
    a = answers(spark, sf_dir)
    d = F.col("doc_id")
    gold = rows_of(
        "values chunk_uuid", (F.array(F.lit("no such thing"), F.lit("rests on")), F.col("chunk_uuid")), (F.array(F.lit("never stated")), F.lit("")),
    )
    recorded = F.when(d % 2 == 0, F.array("chunk_uuid")).otherwise(F.array(F.lit("other")))
    texts = F.create_map(F.col("chunk_uuid"), F.when(d % 8 == 0, F.lit("Here it rests on that.")).otherwise(F.lit("Nothing here.")))
    return a.select("doc_id", A.claim_scores(F.col("answer"), gold, recorded, texts).alias("s")).select("doc_id", "s.*")


A_CLAIM_SCORES = f"""WITH {_ANSWERS} SELECT doc_id, 2 AS claims, 1 AS matched, 1 AS judged, CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS supported, 1 AS gold_chunks,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS in_record, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS cited FROM answers"""


def a_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quotes of each document: a verbatim one, a short one, an invented one."""
    whole = X.collapse(F.coalesce("text", F.lit("")))
    quotes = F.array(F.substring(whole, 11, 60), F.lit("too short"), F.lit("a span of words that no document holds at all, ever"))
    return table(spark, sf_dir, "documents").select("doc_id", A.verify_quotes(quotes, F.col("text")).alias("q")).select(
        "doc_id", F.array_join("q.kept", "|").alias("kept"), "q.dropped"
    )


A_QUOTES = f"""WITH t AS (SELECT doc_id, trim(substr({COLLAPSE.format("coalesce(text, '')")}, 11, 60), ' ') AS q FROM documents)
SELECT doc_id, CASE WHEN length(q) >= 25 THEN q ELSE '' END AS kept, CASE WHEN length(q) >= 25 THEN 2 ELSE 3 END AS dropped FROM t"""


def a_ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    units = F.when(d % 5 == 0, F.lit(None).cast("int")).when(d % 5 == 1, 0).otherwise(2)
    texts = F.when(d % 5 == 2, F.array(F.lit("something else"))).otherwise(F.array(F.lit("x y z"), F.substring(X.collapse(F.coalesce("text", F.lit(""))), 1, 200)))
    return table(spark, sf_dir, "documents").select("doc_id", A.ledger_status(F.concat(F.lit("Lead-in. "), F.coalesce("text", F.lit(""))), units, texts).alias("status"))


A_LEDGER = f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN CASE WHEN contains(lower({COLLAPSE.format("coalesce(text, '')")}), 'something else') THEN 'ok' ELSE 'stale' END
  ELSE CASE WHEN {COLLAPSE.format("coalesce(text, '')")} <> '' OR contains(lower({COLLAPSE.format("coalesce(text, '')")}), 'x y z') THEN 'ok' ELSE 'stale' END END AS status FROM documents"""


def a_evidence_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(k).alias("key"), t.alias("text")) for k, t in (("a", F.col("p_name")), ("b", F.lit(" ")), ("c", F.concat(F.col("p_brand"), F.lit("  x"))), ("d", F.col("p_name")))])
    return table(spark, sf_dir, "part").select("p_partkey", A.format_evidence(items, 30).alias("evidence"), F.length(A.render_items(items, 4)).alias("items"))


A_EVIDENCE = f"""WITH l AS (SELECT p_partkey, p_name, '[a] ' || {COLLAPSE.format('p_name')} AS a, '[c] ' || {COLLAPSE.format("p_brand || '  x'")} AS c, '[d] ' || {COLLAPSE.format('p_name')} AS d FROM part), r AS (
  SELECT *, substr(a, 1, 30) AS a1, 30 - length(substr(a, 1, 30)) AS ra FROM l), s AS (SELECT *, CASE WHEN ra > 0 THEN substr(c, 1, ra) END AS c1 FROM r), t AS (
  SELECT *, CASE WHEN ra - length(c1) > 0 THEN substr(d, 1, ra - length(c1)) END AS d1 FROM s)
SELECT p_partkey, concat_ws(' | ', a1, c1, d1) AS evidence, CAST(4 * 4 + 3 * 2 + 2 * least(4, length(p_name)) + 1 + 4 AS INT) AS items FROM t"""


def a_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a name that a span of characters in its middle touches."""
    words = F.split("p_name", " ")
    at = F.length(words[0]) + 1
    tokens = F.array(
        F.struct(F.lit(0).alias("start"), F.length(words[0]).alias("stop")), F.struct(at.alias("start"), F.length("p_name").alias("stop"))
    )
    both, one, none = (A.token_span(tokens, a, b) for a, b in ((F.lit(1), at + 1), (at, at + 1), (F.length(words[0]), at)))
    return table(spark, sf_dir, "part").select("p_partkey", both["first"].alias("b0"), both["last"].alias("b1"), one["first"].alias("o0"), one["last"].alias("o1"), none["first"].alias("n0"))


A_SPANS = "SELECT p_partkey, 0 AS b0, 1 AS b1, 1 AS o0, 1 AS o1, CAST(NULL AS INT) AS n0 FROM part"


def a_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("It is old. We  found "), key, F.lit(".5 of them. No "), key, F.lit(" here."))
    changed = A.perturb_number(text)
    surface = F.concat(F.lit("Net "), key, F.lit(" . 5 ( new ) , see"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", A.numeric_sentence(text, key).alias("sentence"), changed["text"].alias("changed"), changed["after"].alias("after"),
        A.clean_surface(surface).alias("surface"), A.truth_of(F.when(F.col("p_partkey") % 3 == 0, "Supported").when(F.col("p_partkey") % 3 == 1, "partial").otherwise("cannot judge")).alias("truth"),
    )


A_NUMBERS = """SELECT p_partkey, 'We found ' || p_partkey || '.5 of them.' AS sentence, 'It is old. We  found ' || (p_partkey + 17) || '.5 of them. No ' || p_partkey || ' here.' AS changed,
  p_partkey + 17.5::DOUBLE AS after, 'Net ' || p_partkey || '.5 (new), see' AS surface, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS truth FROM part"""


def a_final_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over two claims of each part, with labels of the citations in a line."""
    k = F.col("p_partkey")
    claims = rows_of("name p", (F.lit("b"), k % 10 / 10), (F.lit("a"), k % 5 / 10))
    gate = A.final_gate(F.when(k % 9 != 0, k % 7 / 10), claims, k % 11 / 10, 0.95)
    line = F.concat(F.lit("see 2101.00002v1, "), F.lpad(k % 10000, 4, "0"), F.lit(".00001 and 2101.00002"))
    rows = table(spark, sf_dir, "part").select("p_partkey", gate.alias("g"), A.citation_labels(line).alias("l"))
    return rows.select("p_partkey", "g.verdict", "g.decision", F.array_join("g.named", " ").alias("named"), F.array_join(F.transform("l", lambda x: F.concat(x["id"], x["label"])), " ").alias("labels"))


A_GATE = """WITH p AS (SELECT p_partkey AS k, p_partkey % 10 AS b, p_partkey % 5 AS a, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 7 END AS g FROM part), d AS (
  SELECT *, g >= 5 AS al, b >= 7 OR a >= 7 AS cl FROM p)
SELECT k AS p_partkey, CASE WHEN k % 11 = 10 THEN 'pass' WHEN g IS NULL THEN 'uncertain' WHEN al OR cl THEN 'fail' ELSE 'pass' END AS verdict,
  CASE WHEN k % 11 = 10 THEN 'score' WHEN g IS NULL THEN 'none' WHEN al AND cl THEN 'both' WHEN cl THEN 'claim' WHEN al THEN 'aggregate' ELSE 'none' END AS decision,
  CASE WHEN k % 11 = 10 OR g IS NULL THEN '' WHEN cl THEN 'b' WHEN al AND b >= 5 THEN 'b' ELSE '' END AS named, '2101.00002[1] ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || '.00001[2]' AS labels FROM d"""


def a_union_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    produced = rows_of("bucket clauses", (F.lit("objectives"), F.array(F.lit("nothing"))), (F.lit("problems"), F.array(F.concat(F.lit("about "), F.col("p_name")), F.lit(" "))))
    sheet = A.excerpts(F.array(F.lit("u1"), F.lit(" "), F.lit("u3")), F.col("p_name"), F.lit("x"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", A.union_recall(F.array(F.col("p_name"), F.lit("zebra"), F.lit("")), produced).alias("u"), F.size(sheet).alias("excerpts")).select("p_partkey", "u.*", "excerpts")


A_UNION = "SELECT p_partkey, 2 AS gold, 1 AS matched, 0.5::DOUBLE AS recall, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS excerpts FROM part"

def a_line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document that touches one of its tokens, in tokens."""
    docs = table(spark, sf_dir, "documents")
    lines, words = (spans.pieces(docs, "doc_id", "text", mark) for mark in ("\n", " "))
    found = spans.token_spans(lines.withColumnRenamed("nth", "line"), words, "doc_id", ["line"])
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("line", "first", "last", "tokens")))


def _pieces(mark: int) -> str:
    return f"""SELECT doc_id, nth, start, start + length(piece) AS stop FROM (
    SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, unnest(l) AS piece, unnest(generate_series(0, len(l) - 1)) AS nth
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr({mark})) AS l FROM documents)))"""


A_LINE_TOKENS = f"""WITH lines AS ({_pieces(10)}), tokens AS ({_pieces(32)})
SELECT l.doc_id, l.nth AS line, min(t.nth) AS first, max(t.nth) AS last, count(*) AS tokens
FROM lines l JOIN tokens t ON l.doc_id = t.doc_id AND l.start < t.stop AND t.start < l.stop
WHERE l.start < l.stop AND t.start < t.stop GROUP BY l.doc_id, l.nth"""


QUERIES = {
    "a_line_tokens": (a_line_tokens, A_LINE_TOKENS), "a_final_gate": (a_final_gate, A_GATE), "a_union_recall": (a_union_recall, A_UNION),
    "a_snippet": (a_snippet, A_SNIPPET), "a_gold_entities": (a_gold_entities, A_ENTITIES), "a_answer_scores": (a_answer_scores, A_SCORES),
    "a_blocks": (a_blocks, A_BLOCKS), "a_buckets": (a_buckets, A_BUCKETS), "a_bucket_scores": (a_bucket_scores, A_BUCKET_SCORES),
    "a_claim_scores": (a_claim_scores, A_CLAIM_SCORES), "a_quotes": (a_quotes, A_QUOTES), "a_ledger_status": (a_ledger_status, A_LEDGER),
    "a_evidence_format": (a_evidence_format, A_EVIDENCE), "a_token_spans": (a_token_spans, A_SPANS), "a_numbers": (a_numbers, A_NUMBERS),
}
