"""Plans, forks, regrades, sub-task records and reports of experiments."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import text as X


def scope_verdict(rule: Column, allowed: Column, cited: Column, units: Column, first_year: Column, last_year: Column) -> Column:
    """pass, fail or human of one rule over an answer's citations.

    ``papers``: every cited paper is among ``allowed``; ``years``: every cited
    id is of the years (two digits before the point); ``cited``: every unit
    (``text, ids``) has an id. Without anything to judge, a person has to.
    """
    papers = F.filter(cited, lambda i: F.length(i) < 20)
    year = lambda i: 2000 + F.substring(i, 1, 2).try_cast("int")
    whole = (
        F.when(rule == "papers", F.size(F.array_except(papers, allowed)) == 0)
        .when(rule == "years", F.forall(papers, lambda i: year(i).between(first_year, last_year)))
        .when(rule == "cited", F.forall(units, lambda u: F.size(u["ids"]) > 0))
    )
    nothing = F.when(rule == "cited", F.size(units) == 0).otherwise(F.size(papers) == 0)
    return F.when(whole.isNull() | nothing, "human").when(whole, "pass").otherwise("fail")


def regraded(events: DataFrame, scores: DataFrame) -> DataFrame:
    """The last final verdict that each run recorded (``verdict, confidence`` of
    the stage ``final``) beside a new score (``run_id, score``), and whether a
    threshold of one half turns it."""
    final = F.when((F.col("stage") == "final") & F.col("verdict").isNotNull(), F.col("seq"))
    old = events.groupBy("run_id").agg(F.max_by("verdict", final).alias("old_verdict"), F.max_by("confidence", final).alias("old_score"))
    new = F.when(F.col("score") < 0.5, "pass").otherwise("fail")
    out = old.join(scores, "run_id").withColumn("new_verdict", new)
    return out.withColumn("turned", F.col("old_verdict").isNotNull() & (F.col("old_verdict") != F.col("new_verdict")))


def fork_runs(manifests: DataFrame, forks: DataFrame) -> DataFrame:
    """Manifests of children (``parent_run_id, run_id, query``): the parent's, with
    the child's id, its query where it has one, and nothing spent; all other
    columns, known or not, are the parent's."""
    parent = manifests.drop("parent_run_id").withColumnRenamed("run_id", "parent_run_id").withColumnRenamed("query", "_query")
    out = parent.join(forks, "parent_run_id").withColumn("query", F.coalesce("query", "_query")).drop("_query")
    return out.withColumn("status", F.lit("running")).withColumn("cost_usd", F.lit(0.0))


def wave_cells(cells: DataFrame, recorded: DataFrame, start: str | None = None, through: str | None = None) -> DataFrame:
    """Cells of a plan (``place, cell, arms, queries, repeats``) from one name through
    another, with the runs that they expect, those recorded (``cell, cost``) and whether they are complete."""
    # The bounds are one row; a name that no cell has leaves none.
    rows, ends = cells, [(n, sign) for n, sign in ((start, ">="), (through, "<=")) if n is not None]
    for name, sign in ends:
        bound = cells.agg(F.max(F.when(F.col("cell") == name, F.col("place"))).alias("_end"))
        rows = rows.join(bound, F.expr(f"place {sign} _end")).drop("_end")
    have = recorded.groupBy("cell").agg(F.count("*").alias("runs"), F.sum("cost").alias("cost"))
    out = rows.withColumn("expected", F.col("arms") * F.col("queries") * F.col("repeats")).join(have, "cell", "left")
    out = out.withColumn("runs", F.coalesce("runs", F.lit(0))).withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    return out.withColumn("complete", F.col("runs") >= F.col("expected"))


def companions(runs: DataFrame, prefixes: Sequence[str], since: Column) -> DataFrame:
    """Runs whose name begins with a prefix, changed since a campaign began."""
    named = F.lit(False)
    for p in prefixes:
        named = named | F.startswith(F.col("run_id"), F.lit(p))
    return runs.where(named & (F.col("updated_at") >= since))


def accepted_records(records: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (``task, place, id`` and more) of ids that a task asked for, the
    first of each; and the ids (``task, id``) that no record is of."""
    asked = wanted.select("task", "id").distinct()
    first = Window.partitionBy("task", "id").orderBy("place")
    kept = records.join(asked, ["task", "id"], "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return kept, asked.join(kept.select("task", "id"), ["task", "id"], "left_anti")


def batches(items: Column, size: int, halved: Column | None = None) -> Column:
    """An array in batches of ``size``; those whose number is in ``halved`` in two."""
    n = F.ceil(F.size(items) / F.lit(size)).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(items, k * size + 1, F.lit(size)))
    whole = F.when(n > 0, whole).otherwise(F.slice(whole, 1, 0))
    if halved is None:
        return whole

    def cut(b: Column, k: Column) -> Column:
        half = F.ceil(F.size(b) / 2).cast("int")
        return F.when(F.array_contains(halved, k) & (F.size(b) > 1), F.array(F.slice(b, F.lit(1), half), F.slice(b, half + 1, F.size(b)))).otherwise(F.array(b))

    return F.flatten(F.transform(whole, cut))


def frame_rows(ledgers: DataFrame) -> DataFrame:
    """Frames with their verdicts as flat rows, numbered within the run."""
    return ledgers.select("run_id", F.posexplode("frames").alias("number", "f")).select("run_id", "number", "f.*")


def evidence_set(chunks: DataFrame, tokens: Column, overhead: int = 8) -> DataFrame:
    """Chunks and tokens of each set, with what every entry takes besides."""
    return chunks.groupBy("set_id").agg(F.count("*").alias("chunks"), F.sum(tokens + overhead).alias("tokens"))


def markdown_table(rows: DataFrame, by: str, order: str, columns: Sequence[str], title: Column) -> DataFrame:
    """A Markdown document for each group: a title and a table of its rows, in
    order; bars and line ends in cells are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    body = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("lines"), F.first(title).alias("title"))
    head = f"| {' | '.join(columns)} |\n|{'-|' * len(columns)}"
    return body.select(by, F.concat(F.lit("# "), "title", F.lit(f"\n\n{head}\n"), F.array_join(F.transform("lines", lambda x: x["l"]), "\n"), F.lit("\n")).alias("markdown"))


def pending_targets(failed: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys that failed and are not done since, in order: what is left to fetch."""
    return failed.select(key).distinct().join(done.select(key).distinct(), key, "left_anti").orderBy(key)


def short_fields(papers: DataFrame, most: int = 900) -> DataFrame:
    """Titles and abstracts for a worksheet: collapsed, abstracts cut."""
    return papers.select("arxiv_id", X.collapse(F.coalesce("title", F.lit(""))).alias("title"), F.substring(X.collapse(F.coalesce("abstract", F.lit(""))), 1, most).alias("abstract"))


def head_sample(chunks: DataFrame, papers: int) -> DataFrame:
    """Chunks of the first papers by id."""
    first = chunks.select("arxiv_id").distinct().orderBy("arxiv_id").limit(papers)
    return chunks.join(first, "arxiv_id", "left_semi")


def scored_worksheet(labels: DataFrame, scores: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Labelled pairs (``pair_id, truth``) that have a score (``claim, aggregate``),
    and corrupted variants of them, whose truth is 0; unlabelled and unscored ones are left out."""
    kept = labels.where(F.col("truth").isNotNull()).select("pair_id", F.lit("pair").alias("kind"), "truth")
    if variants is not None:
        kept = kept.unionByName(variants.select("pair_id", F.lit("variant").alias("kind"), F.lit(0).alias("truth")))
    have = scores.where(F.col("claim").isNotNull()).select("pair_id", "claim", "aggregate")
    return kept.join(have, "pair_id")


#: An embedder makes a column of vectors of a text column.
Embedder = Callable[[Column], Column]


def hashing_embedder(dim: int = 64, prefix: str = "") -> Embedder:
    """The default embedder: counts of hashed words, signed, scaled to length one."""

    def embed(text: Column) -> Column:
        words = F.filter(F.split(X.normalize_span(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))), " "), lambda w: w != "")
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        zero = F.array_repeat(F.lit(0.0), dim)

        def add(v: Column, h: Column) -> Column:
            at = F.pmod(h, F.lit(dim)).cast("int")
            return F.transform(v, lambda x, i: F.when(i == at, x + F.when(F.shiftrightunsigned(h, 63) == 0, 1.0).otherwise(-1.0)).otherwise(x))

        counts = F.aggregate(hashes, zero, add)
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: (x / F.greatest(length, F.lit(1e-12))).cast("float"))

    return embed


def embed(rows: DataFrame, text: str, into: str, embedder: Embedder) -> DataFrame:
    return rows.withColumn(into, embedder(F.col(text)))


def normal_entity(c: Column) -> Column:
    """Key of an entity in any script: NFC, white space collapsed, no control characters, case folded."""
    import unicodedata

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        plain = unicodedata.normalize("NFC", " ".join(name.split()))
        return "".join(x for x in plain if unicodedata.category(x) != "Cc").casefold()

    def keys(names: pd.Series) -> pd.Series:
        return names.map(one)

    return F.pandas_udf(keys, T.StringType())(c)


class Registry:
    """Named functions that are called with arguments and answer in an envelope."""

    def __init__(self) -> None:
        self.tools: dict[str, Callable] = {}
        self.events: list[dict] = []

    def register(self, name: str, tool: Callable) -> None:
        if name in self.tools:
            raise ValueError(f"there is a tool {name}")
        self.tools[name] = tool

    def dispatch(self, name: str, args: Mapping[str, object]) -> dict:
        """``ok`` and the result, or the error; never raises. Every call is an event."""
        try:
            if name not in self.tools:
                raise LookupError(f"no tool {name}")
            out = {"ok": True, "result": self.tools[name](**args)}
        except Exception as error:  # noqa: BLE001 (an envelope is the contract)
            out = {"ok": False, "error": f"{type(error).__name__}: {error}"}
        self.events.append({"call_type": "tool", "tool": name, "error": out.get("error")})
        return out


def gold_sheet(triples: DataFrame, n: int, seed: int) -> DataFrame:
    """A worksheet of triples to label: stratified by relation, with a question and empty label columns."""
    from evidentia.functions.answers import clean_surface, triple_question
    from evidentia.operators.evaluation import stratified

    picked = stratified(triples, "relation", n, seed, "ord")
    question = triple_question(clean_surface("head"), F.col("head_type"), F.col("relation"), clean_surface("tail"), F.col("tail_type"), F.col("arxiv_id"))
    blank = {c: F.lit("") for c in ("gold_relation_ok", "gold_head_type_ok", "gold_tail_type_ok", "notes")}
    return picked.withColumn("question", question).withColumns(blank)


def instances(rows: DataFrame, key: str, question: str, answer: str, kind: str, document: str, seed: int) -> DataFrame:
    """Rows of another benchmark as instances of this one: ``instance_id, query, gold, meta``."""
    gold = F.struct(F.col(answer).cast("string").alias("answer"))
    meta = F.struct(F.lit(document).alias("document"), F.lit(seed).alias("seed"), F.col(kind).alias("answer_type"))
    return rows.select(F.concat(F.lit("bridge-"), F.col(key).cast("string")).alias("instance_id"), F.col(question).alias("query"), gold.alias("gold"), meta.alias("meta"))


def arm_fingerprint(settings: Mapping[str, object]) -> dict[str, object]:
    """Settings of an arm in order of their names, and a hash that names them."""
    plain = {k: settings[k] for k in sorted(settings)}
    return {**plain, "fingerprint": hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()}


def query_json(buckets: Column) -> Column:
    """Buckets of a query (``bucket, clauses``) as one JSON object."""
    return F.to_json(F.map_from_entries(F.transform(buckets, lambda b: F.struct(b["bucket"], b["clauses"]))))


def save_state(state: DataFrame, path: str) -> None:
    """Write a run's state; the one before stays until the new one is complete.

    A crash between leaves the new one beside, under ``path`` and ``.new``:
    ``load_state`` reads it there, and the next call puts it in place first.
    """
    spark = state.sparkSession
    jvm = spark._jvm
    target, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())

    def replace() -> None:
        fs.delete(target, True)
        if not fs.rename(new, target):
            raise OSError(f"{path} could not be replaced")

    if not fs.exists(target) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}.new/_SUCCESS")):
        replace()
    state.write.mode("overwrite").parquet(f"{path}.new")
    replace()


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The last state that was saved whole."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.parquet(f"{path}.new")


def query_sample(papers: DataFrame, chunks: DataFrame, vector: Sequence[float], query: str, depth) -> DataFrame:
    """Ids of the chunks that a query's funnel ends with, in its order."""
    from evidentia.operators.retrieval import funnel

    best, _ = funnel(papers, chunks, vector, query, depth)
    return best.select("pos", "chunk_uuid")
