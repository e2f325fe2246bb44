"""File sources and sinks with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = (
    "id string, title string, authors string, categories string, doi string, `journal-ref` string, update_date string, "
    "abstract string, versions array<struct<version: string>>"
)
MANIFEST = (
    "arxiv_id string, version string, tei_xml string, title string, authors string, categories array<string>, "
    "arxiv_doi string, journal_ref string, update_date string, abstract string"
)
EVENT = (
    "run_id string, trace_id string, step_idx int, timestamp timestamp, actor string, call_type string, action string, "
    "model string, provider string, model_snapshot string, prompt_ref string, completion_ref string, result_ref string, "
    "code_ref string, stdout_ref string, stderr_ref string, args_ref string, reasoning_ref string, result_summary string, "
    "args_hash string, tool string, tokens_in int, tokens_out int, cached_tokens int, reasoning_tokens int, "
    "finish_reason string, latency_ms int, cost_usd double, stage string, confidence double, verdict string, "
    "error string, extra string"
)
REFS = ("prompt_ref", "completion_ref", "result_ref", "code_ref", "stdout_ref", "stderr_ref", "args_ref", "reasoning_ref")
QRELS = "query_id string, doc_id string, rel int"
RANKINGS = "config string, query_id string, rank int, doc_id string"


def json_lines(spark: SparkSession, path: str, schema: str, keep_corrupt: bool = False) -> DataFrame:
    """JSON lines by schema; blank, corrupt and non-object lines are left out.

    Lines are parsed as text, so that whether one is corrupt is known whatever
    columns a query asks for.
    """
    whole = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    body = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    odd = ~F.startswith(F.ltrim("value"), F.lit("{"))
    rows = lines.select(body.alias("r"), odd.alias("odd")).select("r.*", "odd")
    rows = rows.withColumn("_corrupt", F.when(F.col("odd"), F.lit("")).otherwise(F.col("_corrupt"))).drop("odd")
    return rows if keep_corrupt else rows.where("_corrupt is null").drop("_corrupt")


def events(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, EVENT)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, METADATA)


def probe_metadata(spark: SparkSession, path: str, sample: int = 5) -> None:
    """Raise unless the first lines parse and have an id and versions."""
    head = json_lines(spark, path, METADATA, keep_corrupt=True).limit(sample).collect()
    if not head or any(r["_corrupt"] is not None or r["id"] is None or r["versions"] is None for r in head):
        raise ValueError(f"{path} does not look like a metadata file")


def documents_json(spark: SparkSession, path: str, schema: str, inner: str | None = None) -> DataFrame:
    """One JSON document a file, optionally one row for each entry of an array."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.explode(inner).alias("row")).select("row.*") if inner else rows


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("multiLine", True).csv(path)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements; of several for one query and document the highest counts."""
    return csv(spark, path, QRELS).groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))


def rankings(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, RANKINGS)


INSTRUMENT = "instance_id string, instrument string, query string, answer_format string, gold string, meta string"
TRIPLE_SHEET = (
    "id string, head string, head_type string, relation string, tail string, tail_type string, score double, chunk_uuid string, "
    "arxiv_id string, section_type string, gold_relation_ok string, gold_head_type_ok string, gold_tail_type_ok string, notes string"
)
ENTITY_SHEET = "chunk_uuid string, arxiv_id string, section_type string, chunk_text string, gold_entities string, notes string"
POINTS = "points array<struct<name: string, k: int, n: int, C: int, c_top: int>>"
QUERIES = "id string, text string"


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """Instances by line; one without an id is an error when it is read."""
    rows = spark.read.schema(INSTRUMENT).option("mode", "FAILFAST").json(path)
    checked = F.when(F.col("instance_id").isNull(), F.raise_error(F.lit("an instance has no instance_id"))).otherwise(F.col("instance_id"))
    return rows.withColumn("instance_id", checked)


def triple_sheet(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, TRIPLE_SHEET)


def entity_sheet(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, ENTITY_SHEET)


def funnel_points(spark: SparkSession, path: str) -> DataFrame:
    """The grid of a sweep; a point whose final depth is over its wide one is an error."""
    rows = documents_json(spark, path, POINTS, "points")
    wrong = F.col("c_top") > F.col("C")
    return rows.withColumn("c_top", F.when(wrong, F.raise_error(F.lit("a point's c_top is over its C"))).otherwise(F.col("c_top")))


def campaign_queries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Queries of several files, each text once, the first by file and id."""
    parts = [spark.read.schema(QUERIES).option("mode", "FAILFAST").json(p).withColumn("_f", F.lit(k)) for k, p in enumerate(paths)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    first = rows.groupBy("text").agg(F.min(F.struct("_f", "id")).alias("x"))
    return first.select("x.id", "text")


def markup_files(spark: SparkSession, path: str, glob: str = "*.tei.xml") -> DataFrame:
    """Listing of marked-up full texts: ``path`` and file ``name`` alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"))


def markup(spark: SparkSession, path: str, glob: str = "*.tei.xml") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("xml"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Append JSON lines; nulls are left out of them."""
    rows.write.mode("append").option("ignoreNullFields", True).json(path)
