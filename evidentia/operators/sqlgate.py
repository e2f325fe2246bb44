"""Read-only SQL over registered views, behind a lexical check and a plan check."""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame, SparkSession

from evidentia.config import SQL_ROW_CAP
from evidentia.functions import lexicons as lex

_FORBIDDEN = re.compile(r"\b(" + "|".join(lex.SQL_FORBIDDEN) + r")\b")


def sql_is_allowed(recorded: bool, allow_sql: bool, mode: str = "rlm") -> bool:
    return allow_sql and not recorded and mode == "rlm"


def validate_sql(sql: str | None) -> str:
    """The one read-only statement in ``sql``, without its last semicolon.

    The check is on words: a literal or a column that is a forbidden word is
    refused as well.
    """
    statement = re.sub(r";\s*$", "", (sql or "").strip()).strip()
    low = statement.lower()
    problem = None
    if not statement:
        problem = "no statement"
    elif ";" in statement:
        problem = "more than one statement"
    elif not low.startswith(lex.SQL_PREFIXES):
        problem = "only SELECT and WITH may begin a statement"
    elif found := _FORBIDDEN.search(low):
        problem = f"the word {found.group()} is not allowed"
    if problem:
        raise ValueError(problem)
    return statement


def query_sql(spark: SparkSession, sql: str, row_cap: int = SQL_ROW_CAP) -> DataFrame:
    """Plan a validated statement; a command in its plan is refused too."""
    out = spark.sql(validate_sql(sql))
    if "Command" in out._jdf.queryExecution().analyzed().getClass().getSimpleName():
        raise ValueError("the statement is a command")
    return out.limit(max(1, row_cap))


def collect_within(df: DataFrame, timeout_s: float, group: str = "sql-gate") -> list:
    """Rows of a query whose jobs are cancelled after ``timeout_s``."""
    context = df.sparkSession.sparkContext
    context.setJobGroup(group, "read-only query", interruptOnCancel=True)
    timer = threading.Timer(timeout_s, context.cancelJobGroup, [group])
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
