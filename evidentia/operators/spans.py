"""Spans of texts: those of two tables that overlap, and spans in tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a bin.
BIN = 512


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], size: int = BIN, ends: tuple[str, str] = ("start", "stop")) -> DataFrame:
    """Pairs of rows, equal in ``on``, whose spans [start, stop) share a place.

    Spans are dealt to bins of ``size`` places, so that a join key is a bin of
    a text, not a text; a pair meets in every bin that both touch, and is kept
    in the first of them. Empty spans and nulls overlap nothing. Columns of the
    right side that the left has too end in ``_right``.
    """
    start, stop = ends

    def binned(rows: DataFrame, name: str) -> DataFrame:
        first, last = (F.floor(c / size).cast("long") for c in (F.col(start), F.col(stop) - 1))
        real = rows.where(F.col(start) < F.col(stop))
        return real.withColumn(name, first).withColumn("_bin", F.explode(F.sequence(first, last)))

    renamed = right.select(*(F.col(c).alias(f"{c}_right" if c in left.columns and c not in on else c) for c in right.columns))
    r_start, r_stop = (f"{c}_right" if c in left.columns else c for c in ends)
    shifted = renamed.withColumnsRenamed({r_start: start, r_stop: stop})
    theirs = binned(shifted, "_theirs").withColumnsRenamed({start: r_start, stop: r_stop})
    both = binned(left, "_ours").join(theirs, [*on, "_bin"])
    first_common = F.col("_bin") == F.greatest("_ours", "_theirs")
    overlap = (F.col(start) < F.col(r_stop)) & (F.col(r_start) < F.col(stop))
    return both.where(first_common & overlap).drop("_bin", "_ours", "_theirs")


def pieces(rows: DataFrame, on: str, text: str, mark: str) -> DataFrame:
    """``on, nth, start, stop`` of the pieces of each text between ``mark`` (one character, literal)."""
    cut = rows.select(on, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), f"[{mark}]")).alias("nth", "piece"))
    before = Window.partitionBy(on).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long") + 1).over(before), F.lit(0))
    return cut.withColumn("start", start).select(on, "nth", "start", (F.col("start") + F.length("piece")).alias("stop"))


def token_spans(spans: DataFrame, tokens: DataFrame, on: str, span: Sequence[str], token: str = "nth", size: int = BIN) -> DataFrame:
    """``first`` and ``last`` token, and how many, of every span of characters that touches one."""
    theirs = tokens.select(on, F.col(token).alias("_token"), "start", "stop")
    both = overlap_join(spans.select(on, *span, "start", "stop"), theirs, [on], size)

    return both.groupBy(on, *span).agg(F.min("_token").alias("first"), F.max("_token").alias("last"), F.count("*").alias("tokens"))
