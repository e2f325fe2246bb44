"""Streaming twins of the run log's folds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators.eventlog import counts, turns


def stream_totals(events: DataFrame, *by: str) -> DataFrame:
    """Running totals; write in update or complete mode."""
    return events.groupBy(*by).agg(F.count("*").alias("events"), *counts())


def stream_turns(events: DataFrame) -> DataFrame:
    """Turns of runs that go on (``eventlog.turns``); write in update or complete mode."""
    return turns(events)


def stream_heartbeat(events: DataFrame, stale_s: int) -> DataFrame:
    """``run_id, status, events``: running with every batch that has events of the
    run, interrupted once it gave none for ``stale_s`` seconds of processing time.

    The state of a run is one number. Write in update mode.
    """

    def beat(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["interrupted"], "events": [seen]})
            return
        seen += sum(len(b) for b in batches)
        state.update((seen,))
        state.setTimeoutDuration(stale_s * 1000)
        yield pd.DataFrame({"run_id": [key[0]], "status": ["running"], "events": [seen]})

    return events.groupBy("run_id").applyInPandasWithState(
        beat, "run_id string, status string, events long", "events long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def windowed(events: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Tumbling windows with a watermark: late events within ``late`` still count."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("events"))


def sessions(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("events"))


def stream_state(events: DataFrame) -> DataFrame:
    """Last root chat, executions after it and next sequence number of each run.

    ``events``: run_id, seq, call_type, actor, completion_ref, stdout_ref.
    The state of a run is five scalars, however long its log.
    """

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chat, completion, after, last, out = state.get if state.exists else (-1, None, 0, -1, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            if r.call_type == "chat" and r.actor == "root":
                chat, completion, after, out = int(r.seq), r.completion_ref, 0, None
            elif r.call_type == "exec" and r.seq > chat:
                after, out = after + 1, r.stdout_ref
            last = max(last, int(r.seq))
        state.update((chat, completion, after, last, out))
        yield pd.DataFrame({"run_id": [key[0]], "completion_ref": [completion], "executions": [after], "last_output": [out], "last_seq": [last + 1]})

    return events.groupBy("run_id").applyInPandasWithState(
        fold, "run_id string, completion_ref string, executions int, last_output string, last_seq long",
        "chat long, completion string, executions int, last long, output string", "update", GroupStateTimeout.NoTimeout,
    )
