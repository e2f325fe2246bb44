"""The state of runs as their events come in: ``eventlog.rebuild`` as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session needs for the state of these streams.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
STATE = (
    "run_id string, last_seq long, prompt_ref string, completion_ref string, budget string, "
    "messages array<struct<role:string,content:string>>, emits map<string,string>, tool_results map<string,string>, closed boolean"
)


class RunState(StatefulProcessor):
    """What a run that goes on has to know, however its events are dealt to batches.

    Kept are the last good root chat, the executions after it (a list), the
    last budget, and of every variable and tool call the last good reference (a
    map each). An event that comes late counts by its ``seq``. A run without
    events for ``idle_ms`` of processing time is given once more, closed, and
    forgotten; what comes after that begins anew. ``idle_ms`` of 0 keeps runs.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chat = handle.getValueState("chat", "seq long, prompt_ref string, completion_ref string")
        self.step = handle.getValueState("step", "last long")
        self.budget = handle.getValueState("budget", "seq long, budget string")
        self.outputs = handle.getListState("outputs", "seq long, stdout_ref string, error string")
        self.emits = handle.getMapState("emits", "name string", "seq long, ref string")
        self.tools = handle.getMapState("tools", "name string", "seq long, ref string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        chat = self.chat.get() if self.chat.exists() else (-1, None, None)
        step = self.step.get()[0] if self.step.exists() else -1
        budget = self.budget.get() if self.budget.exists() else (-1, None)
        outputs = {o[0]: tuple(o) for o in self.outputs.get()} if self.outputs.exists() else {}
        chat, budget, known = tuple(chat), tuple(budget), chat[0]
        for frame in rows:
            for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                seq = int(r.seq)
                step = max(step, int(r.step_idx)) if r.step_idx is not None else step
                if r.budget is not None and seq > budget[0]:
                    budget = (seq, r.budget)
                if r.call_type == "chat" and r.actor == "root" and r.error is None and seq > chat[0]:
                    chat = (seq, r.prompt_ref, r.completion_ref)
                elif r.call_type == "exec":
                    outputs[seq] = (seq, r.stdout_ref, r.error)
                elif r.error is None and r.result_ref is not None:
                    held, name = (self.emits, r.var) if r.call_type == "emit" else (self.tools, r.called) if r.call_type == "tool" else (None, None)
                    if held is not None and name is not None and (not held.containsKey((name,)) or held.getValue((name,))[0] < seq):
                        held.updateValue((name,), (seq, r.result_ref))
        after = sorted((o for o in outputs.values() if o[0] > chat[0]), key=lambda o: o[0])
        if chat[0] != known or len(after) != len(outputs) or after:
            self.outputs.put(after) if after else self.outputs.clear()
        self.chat.update(chat)
        self.step.update((step,))
        self.budget.update(budget)
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs()) + self.idle_ms)
        yield self._row(key[0], False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        row = self._row(key[0], True)
        for state in (self.chat, self.step, self.budget, self.outputs, self.emits, self.tools):
            state.clear()
        yield row

    def _row(self, run: str, closed: bool) -> pd.DataFrame:
        _, prompt, completion = self.chat.get()
        said = [{"role": "assistant", "content": completion}] if completion is not None else []
        for _, out, error in self.outputs.get() if self.outputs.exists() else ():
            failed = f"[block failed: {error}]" if error is not None else "[block interrupted; effects unknown]"
            said.append({"role": "user", "content": out if out is not None else failed})
        maps = [dict(sorted((k[0], v[1]) for k, v in m.iterator())) if m.exists() else None for m in (self.emits, self.tools)]
        values = [run, self.step.get()[0] + 1, prompt, completion, self.budget.get()[1], said, *(m or None for m in maps), closed]
        return pd.DataFrame([values], columns=[f.split(":")[0].split()[0] for f in _names()])

    def close(self) -> None:
        pass


def _names() -> list[str]:
    return ["run_id", "last_seq", "prompt_ref", "completion_ref", "budget", "messages", "emits", "tool_results", "closed"]


def stream_rebuild(events: DataFrame, idle_ms: int = 0) -> DataFrame:
    """The state of each run (``STATE``) after every batch that has events of it; write in update mode.

    ``events`` as ``rebuild`` takes them, ``seq`` distinct in a run. The session
    needs ``STATE_STORE``. State lives in the stream's checkpoint, so that a
    stream that starts again goes on where it was.
    """
    shaped = events.select(
        "run_id", F.col("seq").cast("long").alias("seq"), F.col("step_idx").cast("long").alias("step_idx"), "call_type", "actor", "error",
        "prompt_ref", "completion_ref", "stdout_ref", "result_ref", F.get_json_object("extra", "$.budget").alias("budget"),
        F.get_json_object("extra", "$.var").alias("var"), F.concat("tool", F.lit(":"), "args_hash").alias("called"),
    )
    return shaped.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunState(idle_ms), outputStructType=STATE, outputMode="update", timeMode="ProcessingTime" if idle_ms else "None",
    )
