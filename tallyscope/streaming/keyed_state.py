"""Tasks, agents and recent events as keyed state on Structured Streaming.

Tasks and agents are keyed by themselves, not by their run, so a large run spreads over its tasks and agents. Events of a key
wait in its state until the watermark has passed them and are then taken in order of their sequence numbers, whatever
order the micro-batches brought; a timer wakes keys that have something due and get no more input. Events that come after the watermark are dropped by Spark; an event that is not late but stands before
one already taken is reported and takes no effect.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyscope.operators import journal as jn
from tallyscope.operators.run_blocks import SPAN
from tallyscope.streaming.journal_stream import append_batches, newest, read_batches

# State processors travel to the workers by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Allowed steps of a task, as "event kind, blank, status before it".
_STEPS = frozenset(f"{kind} {status}" for kind, (before, _) in jn.TASK_TRANSITIONS.items() for status in before.split())
PLANNED = jn.PLANNED
_LATE = "event arrived after its successors"


class _InOrder(StatefulProcessor):
    """Hands events of a key on in order once the watermark has passed them."""

    #: Columns of the events, the state of a key, both as DDL; the state before any event; columns of the result after the key.
    events: str
    fields: str
    start: dict
    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [field.split()[0] for field in self.events.split(", ")]
        self.waiting = handle.getListState("waiting", self.events)
        self.folded = handle.getValueState("folded", self.fields)

    def _due(self, rows: list[tuple], watermark: int) -> list[dict]:
        """Waiting and new events that the watermark has passed, in order; the others wait on."""
        held = list(self.waiting.get())
        rows = [*held, *rows]
        sequence, stamp = self.names.index("sequence"), self.names.index("stamp")
        rest = [row for row in rows if row[stamp] > watermark]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(row[stamp] for row in rest))
        elif held:
            self.waiting.clear()
        due = {row[sequence]: row for row in reversed(rows) if row[stamp] <= watermark}
        return [dict(zip(self.names, due[at])) for at in sorted(due)]

    def _taken(self, key: tuple, due: list[dict]) -> Iterator[Row]:
        if not due:
            return
        state = dict(zip(self.start, self.folded.get() or self.start.values()))
        rows = list(self.fold(key, state, due))
        self.folded.update(tuple(state.values()))
        row_of = Row("run_id", "id", *self.out)
        for row in rows:
            yield row_of(*key, *row)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = [tuple(row[name] for name in self.names) for row in rows]
        yield from self._taken(key, self._due(found, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield from self._taken(key, self._due([], watermark))

    def close(self) -> None:
        pass


class TaskFold(_InOrder):
    """Checks each event of a task against the status before it; every row has the state after its event."""

    events = (
        "sequence bigint, stamp bigint, kind string, status_after string, agent_id string, required boolean, "
        "output string, error string, keeps boolean"
    )
    fields = (
        "last bigint, status string, turns bigint, tool_calls bigint, output string, error string, "
        "owner string, required boolean"
    )
    start = {
        "last": -1, "status": "queued", "turns": 0, "tool_calls": 0, "output": None, "error": None, "owner": None, "required": None,
    }
    out = [
        "sequence", "kind", "status_before", "status_after", "problem", "turns", "tool_calls", "output", "error",
        "owner", "required",
    ]

    def fold(self, key: tuple, state: dict, due: list[dict]) -> Iterator[tuple]:
        for event in due:
            kind, before, problem = event["kind"], state["status"], None
            if event["sequence"] <= state["last"]:
                yield event["sequence"], kind, None, None, _LATE, *[None] * 6
                continue
            state["last"] = event["sequence"]
            if kind == PLANNED:
                # An event of the run, not of the task: it checks nothing, and only the first one counts.
                if state["owner"] is None:
                    state.update(owner=event["agent_id"], required=event["required"])
            else:
                if state["owner"] is None:
                    problem = f"unknown task: {key[1]}"
                elif event["agent_id"] is not None and event["agent_id"] != state["owner"]:
                    problem = "event agent does not own task"
                elif f"{kind} {before}" not in _STEPS:
                    problem = f"invalid {kind} transition: {before}"
                state["status"] = event["status_after"]
                state["turns"] += kind == "model_turn_started"
                state["tool_calls"] += kind == "tool_started"
                state["output"] = state["output"] if event["output"] is None else event["output"]
                state["error"] = state["error"] if event["keeps"] else event["error"]
            yield (
                event["sequence"], kind, before, state["status"], problem, state["turns"], state["tool_calls"],
                state["output"], state["error"], state["owner"], state["required"],
            )


def _greater(a: str | None, b: str | None) -> str | None:
    return max((x for x in (a, b) if x is not None), default=None)


class AgentFold(_InOrder):
    """State of an agent after the events that were due; late ones are counted."""

    events = (
        "sequence bigint, stamp bigint, kind string, message string, role string, lane string, status string, "
        "set_to double, raised_to double"
    )
    fields = (
        "last bigint, role string, lane string, status string, progress int, current_task string, tool_calls bigint, "
        "evidence_count bigint, registered boolean, late bigint"
    )
    start = {
        "last": -1, "role": None, "lane": None, "status": None, "progress": 0, "current_task": None, "tool_calls": 0,
        "evidence_count": 0, "registered": False, "late": 0,
    }
    out = [
        "sequence", "role", "lane", "status", "progress", "current_task", "tool_calls", "evidence_count", "registered", "late",
    ]

    def fold(self, key: tuple, state: dict, due: list[dict]) -> list[tuple]:
        for event in due:
            kind = event["kind"]
            if event["sequence"] <= state["last"]:
                state["late"] += 1
                continue
            state["last"] = event["sequence"]
            state["role"], state["lane"] = (_greater(state[name], event[name]) for name in ("role", "lane"))
            state["status"] = event["status"] or state["status"]
            if (given := event["set_to"]) is not None:
                state["progress"] = int(given)
            if (given := event["raised_to"]) is not None and given > state["progress"]:
                state["progress"] = int(given)
            if kind == "agent_registered":
                state["registered"] = True
            else:
                state["current_task"] = event["message"]
            state["tool_calls"] += kind == "tool_started"
            state["evidence_count"] += kind == "evidence_added"
        return [(state["last"], *[state[name] for name in self.out[1:]])]


MOVES = (
    "run_id string, id string, sequence bigint, kind string, status_before string, status_after string, problem string, "
    "turns bigint, tool_calls bigint, output string, error string, owner string, required boolean"
)
AGENTS = (
    "run_id string, id string, sequence bigint, role string, lane string, status string, progress int, "
    "current_task string, tool_calls bigint, evidence_count bigint, registered boolean, late bigint"
)


def _stamped(events: DataFrame, watermark: str) -> DataFrame:
    return events.withWatermark("timestamp", watermark)


def task_moves(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Every event of a task once it is due: status before and after, what is wrong with it, the task's state after it."""
    rows = jn.task_rows(_stamped(events, watermark), "timestamp").withColumnRenamed("task_id", "id")
    keyed = rows.withColumn("stamp", F.unix_millis("timestamp")).groupBy("run_id", "id")
    return keyed.transformWithState(TaskFold(), MOVES, "Append", "EventTime")


def agent_rows(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """State of each agent that had events due in the micro-batch (update mode)."""
    steps = jn.agent_steps(_stamped(events, watermark), "timestamp").select(
        "run_id", F.col("agent_id").alias("id"), "sequence", "timestamp", "kind", "message",
        F.col("_role").alias("role"), F.col("_lane").alias("lane"), F.col("_status").alias("status"),
        F.col("_set").cast("double").alias("set_to"), F.col("_raise").cast("double").alias("raised_to"),
        F.unix_millis("timestamp").alias("stamp"),
    )
    return steps.groupBy("run_id", "id").transformWithState(AgentFold(), AGENTS, "Update", "EventTime")


def moves_to_end(events: DataFrame, folder: str, watermark: str = "0 seconds") -> DataFrame:
    """All moves of what the stream has now."""
    append_batches(task_moves(events, watermark), f"{folder}/moves", f"{folder}/move-offsets").awaitTermination()
    spark = events.sparkSession
    return read_batches(spark, f"{folder}/moves", spark.createDataFrame([], MOVES).schema).drop("batch")


def task_states(moves: DataFrame) -> DataFrame:
    """The rows of ``journal.task_states`` from the moves of a stream."""
    kept = moves.where(F.col("problem").isNull() | (F.col("problem") != _LATE))
    rest = [c for c in kept.columns if c not in ("run_id", "id")]
    after = kept.groupBy("run_id", "id").agg(F.max_by(F.struct(*rest), "sequence").alias("_s")).select("run_id", "id", "_s.*")
    return after.where("owner is not null").select(
        "run_id", F.col("id").alias("task_id"), F.col("owner").alias("agent_id"), "required",
        F.col("status_after").alias("status"), "turns", "tool_calls", "output", "error",
    )


def agents_to_end(events: DataFrame, folder: str, watermark: str = "0 seconds") -> DataFrame:
    """Newest row of every agent of what the stream has now."""
    append_batches(agent_rows(events, watermark), f"{folder}/agents", f"{folder}/agent-offsets", "update").awaitTermination()
    spark = events.sparkSession
    return newest(read_batches(spark, f"{folder}/agents", spark.createDataFrame([], AGENTS).schema), ["run_id", "id"])


def agent_states(agents: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``journal.agent_states``, from a stream's agents and the states of their runs (``run_blocks.states``)."""
    live = F.col("status").isin("queued", "running", "waiting_tool")
    ended = runs.where("status = 'cancelled'").select("run_id", F.lit(True).alias("_cancelled"))
    return agents.where("registered").join(ended, "run_id", "left").select(
        "run_id",
        F.col("id").alias("agent_id"),
        "role",
        "lane",
        F.when(F.col("_cancelled") & live, "cancelled").otherwise(F.col("status")).alias("status"),
        "progress",
        F.coalesce("current_task", F.lit("Awaiting admission")).alias("current_task"),
        "tool_calls",
        "evidence_count",
    )


# --- recent events --------------------------------------------------------------------------------

RING = "run_id string, block bigint, sequence bigint, kind string, timestamp timestamp, message string, agent_id string, payload string"
_STAMPED = RING.replace("timestamp timestamp", "stamp bigint")


def _nulls_first(event: tuple) -> list[tuple]:
    return [(value is not None, value) for value in event]


class RecentRing(StatefulProcessor):
    """The last events of one block of a run, as a list that never holds more than ``count``.

    A block whose newest event is ``keep`` older than the watermark has gone out of the window: its list is dropped.
    """

    def __init__(self, count: int, keep_seconds: float) -> None:
        self.count, self.keep = count, int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = "sequence bigint, kind string, stamp bigint, message string, agent_id string, payload string"
        self.names = [field.split()[0] for field in fields.split(", ")]
        self.ring = handle.getListState("ring", fields)
        self.deadline = handle.getValueState("deadline", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found: dict[int, tuple] = {}
        for event in chain(self.ring.get(), (tuple(row[name] for name in self.names) for row in rows)):
            other = found.get(event[0])
            found[event[0]] = event if other is None else min(other, event, key=_nulls_first)
            if len(found) > 2 * self.count + SPAN:
                found = self._last(found)
        held = self._last(found)
        self.ring.put(list(held.values()))
        at = max(event[2] for event in held.values()) // 1000 + self.keep
        known = self.deadline.get()
        if known is None or known[0] < at:
            self.deadline.update((at,))
            self.handle.registerTimer(at)
        row_of = Row("run_id", "block", *self.names)
        for event in held.values():
            yield row_of(*key, *event)

    def _last(self, found: dict[int, tuple]) -> dict[int, tuple]:
        return {at: found[at] for at in sorted(found)[-self.count :]}

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        known = self.deadline.get()
        if known is not None and expiredTimerInfo.getExpiryTimeInMs() >= known[0]:
            self.ring.clear()
            self.deadline.clear()
        yield from ()

    def close(self) -> None:
        pass


def recent_rings(
    events: DataFrame, count: int = jn.RECENT_EVENTS, watermark: str = "10 minutes", keep_seconds: float = 86_400.0
) -> DataFrame:
    """Rings of the blocks that a micro-batch touched (update mode). Copies of a sequence number are one event.

    A run's window is spread over its blocks of sequence numbers, so a run with very many events is many keys.
    """
    keyed = _stamped(events, watermark).where("run_id is not null and sequence is not null").select(
        "run_id", F.floor(F.col("sequence") / SPAN).alias("block"), "timestamp",
        F.unix_micros("timestamp").alias("stamp"), "sequence", "kind", "message", "agent_id", "payload",
    )
    rings = keyed.groupBy("run_id", "block").transformWithState(RecentRing(count, keep_seconds), _STAMPED, "Update", "EventTime")
    names = [part.split()[0] for part in RING.split(", ")]
    return rings.withColumn("timestamp", F.timestamp_micros("stamp")).select(*names)


def recent_to_end(
    events: DataFrame, folder: str, count: int = jn.RECENT_EVENTS, watermark: str = "0 seconds", keep_seconds: float = 86_400.0
) -> DataFrame:
    """The last ``count`` events of every run of what the stream has now."""
    rings = recent_rings(events, count, watermark, keep_seconds)
    append_batches(rings, f"{folder}/rings", f"{folder}/ring-offsets", "update").awaitTermination()
    spark = events.sparkSession
    rows = read_batches(spark, f"{folder}/rings", spark.createDataFrame([], RING).schema)
    last = rows.groupBy("run_id", "block").agg(F.max("batch").alias("batch"))
    newest_first = Window.partitionBy("run_id").orderBy(F.desc("sequence"))
    kept = rows.join(last, ["run_id", "block", "batch"]).withColumn("_nth", F.row_number().over(newest_first))
    return kept.where(F.col("_nth") <= count).drop("_nth", "batch", "block")
