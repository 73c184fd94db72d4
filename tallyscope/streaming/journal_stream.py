"""Event log operators on Structured Streaming: ordering per run, run state, upserts, counters.

Arbitrary state needs the RocksDB state store (``session.use_rocksdb_state``). Runs are keyed, so
state and work spread over the shuffle partitions; early events of a run wait in its map state and
never in memory.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tallyscope.operators.journal import RUN_STATUS, SCHEMA_VERSION, TERMINAL_KINDS, event_family
from tallyscope.sources.journal_files import EVENT_COLUMNS, EVENT_KINDS


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


EVENT_SCHEMA = _schema(
    schema_version=T.IntegerType(),
    run_id=T.StringType(),
    sequence=T.LongType(),
    kind=T.StringType(),
    timestamp=T.TimestampType(),
    message=T.StringType(),
    agent_id=T.StringType(),
    payload=T.StringType(),
)
VERDICT_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("reason", T.StringType())])
STATE_SCHEMA = _schema(
    run_id=T.StringType(),
    status=T.StringType(),
    current_stage=T.StringType(),
    progress=T.IntegerType(),
    tool_calls=T.LongType(),
    last_sequence=T.LongType(),
    rejected=T.LongType(),
)
PAYLOAD_SCHEMA = _schema(
    run_id=T.StringType(), id=T.StringType(), sequence=T.LongType(), payload=T.StringType()
)
# State processors travel to the workers by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUT_OF_ORDER = "event sequence does not match expected"
_AFTER_END = "cannot append an event after terminal run state"
_STOPPED = "run stopped at an earlier rejected event"


# Waiting events keep their time in microseconds since the epoch; rows come with or without a zone.
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class _OrderedRuns(StatefulProcessor):
    """Releases the events of a run in sequence order, whatever order the micro-batches bring."""

    def __init__(self, gap_seconds: float) -> None:
        self.gap_millis = int(gap_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "next bigint, closed string, deadline bigint")
        self.waiting = handle.getMapState("waiting", "sequence bigint", "event string")

    def close(self) -> None:
        pass

    def _pack(self, row: Row) -> str:
        values = [row[name] for name in EVENT_COLUMNS]
        if (at := values[4]) is not None:
            micros = (at.replace(tzinfo=at.tzinfo or timezone.utc) - _EPOCH) // timedelta(microseconds=1)
            values[4] = [micros, at.tzinfo is not None]
        return json.dumps(values)

    def _unpack(self, text: str) -> Row:
        values = json.loads(text)
        if values[4] is not None:
            micros, zoned = values[4]
            at = _EPOCH + timedelta(microseconds=micros)
            values[4] = at if zoned else at.replace(tzinfo=None)
        return Row(**dict(zip(EVENT_COLUMNS, values)))

    def _verdicts(self, rows: Iterator[Row], timer_values: Any) -> Iterator[tuple[Row, str | None]]:
        """(event, None) when accepted in order, (event, reason) when refused."""
        nxt, closed, deadline = self._position()
        first, latest = nxt, 0
        for row in rows:
            if row.timestamp is not None:
                latest = max(latest, int(row.timestamp.timestamp() * 1000))
            if closed is not None:
                yield row, closed
            elif row.sequence == nxt:
                reason = _refusal(row)
                yield row, reason
                nxt, closed = _advance(row, nxt, reason)
                while closed is None and self.waiting.containsKey((nxt,)):
                    early = self._unpack(self.waiting.getValue((nxt,))[0])
                    self.waiting.removeKey((nxt,))
                    reason = _refusal(early)
                    yield early, reason
                    nxt, closed = _advance(early, nxt, reason)
            elif row.sequence < nxt or self.waiting.containsKey((row.sequence,)):
                yield row, _OUT_OF_ORDER
                closed = _STOPPED
            else:
                self.waiting.updateValue((row.sequence,), (self._pack(row),))
        if closed is not None:
            yield from self._flush(closed)
        if nxt > first or deadline is None:
            # Progress (or a first gap) restarts the time the run has to close its gap.
            deadline = max(timer_values.getCurrentWatermarkInMs(), latest) + self.gap_millis
        waiting = closed is None and self.waiting.exists()
        if waiting:
            self.handle.registerTimer(deadline)
        self.position.update((nxt, closed, deadline if waiting else None))

    def _position(self) -> tuple[int, str | None, int | None]:
        return self.position.get() if self.position.exists() else (0, None, None)

    def _flush(self, reason: str) -> Iterator[tuple[Row, str]]:
        for key, value in list(self.waiting.iterator()):
            self.waiting.removeKey(key)
            yield self._unpack(value[0]), reason

    def _expired(self, at: int) -> Iterator[tuple[Row, str]]:
        """A gap that is still open when the watermark passes its deadline closes the run."""
        nxt, closed, deadline = self._position()
        if closed is None and deadline is not None and at >= deadline and self.waiting.exists():
            self.position.update((nxt, _STOPPED, None))
            yield from self._flush(_OUT_OF_ORDER)


def _refusal(row: Row) -> str | None:
    if row.schema_version != SCHEMA_VERSION:
        return "unsupported event schema"
    if row.kind not in EVENT_KINDS:
        return "unhandled event kind"
    return None


def _advance(row: Row, nxt: int, reason: str | None) -> tuple[int, str | None]:
    if reason is not None:
        return nxt, _STOPPED
    return nxt + 1, _AFTER_END if row.kind in TERMINAL_KINDS else None


class EventOrder(_OrderedRuns):
    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row, reason in self._verdicts(rows, timerValues):
            yield _verdict_row(row, reason)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for row, reason in self._expired(expiredTimerInfo.getExpiryTimeInMs()):
            yield _verdict_row(row, reason)


def _verdict_row(row: Row, reason: str | None) -> Row:
    return Row(**{name: row[name] for name in EVENT_COLUMNS}, reason=reason)


class RunFold(_OrderedRuns):
    """Current state of each run that had events in the micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState(
            "state", "status string, stage string, progress int, tool_calls bigint, last bigint, rejected bigint"
        )

    def _fold(self, key: Any, verdicts: Iterator[tuple[Row, str | None]]) -> Iterator[Row]:
        found = self.state.get() if self.state.exists() else None
        status, stage, progress, calls, last, refused = found or ("idle", None, 0, 0, -1, 0)
        for row, reason in verdicts:
            if reason is not None:
                refused += 1
                continue
            kind, last = row.kind, row.sequence
            status = RUN_STATUS.get(kind, status)
            payload = json.loads(row.payload or "{}")
            given = payload.get("progress")
            if kind in ("stage_started", "stage_completed"):
                stage = payload.get("stage", stage) if kind == "stage_started" else stage
                progress = max(0, min(100, int(given if given is not None else progress)))
            elif kind == "run_synthesizing":
                stage, progress = "synthesis", max(progress, int(given if given is not None else 82))
            elif kind == "run_completed":
                stage, progress = "human_review", 100
            calls += kind == "tool_started"
        self.state.update((status, stage, progress, calls, last, refused))
        yield Row(
            run_id=key[0],
            status=status,
            current_stage=stage,
            progress=progress,
            tool_calls=calls,
            last_sequence=last,
            rejected=refused,
        )

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        yield from self._fold(key, self._verdicts(rows, timerValues))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._fold(key, self._expired(expiredTimerInfo.getExpiryTimeInMs()))


def _keyed(events: DataFrame, watermark: str):
    return events.select(*EVENT_COLUMNS).withWatermark("timestamp", watermark).groupBy("run_id")


def order_events(events: DataFrame, watermark: str = "10 minutes", gap_seconds: float = 3600.0) -> DataFrame:
    """Every event once, with ``reason`` null when it continues its run and a text when refused."""
    return _keyed(events, watermark).transformWithState(
        EventOrder(gap_seconds), VERDICT_SCHEMA, "Append", "EventTime"
    )


def fold_runs(events: DataFrame, watermark: str = "10 minutes", gap_seconds: float = 3600.0) -> DataFrame:
    """Run state rows, one per touched run and micro-batch (update mode)."""
    return _keyed(events, watermark).transformWithState(RunFold(gap_seconds), STATE_SCHEMA, "Update", "EventTime")


def live_counts(events: DataFrame) -> DataFrame:
    """Events per run and family over the whole stream (update mode)."""
    return events.groupBy("run_id", event_family().alias("family")).agg(F.count(F.lit(1)).alias("events"))


def append_batches(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Run a stream over what is available now; every micro-batch appends Parquet under its own number.

    A batch that is retried after a failure overwrites its own folder, so results are not repeated.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option(
        "basePath", path
    ).parquet(path)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest micro-batch row per key: how update-mode output is read back."""
    kept = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch").alias("_row")).select(*keys, "_row.*")


def upsert_payloads(events: DataFrame, kind: str, id_field: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last payload per run and id of one event kind; read back with :func:`newest_payloads`."""

    def last_of_batch(batch: DataFrame) -> DataFrame:
        rows = batch.where(F.col("kind") == kind).withColumn("id", F.get_json_object("payload", f"$.{id_field}"))
        return rows.where("id is not null").groupBy("run_id", "id").agg(
            F.max("sequence").alias("sequence"), F.max_by("payload", "sequence").alias("payload")
        )

    return append_batches(events, path, checkpoint, prepare=last_of_batch)


def newest_payloads(spark: SparkSession, path: str) -> DataFrame:
    stored = read_batches(spark, path, PAYLOAD_SCHEMA)
    return stored.groupBy("run_id", "id").agg(
        F.max("sequence").alias("sequence"), F.max_by("payload", "sequence").alias("payload")
    )
