"""Run state on Structured Streaming without a task per run.

The state is kept per run and block of sequence numbers: the distinct events of the block, packed, in whatever order and
however often they came. Every micro-batch emits the new row of each block it touched (``operators.run_blocks``);
composing the newest rows gives limits and states of the runs, equal to those of the batch operators.

A block's row carries its packed events, so the newest rows are also a snapshot from which another stream can go on.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyscope.operators import run_blocks as rb
from tallyscope.operators.journal import SCHEMA_VERSION, TERMINAL_KINDS, copy_order, run_steps
from tallyscope.sources.journal_files import EVENT_KINDS
from tallyscope.streaming.journal_stream import append_batches, newest, read_batches

# State processors travel to the workers by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = f"{rb.BLOCK}, packed binary"
_SPAN = rb.SPAN
_TEXTS = ("status", "current_stage", "done", "workflow_id", "workflow_version", "failure")
_PACKED = pa.schema(
    [("sequence", pa.int64()), ("n", pa.int64()), ("valid", pa.bool_()), ("ended", pa.bool_())]
    + [("stamp", pa.int64()), ("digest", pa.int64()), ("tool", pa.bool_())]
    + [("set_to", pa.float64()), ("raised_to", pa.float64())]
    + [(name, pa.string()) for name in _TEXTS]
)
_NEVER = np.iinfo(np.int64).min


def block_events(events: DataFrame) -> DataFrame:
    """Events as narrow rows with their block: what they do to the run, and whether they may stand in a log at all.

    Events without a run or with a negative or no sequence number can never be accepted and have no block.
    """
    c = F.col
    valid = (c("schema_version") == SCHEMA_VERSION) & c("kind").isin(*EVENT_KINDS)
    checked = events.withColumns(
        {
            "_valid": F.coalesce(valid, F.lit(False)),
            "_stamp": F.coalesce(F.unix_micros("timestamp"), F.lit(_NEVER)),
            "_digest": copy_order(events.columns)["digest"],
        }
    )
    steps = run_steps(checked, "_valid", "_stamp", "_digest")
    return steps.where("run_id is not null and sequence >= 0").select(
        "run_id",
        F.floor(c("sequence") / _SPAN).alias("block"),
        "sequence",
        F.lit(1).cast("long").alias("n"),
        c("_valid").alias("valid"),
        F.coalesce(c("kind").isin(*TERMINAL_KINDS), F.lit(False)).alias("ended"),
        c("_stamp").alias("stamp"),
        c("_digest").alias("digest"),
        F.coalesce(c("kind") == "tool_started", F.lit(False)).alias("tool"),
        c("_set").cast("double").alias("set_to"),
        c("_raise").cast("double").alias("raised_to"),
        c("_status").alias("status"),
        c("_stage").alias("current_stage"),
        c("_done").alias("done"),
        c("_workflow").alias("workflow_id"),
        c("_version").alias("workflow_version"),
        c("_failure").alias("failure"),
    )


Events = dict[str, np.ndarray]

#: Events that are packed as they are.
_FEW = 32


def pack(events: Events) -> bytes:
    batch = pa.record_batch([pa.array(events[f.name], f.type, from_pandas=True) for f in _PACKED], schema=_PACKED)
    sink = io.BytesIO()
    # A few events are no smaller compressed, and a codec for every buffer of them costs most of the time.
    compression = "zstd" if batch.num_rows > _FEW else None
    with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression=compression)) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def unpack(data: bytes) -> Events:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {name: column.to_numpy(zero_copy_only=False) for name, column in zip(_PACKED.names, batch.columns, strict=True)}


def merged(parts: list[Events]) -> Events:
    """One row per sequence number, the counting one of its copies; ``n`` copies, valid if all are."""
    rows = {name: np.concatenate([part[name] for part in parts]) for name in _PACKED.names}
    order = np.lexsort((rows["digest"], rows["stamp"], rows["sequence"]))
    sequence = rows["sequence"][order]
    first = np.flatnonzero(np.diff(sequence, prepend=-1))
    out = {name: values[order[first]] for name, values in rows.items()}
    out["n"] = np.add.reduceat(rows["n"][order], first)
    out["valid"] = np.logical_and.reduceat(rows["valid"][order].astype(bool), first)
    out["ended"] = np.logical_or.reduceat(rows["ended"][order].astype(bool), first)
    return out


def _least(values: np.ndarray, where: np.ndarray, more: int = 0) -> int | None:
    at = np.flatnonzero(where)
    return int(values[at[0]]) + more if len(at) else None


def effect(events: Events, block: int) -> dict:
    """The row of a block from its merged events in order."""
    sequence = events["sequence"]
    expected = block * _SPAN + np.arange(len(sequence))
    gap = _least(expected, sequence != expected)
    if gap is None and len(sequence) < _SPAN:
        gap = block * _SPAN + len(sequence)
    ends = {
        "gap": gap,
        "invalid": _least(sequence, ~events["valid"].astype(bool)),
        "twice": _least(sequence, events["n"] > 1, 1),
        "ended": _least(sequence, events["ended"].astype(bool), 1),
    }
    limit = min([x for x in ends.values() if x is not None], default=(block + 1) * _SPAN)
    count = int(np.searchsorted(sequence, limit))
    known = {name: [x for x in events[name][:count].tolist() if x is not None] for name in _TEXTS}
    set_to, raised = events["set_to"][:count], events["raised_to"][:count]
    sets = np.flatnonzero(~np.isnan(set_to))
    raises = raised[sets[-1] + 1 if len(sets) else 0 :]
    raises = raises[~np.isnan(raises)]
    return {
        **ends,
        **{name: known[name][-1] if known[name] else None for name in _TEXTS if name != "done"},
        "completed_stages": list(dict.fromkeys(known["done"])),
        "set_to": int(set_to[sets[-1]]) if len(sets) else None,
        "raised_to": int(raises.max()) if len(raises) else None,
        "tool_calls": int(events["tool"][:count].astype(bool).sum()),
        "last_sequence": int(sequence[count - 1]) if count else None,
    }


_COLUMNS = [part.split()[0] for part in BLOCK_ROWS.split(", ")]


#: Types of the packed columns in memory; texts are objects. Rows of a block that are merged at once.
_TYPES = {field.name: field.type.to_pandas_dtype() for field in _PACKED if not pa.types.is_string(field.type)}
_AT_ONCE = 4096


def events_of(rows: list[Row]) -> Events:
    """Rows as columns; a missing number is not a number, as in ``unpack``."""
    columns = dict(zip(_PACKED.names, zip(*(tuple(row[name] for name in _PACKED.names) for row in rows)), strict=True))
    return {name: np.array(values, dtype=_TYPES.get(name, object)) for name, values in columns.items()}


class BlockFold(StatefulProcessor):
    """Keeps the packed events of one block of one run. Most runs are small, so a key gets rows, not a frame of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getValueState("events", "packed binary")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.events.update((bytes(initialState["packed"]),))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        stored = self.events.get()
        parts = [unpack(bytes(stored[0]))] if stored else []
        while some := list(islice(rows, _AT_ONCE)):
            parts = [merged([*parts, events_of(some)])]
        (events,) = parts
        packed = pack(events)
        self.events.update((packed,))
        run_id, block = key
        row = {"run_id": run_id, "block": int(block), **effect(events, int(block)), "packed": packed}
        yield Row(*_COLUMNS)(*[row[name] for name in _COLUMNS])

    def close(self) -> None:
        pass


def fold_blocks(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Rows of the blocks that a micro-batch touched (update mode).

    ``snapshot``: the newest block rows of an earlier stream; the new one takes them as its initial state and needs only the events
    after them. Events that the snapshot has already count as copies.
    """
    initial = None if snapshot is None else snapshot.select("run_id", "block", "packed").groupBy("run_id", "block")
    return (
        block_events(events)
        .groupBy("run_id", "block")
        .transformWithState(BlockFold(), BLOCK_ROWS, "Update", "None", initialState=initial)
    )


def run_to_end(events: DataFrame, folder: str, snapshot: DataFrame | None = None) -> DataFrame:
    """Fold what the stream has now; newest row of every block, those that only the snapshot has included."""
    spark = events.sparkSession
    append_batches(fold_blocks(events, snapshot), f"{folder}/blocks", f"{folder}/offsets", "update").awaitTermination()
    rows = newest_blocks(spark, f"{folder}/blocks")
    if snapshot is None:
        return rows
    old = snapshot.select(*rows.columns).join(rows.select("run_id", "block"), ["run_id", "block"], "left_anti")
    return rows.unionByName(old)


def newest_blocks(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.createDataFrame([], BLOCK_ROWS).schema
    return newest(read_batches(spark, path, schema), ["run_id", "block"])
