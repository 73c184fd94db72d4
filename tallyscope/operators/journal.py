"""Event log operators in batch form: ordering, state, search, counters and lifecycle checks.

Runs are folded with aggregates and one-row-back comparisons per block of sequence numbers, so a
run with a third of all events is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyscope.operators.series import STEPS_PER_BLOCK, block_of, with_previous
from tallyscope.session import settle
from tallyscope.sources.journal_files import EVENT_KINDS

SCHEMA_VERSION = 1
TERMINAL_KINDS = ("run_completed", "run_cancelled", "run_failed")
RECENT_EVENTS = 80
SUMMARY_LENGTH = 96
# Run status after an event kind.
RUN_STATUS = {
    "run_created": "planning",
    "run_started": "running",
    "run_paused": "paused",
    "run_resumed": "running",
    "run_synthesizing": "synthesizing",
    "run_completed": "complete",
    "run_cancelled": "cancelled",
    "run_failed": "failed",
}
# Task events, the statuses they may start from, and the status they lead to.
TASK_TRANSITIONS: dict[str, tuple[str, str]] = {
    "task_started": ("queued", "running"),
    "model_turn_started": ("running", "waiting_model"),
    "model_turn_completed": ("waiting_model", "running"),
    "action_rejected": ("running", "running"),
    "tool_started": ("running", "waiting_tool"),
    "tool_completed": ("waiting_tool", "running"),
    "tool_rejected": ("waiting_tool", "running"),
    "tool_failed": ("waiting_tool", "running"),
    "task_completed": ("running", "complete"),
    "task_failed": ("running waiting_model waiting_tool", "failed"),
    "task_skipped": ("queued", "skipped"),
}
TASK_TERMINAL = ("complete", "partial", "failed", "skipped")
TASK_SUCCESS = ("complete", "partial")
# Agent status after an event kind.
AGENT_STATUS = {
    "agent_registered": "queued",
    "agent_started": "running",
    "agent_progress": "running",
    "agent_completed": "complete",
    "agent_failed": "failed",
    "tool_started": "waiting_tool",
    "tool_completed": "running",
    "tool_rejected": "running",
    "tool_failed": "running",
}
_STAGES = ("universe", "evidence", "analysis", "synthesis", "human_review")


def lookup(column: Column, table: dict[str, str]) -> Column:
    value = F.lit(None).cast("string")
    for key, result in table.items():
        value = F.when(column == key, result).otherwise(value)
    return value


def event_family(kind: Column | str = "kind") -> Column:
    return F.substring_index(kind, "_", 1)


def payload_text(name: str) -> Column:
    """Top-level payload field as text; null when absent or JSON null."""
    return F.get_json_object("payload", f"$.{name}")


# --- order ----------------------------------------------------------------------------------------


class Sequenced(NamedTuple):
    """``accepted``: the replayable prefix of each run; ``rejected``: the other events with a reason
    and how many equal-sequence copies were refused."""

    accepted: DataFrame
    rejected: DataFrame


def copy_order(columns: Sequence[str]) -> Column:
    """Which of several events with one sequence number counts: the earliest, then the least digest."""
    text = [n for n in ("message", "kind", "payload") if n in columns]
    parts = [F.col("timestamp")] if "timestamp" in columns else []
    return F.struct(*parts, F.xxhash64(*text).alias("digest"), *text)


def _one_per_sequence(events: DataFrame) -> DataFrame:
    """One row per run and sequence with the number of copies; copies combine on the map side."""
    c = F.col
    valid = (c("schema_version") == SCHEMA_VERSION) & c("kind").isin(*EVENT_KINDS)
    order = copy_order(events.columns)
    rest = [n for n in events.columns if n not in ("run_id", "sequence")]
    return events.groupBy("run_id", "sequence").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.coalesce(valid, F.lit(False))).alias("_valid"),
        F.bool_or(c("kind").isin(*TERMINAL_KINDS)).alias("_terminal"),
        F.min_by(F.struct(*rest), order).alias("_row"),
    )


def run_limits(once: DataFrame) -> DataFrame:
    """Per run the number of events that can be replayed, and what ends the prefix."""
    c = F.col
    once = once.where("sequence >= 0").select("run_id", "sequence", "_n", "_valid", "_terminal")
    block = F.floor(c("sequence") / STEPS_PER_BLOCK)
    inside = Window.partitionBy("run_id", "_block").orderBy("sequence")
    placed = once.withColumn("_block", block).withColumn("_nth", F.row_number().over(inside))
    start = c("_block") * STEPS_PER_BLOCK
    expected = start + c("_nth") - 1
    blocks = placed.groupBy("run_id", "_block").agg(
        F.coalesce(F.min(F.when(c("sequence") != expected, expected)), F.max(expected) + 1).alias("_missing"),
        F.min(F.when(~c("_valid"), c("sequence"))).alias("_invalid"),
        F.min(F.when(c("_n") > 1, c("sequence"))).alias("_twice"),
        F.min(F.when(c("_terminal"), c("sequence"))).alias("_end"),
    )
    ordered = Window.partitionBy("run_id").orderBy("_block")
    numbered = blocks.withColumn("_rank", F.row_number().over(ordered) - 1)
    gap = F.when(c("_block") != c("_rank"), c("_rank") * STEPS_PER_BLOCK).when(
        c("_missing") < (c("_block") + 1) * STEPS_PER_BLOCK, c("_missing")
    )
    per_run = numbered.groupBy("run_id").agg(
        F.coalesce(F.min(gap), F.max("_missing")).alias("_gap"),
        F.min("_invalid").alias("_invalid"),
        (F.min("_twice") + 1).alias("_twice"),
        (F.min("_end") + 1).alias("_end"),
    )
    return per_run.select(
        "run_id", F.least("_gap", "_invalid", "_twice", "_end").alias("limit"), "_gap", "_invalid", "_twice", "_end"
    )


def check_sequence(events: DataFrame, limits: DataFrame | None = None) -> Sequenced:
    """Each run must count 0, 1, 2, ... in known kinds, and nothing may follow its terminal event.

    ``limits``: the limits of the runs if they are known, such as those composed of a stream's blocks.
    """
    c = F.col
    once = _one_per_sequence(events)
    joined = once.join(run_limits(once) if limits is None else limits, "run_id", "left")
    ok = F.coalesce((c("sequence") >= 0) & (c("sequence") < c("limit")), F.lit(False))
    reason = (
        F.when(c("sequence") < 0, "event sequence does not match expected")
        .when(ok, "event sequence does not match expected")
        .when(c("_row.schema_version") != SCHEMA_VERSION, "unsupported event schema")
        .when(~c("_row.kind").isin(*EVENT_KINDS), "unhandled event kind")
        .when(
            (c("sequence") >= c("_end")) & (c("_end") == c("limit")), "cannot append an event after terminal run state"
        )
        .when(c("sequence") >= c("_gap"), "event sequence does not match expected")
        .otherwise("run stopped at an earlier rejected event")
    )
    flat = joined.withColumn("_ok", ok).select("run_id", "sequence", "_row.*", "_n", "_ok", reason.alias("reason"))
    copies = (c("_n") - c("_ok").cast("int")).alias("copies")
    accepted = flat.where("_ok").select(*events.columns)
    rejected = flat.select(*events.columns, "reason", copies).where("copies > 0")
    return Sequenced(accepted, rejected)


def recent_events(events: DataFrame, count: int = RECENT_EVENTS) -> DataFrame:
    """Last events per run; Spark keeps only ``count`` rows per run before the shuffle."""
    newest = Window.partitionBy("run_id").orderBy(F.col("sequence").desc())
    return events.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= count).drop("_nth")


# --- state ----------------------------------------------------------------------------------------


def _set_then_raise(events: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Value after events that set (``_set``) or raise (``_raise``) it, starting at 0.

    Only raises after the last set count, so the fold is two aggregates.
    """
    c = F.col
    last = events.groupBy(*keys).agg(
        F.max(F.when(c("_set").isNotNull(), c("sequence"))).alias("_at"),
        F.max_by("_set", F.when(c("_set").isNotNull(), c("sequence"))).alias("_base"),
    )
    raises = events.where("_raise is not null").join(last, list(keys)).where(
        c("_at").isNull() | (c("sequence") > c("_at"))
    ).groupBy(*keys).agg(F.max("_raise").alias("_top"))
    return last.join(raises, list(keys), "left").select(
        *keys, F.greatest(F.coalesce("_base", F.lit(0)), F.coalesce("_top", F.lit(0))).alias(out)
    )


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


def _number(name: str) -> Column:
    return payload_text(name).try_cast("double").cast("int")


def run_steps(events: DataFrame, *others: str) -> DataFrame:
    """What each event does to the state of its run, as narrow columns; null where it changes nothing. Keeps ``others``."""
    kind = F.col("kind")
    status = lookup(kind, RUN_STATUS)
    stage = (
        F.when(kind == "stage_started", payload_text("stage"))
        .when(kind == "run_synthesizing", "synthesis")
        .when(kind == "run_completed", "human_review")
    )
    done = F.when(kind == "stage_completed", payload_text("stage")).when(kind == "run_completed", "synthesis")
    return events.select(
        "run_id",
        "sequence",
        "kind",
        *others,
        status.alias("_status"),
        stage.alias("_stage"),
        F.when(done.isin(*_STAGES), done).alias("_done"),
        F.when(kind == "run_failed", F.coalesce(payload_text("error"), "message")).alias("_failure"),
        F.when(kind == "workflow_planned", payload_text("workflow_id")).alias("_workflow"),
        F.when(kind == "workflow_planned", payload_text("workflow_version")).alias("_version"),
        F.when(kind.isin("stage_started", "stage_completed"), _clamp(_number("progress")))
        .when(kind == "run_completed", 100)
        .alias("_set"),
        F.when(kind == "run_synthesizing", F.coalesce(_number("progress"), F.lit(82))).alias("_raise"),
    )


def run_states(events: DataFrame) -> DataFrame:
    """One row per run: status, stage, completed stages, progress, workflow, failure, last sequence."""
    c = F.col
    at = c("sequence")
    narrow = run_steps(events)

    def last(column: str) -> Column:
        return F.max_by(column, F.when(c(column).isNotNull(), at))

    states = narrow.groupBy("run_id").agg(
        F.coalesce(last("_status"), F.lit("idle")).alias("status"),
        last("_stage").alias("current_stage"),
        last("_workflow").alias("workflow_id"),
        last("_version").alias("workflow_version"),
        last("_failure").alias("failure"),
        F.max("sequence").alias("last_sequence"),
    )
    stages = (
        narrow.where("_done is not null")
        .groupBy("run_id", "_done")
        .agg(F.min("sequence").alias("_first"))
        .groupBy("run_id")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_first", "_done"))), lambda x: x["_done"]).alias(
                "completed_stages"
            )
        )
    )
    progress = _set_then_raise(narrow.select("run_id", "sequence", "_set", "_raise"), ["run_id"], "progress")
    return states.join(progress, "run_id").join(stages, "run_id", "left").withColumn(
        "completed_stages", F.coalesce("completed_stages", F.array().cast("array<string>"))
    )


_PLAN = (
    "struct<workflow_id:string,tasks:array<struct<task_id:string,agent_id:string,depends_on:array<string>,"
    "required:boolean,allow_failed_dependencies:boolean>>>"
)


def plan_rows(events: DataFrame) -> DataFrame:
    """Tasks of the first plan of each run: run_id, planned_at, task_id, agent_id, depends_on, flags."""
    plans = events.where("kind = 'workflow_planned'").groupBy("run_id").agg(
        F.min("sequence").alias("planned_at"), F.min_by("payload", "sequence").alias("payload")
    )
    return (
        plans.select("run_id", "planned_at", F.explode(F.from_json("payload", _PLAN)["tasks"]).alias("_t"))
        .select("run_id", "planned_at", "_t.*")
        .withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
        .withColumn("allow_failed_dependencies", F.coalesce("allow_failed_dependencies", F.lit(False)))
    )


def plan_problems(events: DataFrame) -> DataFrame:
    """run_id, sequence, problem of plans that are repeated, empty or inconsistent."""
    c = F.col
    tasks = plan_rows(events)
    planned = events.where("kind = 'workflow_planned'")
    twice = (
        planned.groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set("sequence")).alias("_s"))
        .where("_n > 1")
        .select("run_id", F.element_at("_s", 2).alias("sequence"), F.lit("workflow already planned").alias("problem"))
    )
    empty = planned.where(F.coalesce(F.size(F.from_json("payload", _PLAN)["tasks"]) <= 0, F.lit(True))).select(
        "run_id", "sequence", F.lit("workflow_planned tasks must be a non-empty list").alias("problem")
    )
    at = c("planned_at").alias("sequence")
    unnamed = tasks.where(F.coalesce(F.trim("task_id") == "", F.lit(True)) | F.coalesce(F.trim("agent_id") == "", F.lit(True)) | c("required").isNull())
    repeated = tasks.groupBy("run_id", "planned_at", "task_id").count().where("count > 1")
    edges = tasks.select("run_id", "planned_at", "task_id", F.explode("depends_on").alias("dependency"))
    unknown = edges.join(
        tasks.select("run_id", c("task_id").alias("dependency")), ["run_id", "dependency"], "left_anti"
    )
    doubled = tasks.where(F.size("depends_on") != F.size(F.array_distinct("depends_on")))
    parts = [
        (unnamed, "task needs task_id, agent_id and required"),
        (repeated, "duplicate task"),
        (unknown, "task has unknown dependencies"),
        (doubled, "task has duplicate dependencies"),
    ]
    found = twice.unionByName(empty)
    for rows, text in parts:
        found = found.unionByName(rows.select("run_id", at, F.lit(text).alias("problem")))
    return found.distinct()


def _status_after() -> Column:
    """Status of a task after the event."""
    after = lookup(F.col("kind"), {k: t[1] for k, t in TASK_TRANSITIONS.items()})
    partial = payload_text("partial") == "true"
    return F.when((F.col("kind") == "task_completed") & partial, "partial").otherwise(after)


def _task_results() -> tuple[Column, Column, Column]:
    """Output that a task event brings, its error, and whether it leaves the error before it as it is."""
    kind = F.col("kind")
    given = F.coalesce(payload_text("error"), payload_text("reason"), F.col("message"))
    failing = kind.isin("action_rejected", "tool_rejected", "tool_failed", "task_failed", "task_skipped")
    partial_done = (kind == "task_completed") & (F.col("status_after") == "partial")
    error = F.when(failing, given).when(kind == "task_completed", payload_text("error"))
    output = F.when(
        kind.isin("model_turn_completed", "action_rejected", "task_completed", "task_failed"), payload_text("output")
    )
    return output, error, partial_done & payload_text("error").isNull()


CYCLE, BEHIND_CYCLE = "workflow dependency cycle", "task waits for a dependency cycle"

#: Tasks and dependencies of a plan that is peeled inside a task.
SMALL_PLAN = 4096
_LEVELS = "run_id string, task_id string, level int, problem string"


def plan_levels(tasks: DataFrame, small: int = SMALL_PLAN) -> DataFrame:
    """``run_id, task_id, level, problem`` of every task of all plans (``run_id, task_id, depends_on``).

    Level 0 depends on nothing, any other level on the one before it at least. Tasks are peeled off level by level. What cannot be
    peeled stands on a cycle or waits for one: it has no level, and peeling it from the other end tells the two apart.
    Dependencies that are not in the plan, which :func:`plan_problems` reports, hold nothing back; tasks without a run or an id
    have no dependencies.

    Plans of at most ``small`` tasks and dependencies are dealt out by run and peeled where they are. Larger ones are peeled together by
    joins, so no task holds one; the number of rounds is the depth of the deepest of them.
    """
    c = F.col
    ids = [c(name).cast(tasks.schema[name].dataType) for name in ("run_id", "task_id")]
    rows = settle(tasks.select(c("run_id").cast("string"), c("task_id").cast("string"), "depends_on"))
    size = F.sum(1 + F.coalesce(F.array_size("depends_on"), F.lit(0)))
    large = settle(rows.groupBy("run_id").agg(size.alias("size")).where(c("run_id").isNotNull() & (c("size") > small)).select("run_id"))
    none = large.isEmpty()
    few = rows if none else rows.join(large, "run_id", "left_anti")
    dealt = few.where("run_id is not null").repartition("run_id").sortWithinPartitions("run_id")
    levels = dealt.mapInArrow(_small_levels, _LEVELS)
    lost = rows.where("run_id is null").select("run_id", "task_id", F.lit(0).alias("level"), F.lit(None).cast("string").alias("problem")).distinct()
    if not none:
        levels = levels.unionByName(_joined_levels(rows.join(large, "run_id", "left_semi")))
    return levels.unionByName(lost).select(*ids, "level", "problem")


def _small_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of whole plans, from rows in the order of their runs."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
    found: list[tuple] = []
    for run, own in groupby(rows, key=itemgetter(0)):
        plan: dict[str | None, set[str]] = {}
        for _, task, needs in own:
            plan.setdefault(task, set()).update(() if task is None else needs or ())
        found += [(run, task, *place) for task, place in levels_of(plan).items()]
        if len(found) >= 10_000:
            yield _level_batch(found)
            found = []
    yield _level_batch(found)


def _level_batch(found: list[tuple]) -> pa.RecordBatch:
    types = {"run_id": pa.string(), "task_id": pa.string(), "level": pa.int32(), "problem": pa.string()}
    columns = zip(*found) if found else ([] for _ in types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def levels_of(plan: dict[str | None, set[str]]) -> dict[str | None, tuple[int | None, str | None]]:
    """Level and problem of each task of one plan, from the tasks that each depends on."""
    open_needs = {task: {need for need in needs if need is not None and need in plan} for task, needs in plan.items()}
    waiting: dict[str | None, list] = {}
    for task, needs in open_needs.items():
        for need in needs:
            waiting.setdefault(need, []).append(task)
    out: dict[str | None, tuple[int | None, str | None]] = {}
    left = {task: len(needs) for task, needs in open_needs.items()}
    free, level = [task for task, count in left.items() if not count], 0
    while free:
        out |= {task: (level, None) for task in free}
        after = []
        for task in free:
            for other in waiting.get(task, ()):
                left[other] -= 1
                if not left[other]:
                    after.append(other)
        free, level = after, level + 1
    stuck = {task for task in plan if task not in out}
    held = {task: sum(other in stuck for other in waiting.get(task, ())) for task in stuck}
    free = [task for task, count in held.items() if not count]
    out |= {task: (None, CYCLE) for task in stuck}
    while free:
        task = free.pop()
        out[task] = (None, BEHIND_CYCLE)
        for need in open_needs[task] & stuck:
            held[need] -= 1
            if not held[need]:
                free.append(need)
    return out


def _joined_levels(tasks: DataFrame) -> DataFrame:
    """The rows of ``plan_levels`` by joins, one round per level of all plans at once."""
    node = ["run_id", "task_id"]
    nodes = settle(tasks.select(*node).distinct())
    named = tasks.select(*node, F.explode(F.array_distinct("depends_on")).alias("dependency"))
    known = nodes.withColumnRenamed("task_id", "dependency")
    edges = settle(named.join(known, ["run_id", "dependency"], "left_semi").distinct())
    levels, rest, left = _peeled(nodes, edges, "task_id", "dependency")
    _, knots, _ = _peeled(rest, left, "dependency", "task_id")
    stuck = rest.join(knots.withColumn("_knot", F.lit(True)), node, "left").select(
        *node,
        F.lit(None).cast("int").alias("level"),
        F.when(F.col("_knot"), CYCLE).otherwise(BEHIND_CYCLE).alias("problem"),
    )
    return levels.withColumn("problem", F.lit(None).cast("string")).unionByName(stuck)


def _peeled(nodes: DataFrame, edges: DataFrame, held: str, by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with their level, nodes that stay, edges between them): nodes that no edge holds go, round by round."""
    node, level, done = ["run_id", "task_id"], 0, None
    while True:
        holding = edges.select("run_id", F.col(held).alias("task_id")).distinct()
        free = nodes.join(holding, node, "left_anti").withColumn("level", F.lit(level))
        done = free if done is None else done.unionByName(free)
        if free.isEmpty():
            return done, nodes, edges
        nodes = settle(nodes.join(holding, node, "left_semi"))
        edges = settle(edges.join(free.select("run_id", F.col("task_id").alias(by)), ["run_id", by], "left_anti"))
        level += 1


#: Kind of the rows that :func:`task_rows` makes of a plan.
PLANNED = "planned"


def task_rows(events: DataFrame, *others: str) -> DataFrame:
    """Task events, and one row per task of each plan event; needs no other event. Keeps ``others``."""
    c = F.col
    output, error, keeps = _task_results()
    none = F.lit(None).cast("string")
    names = ("task_id", "kind", "status_after", "agent_id", "required", "output", "error", "keeps")

    def row(*values: Column) -> Column:
        return F.struct(*[value.alias(name) for value, name in zip(values, names, strict=True)])

    own = row(payload_text("task_id"), c("kind"), c("status_after"), c("agent_id"), F.lit(None).cast("boolean"), output, error, keeps)
    tasks = F.from_json("payload", _PLAN)["tasks"]
    planned = F.transform(
        tasks, lambda t: row(t["task_id"], F.lit(PLANNED), none, t["agent_id"], t["required"], none, none, F.lit(True))
    )
    scoped = events.where(c("kind").isin("workflow_planned", *TASK_TRANSITIONS)).withColumn("status_after", _status_after())
    rows = F.when(c("kind") == "workflow_planned", planned).otherwise(F.array(own))
    return scoped.select("run_id", "sequence", *others, F.inline(rows)).where("task_id is not null")


def task_events(events: DataFrame) -> DataFrame:
    """Task-scoped events with the status before and after each one."""
    scoped = events.where(F.col("kind").isin(*TASK_TRANSITIONS)).withColumn("task_id", payload_text("task_id"))
    staged = scoped.where("task_id is not null").withColumn("status_after", _status_after())
    paired = with_previous(staged, ["run_id", "task_id"], ["sequence"], ["status_after"])
    return paired.withColumn("status_before", F.coalesce("previous_status_after", F.lit("queued"))).drop(
        "previous_status_after", "_block"
    )


def task_problems(events: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """run_id, sequence, task_id, problem: bad transitions, owners, dependencies, open tasks at the end."""
    c = F.col
    moves = task_events(events) if moves is None else moves
    tasks = plan_rows(events)
    allowed = F.lit(None).cast("array<string>")
    for kind, (sources, _) in TASK_TRANSITIONS.items():
        allowed = F.when(c("kind") == kind, F.array(*[F.lit(s) for s in sources.split()])).otherwise(allowed)
    owned = moves.join(tasks.select("run_id", "task_id", c("agent_id").alias("_owner")), ["run_id", "task_id"], "left")
    problem = (
        F.when(c("_owner").isNull(), F.concat(F.lit("unknown task: "), c("task_id")))
        .when(c("agent_id").isNotNull() & (c("agent_id") != c("_owner")), "event agent does not own task")
        .when(
            ~F.array_contains(allowed, c("status_before")),
            F.concat(F.lit("invalid "), c("kind"), F.lit(" transition: "), c("status_before")),
        )
    )
    direct = owned.withColumn("problem", problem).where("problem is not null").select("run_id", "sequence", "task_id", "problem")

    finished = moves.where(c("status_after").isin(*TASK_TERMINAL)).groupBy("run_id", "task_id").agg(
        F.min("sequence").alias("_done_at"), F.min_by("status_after", "sequence").alias("_done")
    )
    starts = moves.where("kind = 'task_started'").select("run_id", "task_id", "sequence")
    needs = (
        starts.join(tasks.select("run_id", "task_id", "depends_on", "allow_failed_dependencies"), ["run_id", "task_id"])
        .select("run_id", "task_id", "sequence", "allow_failed_dependencies", F.explode("depends_on").alias("dependency"))
        .join(finished.withColumnRenamed("task_id", "dependency"), ["run_id", "dependency"], "left")
    )
    met = (c("_done_at") < c("sequence")) & (c("allow_failed_dependencies") | c("_done").isin(*TASK_SUCCESS))
    early = needs.where(~F.coalesce(met, F.lit(False))).select(
        "run_id", "sequence", "task_id", F.lit("started before dependencies completed").alias("problem")
    ).distinct()

    ends = events.where("kind = 'workflow_completed'").select("run_id", "sequence")
    open_tasks = (
        tasks.join(ends, "run_id")
        .join(finished, ["run_id", "task_id"], "left")
        .where(c("_done_at").isNull() | (c("_done_at") > c("sequence")))
        .select("run_id", "sequence", "task_id", F.lit("workflow completed with non-terminal tasks").alias("problem"))
    )
    unplanned = ends.join(tasks.select("run_id").distinct(), "run_id", "left_anti").select(
        "run_id", "sequence", F.lit(None).cast("string").alias("task_id"),
        F.lit("workflow_completed requires a planned workflow").alias("problem"),
    )
    return direct.unionByName(early).unionByName(open_tasks).unionByName(unplanned)


def task_states(events: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """One row per planned task: status, turns, tool_calls, output, error."""
    c = F.col
    moves = task_events(events) if moves is None else moves
    kind, at = c("kind"), c("sequence")
    output, error, keeps = _task_results()
    folded = moves.groupBy("run_id", "task_id").agg(
        F.max_by("status_after", "sequence").alias("status"),
        F.count_if(kind == "model_turn_started").alias("turns"),
        F.count_if(kind == "tool_started").alias("tool_calls"),
        F.max_by(output, F.when(output.isNotNull(), at)).alias("output"),
        F.max_by(F.struct(error.alias("e")), F.when(~keeps, at))["e"].alias("error"),
    )
    planned = plan_rows(events).select("run_id", "task_id", "agent_id", "required")
    zero = F.lit(0).cast("long")
    return planned.join(folded, ["run_id", "task_id"], "left").select(
        "run_id",
        "task_id",
        "agent_id",
        "required",
        F.coalesce("status", F.lit("queued")).alias("status"),
        F.coalesce("turns", zero).alias("turns"),
        F.coalesce("tool_calls", zero).alias("tool_calls"),
        "output",
        "error",
    )


def agent_steps(events: DataFrame, *others: str) -> DataFrame:
    """What each event does to the state of its agent, as narrow columns; null where it changes nothing. Keeps ``others``."""
    c = F.col
    kind = c("kind")
    in_task = c("kind").isin(*TASK_TRANSITIONS) & payload_text("task_id").isNotNull()
    return events.where(
        c("agent_id").isNotNull() & (c("kind").isin(*AGENT_STATUS, "evidence_added") | in_task)
    ).select(
        "run_id",
        "agent_id",
        "sequence",
        "kind",
        "message",
        *others,
        F.when(kind == "agent_registered", payload_text("role")).alias("_role"),
        F.when(kind == "agent_registered", payload_text("lane")).alias("_lane"),
        F.when(kind == "evidence_added", None)
        .when(in_task & (kind != "tool_started"), "running")
        .otherwise(lookup(kind, AGENT_STATUS))
        .alias("_status"),
        F.when(kind == "agent_completed", 100)
        .when(kind == "agent_progress", _clamp(_number("progress")))
        .alias("_set"),
        F.when(kind == "agent_started", F.coalesce(_number("progress"), F.lit(5))).alias("_raise"),
    )


def agent_states(events: DataFrame) -> DataFrame:
    """One row per registered agent: role, lane, status, progress, tool_calls, evidence_count, task."""
    c = F.col
    kind, at = c("kind"), c("sequence")
    touched = agent_steps(events)
    keys = ["run_id", "agent_id"]
    folded = touched.groupBy(*keys).agg(
        F.max("_role").alias("role"),
        F.max("_lane").alias("lane"),
        F.max_by("_status", F.when(c("_status").isNotNull(), at)).alias("_status"),
        F.max_by("message", F.when(kind != "agent_registered", at)).alias("current_task"),
        F.count_if(kind == "tool_started").alias("tool_calls"),
        F.count_if(kind == "evidence_added").alias("evidence_count"),
        F.count_if(kind == "agent_registered").alias("_registered"),
    ).where("_registered > 0")
    progress = _set_then_raise(touched.select(*keys, "sequence", "_set", "_raise"), keys, "progress")
    cancelled = events.where("kind = 'run_cancelled'").select("run_id", F.lit(True).alias("_cancelled")).distinct()
    live = c("_status").isin("queued", "running", "waiting_tool")
    return (
        folded.join(progress, keys)
        .join(cancelled, "run_id", "left")
        .select(
            *keys,
            "role",
            "lane",
            F.when(c("_cancelled") & live, "cancelled").otherwise(c("_status")).alias("status"),
            "progress",
            F.coalesce("current_task", F.lit("Awaiting admission")).alias("current_task"),
            "tool_calls",
            "evidence_count",
        )
    )


def latest_payloads(events: DataFrame, kind: str, id_field: str) -> DataFrame:
    """Last payload per run and id of one event kind (evidence_added, candidate_updated)."""
    rows = events.where(F.col("kind") == kind).withColumn("id", payload_text(id_field)).where("id is not null")
    return rows.groupBy("run_id", "id").agg(
        F.max("sequence").alias("sequence"),
        F.max_by("payload", "sequence").alias("payload"),
        F.max_by("agent_id", "sequence").alias("agent_id"),
    )


class Replay(NamedTuple):
    runs: DataFrame
    tasks: DataFrame
    agents: DataFrame
    evidence: DataFrame
    candidates: DataFrame
    problems: DataFrame


def replay(events: DataFrame) -> Replay:
    """Whole log to final state. A run is folded up to its first problem; problems are listed.

    The accepted prefix feeds every table, so it is settled once, as is the (small) problem list.
    """
    c = F.col
    ordered = check_sequence(events)
    accepted = settle(ordered.accepted)
    moves = task_events(accepted)
    first_kind = accepted.where("sequence = 0 and kind <> 'run_created'").select(
        "run_id", "sequence", F.lit("journal must begin with run_created").alias("problem")
    )
    problems = settle(
        ordered.rejected.select("run_id", "sequence", c("reason").alias("problem"))
        .unionByName(first_kind)
        .unionByName(plan_problems(accepted))
        .unionByName(task_problems(accepted, moves).select("run_id", "sequence", "problem"))
    )
    cut = problems.groupBy("run_id").agg(F.min("sequence").alias("_cut"))

    def before_cut(rows: DataFrame) -> DataFrame:
        joined = rows.join(cut, "run_id", "left").where(c("_cut").isNull() | (c("sequence") < c("_cut")))
        return joined.select(*rows.columns)

    usable = before_cut(accepted)
    return Replay(
        run_states(usable),
        task_states(usable, before_cut(moves)),
        agent_states(usable),
        latest_payloads(usable, "evidence_added", "evidence_id"),
        latest_payloads(usable, "candidate_updated", "candidate_id"),
        problems,
    )


# --- integrity ------------------------------------------------------------------------------------


# Payload fields that take part in integrity checks.
_CHECKED_FIELDS = (
    "plan", "plan_hash", "workflow_id", "workflow_version", "tasks", "request", "request_hash",
    "trace", "trace_hash", "output", "output_hash", "output_truncated", "arguments", "arguments_hash",
    "proposed_arguments", "proposed_arguments_hash", "result_envelope", "result_hash", "call_id", "result",
    "source_ids", "retryable", "error", "task_id", "plan.workflow_id", "plan.version", "plan.tasks",
    "trace.output_text", "trace.output_hash", "trace.output_truncated", "result_envelope.call_id",
    "result_envelope.payload", "result_envelope.source_ids", "result_envelope.retryable",
    "result_envelope.payload.error",
)


def _field(path: str) -> str:
    return "_j_" + path.replace(".", "_")


def _text_of(path: str) -> str:
    """Unquoted text of a field that is a JSON string without escapes, such as a digest or an id."""
    return f"trim(both '\"' from {_field(path)})"


def _matches(value: str, digest: str) -> str:
    """The field exists and hashes to its digest."""
    return f"coalesce(sha2({_field(value)}, 256) = {_text_of(digest)}, false)"


def _same(left: str, right: str) -> str:
    return f"({_field(left)} <=> {_field(right)})"


def integrity_problems(events: DataFrame) -> DataFrame:
    """Events whose recorded hashes or duplicated fields disagree: run_id, sequence, kind, problem.

    The payload is parsed once and every checked field becomes a text column: JSON text of a
    variant has sorted keys and no spaces, which is the form that was hashed.
    """
    has = lambda path: f"{_field(path)} is not null"
    planned = events.where("kind = 'workflow_planned'").selectExpr(
        "run_id",
        "sequence as _planned_at",
        "get_json_object(payload, '$.workflow_id') as _w",
        "get_json_object(payload, '$.workflow_version') as _v",
        "get_json_object(payload, '$.plan_hash') as _h",
        "get_json_object(payload, '$.plan') is not null as _fixed",
    ).where("_fixed").groupBy("run_id").agg(
        F.min_by(F.struct("_w", "_v", "_h"), "_planned_at").alias("_plan"), F.min("_planned_at").alias("_planned_at")
    )
    scope = events.where(
        F.col("kind").isin(
            "workflow_planned", "workflow_completed", "model_turn_started", "model_turn_completed",
            "tool_started", "tool_completed", "tool_rejected",
        )
    ).join(planned, "run_id", "left")
    fields = scope.selectExpr(
        "run_id", "sequence", "kind", "try_parse_json(payload) as _p", "_plan", "_planned_at",
        "coalesce(_planned_at < sequence, false) as _in_plan",
    ).selectExpr(
        "* except (_p)",
        "try_variant_get(_p, '$.output', 'string') as _output",
        *[f"to_json(try_variant_get(_p, '$.{path}', 'variant')) as {_field(path)}" for path in _CHECKED_FIELDS],
    )
    truncated = f"({_field('output_truncated')} = 'true')"
    legacy = ", ".join(
        f"',\"{key}\":', coalesce({_field(source)}, 'null')"
        for key, source in (("call_id", "call_id"), ("payload", "result"), ("retryable", "retryable"), ("source_ids", "source_ids"))
    )
    envelope = f"concat('{{', substr(concat({legacy}), 2), '}}')"
    checks = {
        "workflow_planned": [
            (f"{_field('plan')} is null", None),
            (f"not {_matches('plan', 'plan_hash')}", "plan_hash mismatch for plan"),
            (f"not {_same('workflow_id', 'plan.workflow_id')}", "workflow_id does not match plan"),
            (f"not {_same('workflow_version', 'plan.version')}", "workflow_version does not match plan"),
            (f"not {_same('tasks', 'plan.tasks')}", "tasks do not match plan"),
            ("_planned_at < sequence", "journal contains multiple integrity workflow plans"),
        ],
        "workflow_completed": [
            (
                f"_in_plan and not (_plan._w <=> {_text_of('workflow_id')} and _plan._v <=> {_text_of('workflow_version')} "
                f"and _plan._h <=> {_text_of('plan_hash')})",
                "workflow_completed does not match workflow_planned",
            ),
        ],
        "model_turn_started": [(f"not {_matches('request', 'request_hash')}", "request_hash mismatch for request")],
        "model_turn_completed": [
            (f"not {_matches('trace', 'trace_hash')}", "trace_hash mismatch for trace"),
            (f"coalesce({_field('output_truncated')}, '') not in ('true', 'false')", "output_truncated must be a boolean"),
            (f"{truncated} and _output is not null", "truncated output must be null"),
            (
                f"not {truncated} and not coalesce(sha2(_output, 256) = {_text_of('output_hash')}, false)",
                "output_hash mismatch",
            ),
            (f"not {_same('output', 'trace.output_text')}", "trace output_text does not match payload"),
            (f"not {_same('output_hash', 'trace.output_hash')}", "trace output_hash does not match payload"),
            (f"not {_same('output_truncated', 'trace.output_truncated')}", "trace output_truncated does not match payload"),
        ],
        "tool_started": [
            (f"not (_in_plan or {has('task_id')} or {has('arguments_hash')})", None),
            (f"not {_matches('arguments', 'arguments_hash')}", "arguments_hash mismatch for arguments"),
            (
                f"({has('proposed_arguments')} or {has('proposed_arguments_hash')}) "
                f"and not {_matches('proposed_arguments', 'proposed_arguments_hash')}",
                "proposed_arguments_hash mismatch for proposed_arguments",
            ),
        ],
    }
    checks["tool_completed"] = checks["tool_rejected"] = [
        (f"{_field('result_envelope')} is null and _in_plan", "fixed-DAG tool result is missing result_envelope"),
        (
            f"{_field('result_envelope')} is null and {has('result_hash')} "
            f"and sha2({envelope}, 256) <> {_text_of('result_hash')}",
            "tool result_hash mismatch",
        ),
        (f"{_field('result_envelope')} is null", None),
        (f"not {_matches('result_envelope', 'result_hash')}", "tool result_hash mismatch"),
        *[
            (f"not {_same(source, 'result_envelope.' + key)}", f"result_envelope {key} does not match payload")
            for key, source in (
                ("call_id", "call_id"), ("payload", "result"), ("source_ids", "source_ids"), ("retryable", "retryable")
            )
        ],
        (f"not {_same('error', 'result_envelope.payload.error')}", "error does not match result_envelope payload"),
    ]
    branches = []
    for kind, rules in checks.items():
        cases = " ".join(
            f"when {condition} then {'null' if text is None else repr(text)}" for condition, text in rules
        )
        branches.append(f"when kind = '{kind}' then case {cases} end")
    # Unnesting a one-element array keeps the rows with a problem without evaluating it twice.
    problem = f"explode(array_compact(array(case {' '.join(branches)} end))) as problem"
    return fields.selectExpr("run_id", "sequence", "kind", problem)


# --- search, counters, transcripts ----------------------------------------------------------------


ALL = "all"
UNASSIGNED = "__unassigned__"


def filter_events(events: DataFrame, family: str = ALL, agent: str = ALL, search: str = "") -> DataFrame:
    """Conjunctive filters: kind family, agent (or none), and text in any field, ignoring case."""
    chosen = events
    if family != ALL:
        chosen = chosen.where(event_family() == family)
    if agent == UNASSIGNED:
        chosen = chosen.where("agent_id is null")
    elif agent != ALL:
        chosen = chosen.where(F.col("agent_id") == agent)
    needle = search.strip().lower()
    if needle:
        document = F.concat_ws(
            " ", F.col("sequence").cast("string"), "kind", F.coalesce("agent_id", F.lit("")), "message", "payload"
        )
        chosen = chosen.where(F.contains(F.lower(document), F.lit(needle)))
    return chosen


def event_counters(events: DataFrame, visible: Column, by: Sequence[str] = ()) -> DataFrame:
    """total, visible, agents, tool_calls, rejections, failures; one aggregate. ``visible``: which events are shown."""
    kind = F.col("kind")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(visible).alias("visible"),
        F.count_distinct("agent_id").alias("agents"),
        F.count_if(kind == "tool_started").alias("tool_calls"),
        F.count_if(kind.endswith("_rejected")).alias("rejections"),
        F.count_if(kind.endswith("_failed")).alias("failures"),
    )


def event_summary(limit: int | None = None) -> Column:
    """Message plus task, tool and call ids, shortened to ``limit`` characters if that is set."""
    details = F.concat_ws(
        ", ",
        *[
            F.when(F.coalesce(payload_text(k), F.lit("")) != "", F.concat(F.lit(f"{k}="), payload_text(k)))
            for k in ("task_id", "tool", "call_id")
        ],
    )
    message = F.coalesce(F.when(F.trim("message") != "", F.trim("message")), F.lit("(no message)"))
    text = F.when(details != "", F.concat(message, F.lit(" | "), details)).otherwise(message)
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def transcript(events: DataFrame, agent: str | None) -> DataFrame:
    """Lines of one agent (None: unassigned) in run and sequence order."""
    mine = events.where("agent_id is null") if agent is None else events.where(F.col("agent_id") == agent)
    line = F.concat(
        F.expr("lpad(sequence, greatest(4, length(sequence)), '0')"),
        F.lit("  "),
        F.expr("rpad(kind, greatest(22, length(kind)), ' ')"),
        F.lit("  "),
        F.col("message"),
    )
    return mine.select("run_id", "sequence", line.alias("line")).orderBy("run_id", "sequence")


# --- interval and order checks --------------------------------------------------------------------


def overlap_peak(events: DataFrame, start: Column, end: Column, out: str = "peak") -> DataFrame:
    """Most intervals open at once per run, by a sweep over +1/-1 rows.

    Each block of sequences yields its net change and its highest inner level; the levels of the
    preceding blocks are added afterwards.
    """
    c = F.col
    steps = events.select(
        "run_id", "sequence", F.when(start, 1).when(end, -1).alias("_step")
    ).where("_step is not null")
    placed = steps.withColumn("_block", block_of(steps, "sequence"))
    inside = Window.partitionBy("run_id", "_block").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        placed.withColumn("_level", F.sum("_step").over(inside))
        .groupBy("run_id", "_block")
        .agg(F.sum("_step").alias("_net"), F.max("_level").alias("_high"))
    )
    before = Window.partitionBy("run_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("_net").over(before), F.lit(0)) + c("_high")
    return blocks.withColumn("_peak", level).groupBy("run_id").agg(
        F.greatest(F.lit(0), F.max("_peak")).cast("long").alias(out)
    )


def interval_problems(events: DataFrame, prefix: str = "screen-") -> DataFrame:
    """Task intervals that overlap on one lane, and tool calls outside an open task."""
    c = F.col
    scoped = events.withColumn("task_id", payload_text("task_id")).where(
        c("task_id").startswith(prefix)
    )
    step = (
        F.when(c("kind") == "task_started", "start")
        .when(c("kind") == "tool_started", "tool")
        .when(c("kind").isin("tool_completed", "tool_failed", "tool_rejected"), "tool_end")
        .when(c("kind").isin("task_completed", "task_failed", "task_skipped"), "end")
    )
    steps = scoped.withColumn("_step", step).where("_step is not null").select(
        "run_id", "sequence", "task_id", "agent_id", "_step"
    )
    anonymous = steps.where("agent_id is null").select(
        "run_id", "sequence", F.lit("screen task event is missing its lane identity").alias("problem")
    )
    per_task = with_previous(steps, ["run_id", "task_id"], ["sequence"], ["_step", "agent_id"])
    before = F.coalesce("previous__step", F.lit("none"))
    wrong = (
        F.when((c("_step") == "start") & (before != "none"), "screen task started more than once")
        .when((c("_step") == "tool") & ~before.isin("start", "tool_end"), "tool start escaped its task")
        .when((c("_step") == "tool_end") & (before != "tool"), "tool terminal escaped its task")
        .when((c("_step") == "end") & ~before.isin("start", "tool_end"), "task terminated outside its lifecycle")
        .when((before != "none") & (c("agent_id") != c("previous_agent_id")), "task changed lanes")
    )
    tasks = per_task.withColumn("problem", wrong).where("problem is not null").select("run_id", "sequence", "problem")
    edges = steps.where(c("_step").isin("start", "end") & c("agent_id").isNotNull())
    per_lane = with_previous(edges, ["run_id", "agent_id"], ["sequence"], ["_step"])
    overlap = per_lane.where("_step = 'start' and previous__step = 'start'").select(
        "run_id", "sequence", F.lit("lane overlapped two screen tasks").alias("problem")
    )
    left_open = (
        steps.groupBy("run_id", "task_id")
        .agg(F.max("sequence").alias("sequence"), F.max_by("_step", "sequence").alias("_last"))
        .where("_last <> 'end'")
        .select("run_id", "sequence", F.lit("journal ended with an open lifecycle").alias("problem"))
    )
    return anonymous.unionByName(tasks).unionByName(overlap).unionByName(left_open)


def terminal_order(events: DataFrame, lanes: int = 8) -> DataFrame:
    """Per run whether candidates, lanes, synthesis, workflow and run end come in that order."""
    c = F.col
    kind, at = c("kind"), c("sequence")
    synthesis = (kind == "stage_completed") & (payload_text("stage") == "synthesis")
    one = events.groupBy("run_id").agg(
        F.max(F.when(kind == "candidate_updated", at)).alias("_candidate"),
        F.min(F.when(kind == "agent_completed", at)).alias("_lane_first"),
        F.max(F.when(kind == "agent_completed", at)).alias("_lane_last"),
        F.count_if(kind == "agent_completed").alias("_lanes"),
        F.max(F.when(synthesis, at)).alias("_synthesis"),
        F.count_if(synthesis).alias("_syntheses"),
        F.max(F.when(kind == "workflow_completed", at)).alias("_workflow"),
        F.count_if(kind == "workflow_completed").alias("_workflows"),
        F.max("sequence").alias("_last"),
        # A flag, not the kind: aggregates of fixed width are kept in a hash map, texts would have every event sorted first.
        F.max_by(kind == "run_completed", "sequence").alias("_completed"),
    )
    complete = (c("_lanes") == lanes) & (c("_syntheses") == 1) & (c("_workflows") == 1) & c("_candidate").isNotNull()
    ordered = (
        (c("_candidate") < c("_lane_first"))
        & (c("_lane_last") < c("_synthesis"))
        & (c("_synthesis") < c("_workflow"))
        & (c("_workflow") + 1 == c("_last"))
    )
    problem = (
        F.when(~complete, "terminal projection events are incomplete")
        .when(~ordered, "candidate, lane, workflow, stage, and run order regressed")
        .when(~c("_completed"), "journal does not end with run_completed")
    )
    return one.select("run_id", problem.isNull().alias("ok"), problem.alias("problem"))


def family_counts(events: DataFrame) -> DataFrame:
    """Events per run and kind family; the same plan serves a stream in update mode."""
    return events.groupBy("run_id", event_family().alias("family")).agg(F.count(F.lit(1)).alias("events"))

