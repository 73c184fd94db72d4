"""Run state as a composition of blocks.

A run's log is a sequence of transitions, and transitions compose: the effect of a stretch of events on any earlier state is
itself a small row. A block holds a fixed span of sequence numbers; its row says where its order breaks, and what the
events before that point do to the state (last status, stages in the order they were first completed, a value that
progress is set to, a level it is raised to afterwards). Two neighbouring rows compose to the row of both, and
composition is associative, so a run of any length is a tree of small groups and never one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Sequence numbers of one block, and rows that are composed in one group.
SPAN, FAN = 4096, 256

#: Columns of a block: where order breaks (null: nowhere), then the effect of the events before that.
EFFECT = (
    "status string, current_stage string, completed_stages array<string>, set_to int, raised_to int, "
    "workflow_id string, workflow_version string, failure string, tool_calls bigint, last_sequence bigint"
)
BLOCK = f"run_id string, block bigint, gap bigint, invalid bigint, twice bigint, ended bigint, {EFFECT}"
_NAMES = [part.split()[0] for part in BLOCK.split(", ")][2:]
_LAST = ("status", "current_stage", "workflow_id", "workflow_version", "failure", "last_sequence")


def _element() -> Column:
    """A block as an element of the composition: it spans blocks ``first`` to ``last``."""
    c = F.col
    whole = c("gap").isNull() & c("invalid").isNull() & c("twice").isNull() & c("ended").isNull()
    return F.struct(c("block").alias("first"), c("block").alias("last"), whole.alias("whole"), *_NAMES)


def _composed(left: Column, right: Column) -> Column:
    """The element of two neighbours; the right one takes effect only if nothing breaks before it."""
    joined = right["first"] == left["last"] + 1
    goes_on = left["whole"] & joined
    gap = F.coalesce(left["gap"], F.when(joined, right["gap"]).otherwise((left["last"] + 1) * SPAN))
    stages = F.array_distinct(F.concat(left["completed_stages"], right["completed_stages"]))
    reset = right["set_to"].isNotNull()
    merged = {
        **{name: F.coalesce(right[name], left[name]) for name in _LAST},
        "completed_stages": stages,
        "set_to": F.coalesce(right["set_to"], left["set_to"]),
        "raised_to": F.when(reset, right["raised_to"]).otherwise(F.greatest(left["raised_to"], right["raised_to"])),
        "tool_calls": left["tool_calls"] + right["tool_calls"],
    }
    fields = {
        "first": left["first"],
        "last": right["last"],
        "whole": goes_on & right["whole"],
        "gap": gap,
        **{name: F.least(left[name], right[name]) for name in ("invalid", "twice", "ended")},
        **{name: F.when(goes_on, value).otherwise(left[name]) for name, value in merged.items()},
    }
    return F.struct(*[fields[name].alias(name) for name in ("first", "last", "whole", *_NAMES)])


def compose(blocks: DataFrame) -> DataFrame:
    """One element per run, from the newest row of each of its blocks.

    Groups of ``FAN`` neighbours are composed at a time; the number of rounds is the logarithm of the longest run.
    """
    most = blocks.agg(F.max("block")).first()[0]
    rounds = max(1, math.ceil(math.log(most + 1, FAN))) if most else 1
    rows = blocks.select("run_id", F.col("block").alias("at"), _element().alias("element"))
    for _ in range(rounds):
        elements = F.transform(
            F.array_sort(F.collect_list(F.struct("at", "element"))), lambda pair: pair["element"]
        )
        rows = rows.groupBy("run_id", F.floor(F.col("at") / FAN).alias("group")).agg(elements.alias("_elements")).select(
            "run_id",
            F.col("group").alias("at"),
            F.aggregate(
                F.slice("_elements", F.lit(2), F.size("_elements")), F.col("_elements")[0], _composed
            ).alias("element"),
        )
    return rows.select("run_id", "element.*")


def limits(blocks: DataFrame) -> DataFrame:
    """The row of :func:`tallyscope.operators.journal.run_limits` of every run, from its blocks."""
    c = F.col
    gap = F.when(c("first") > 0, 0).otherwise(F.coalesce("gap", (c("last") + 1) * SPAN))
    return compose(blocks).select(
        "run_id",
        F.least(gap, "invalid", "twice", "ended").alias("limit"),
        gap.alias("_gap"),
        c("invalid").alias("_invalid"),
        c("twice").alias("_twice"),
        c("ended").alias("_end"),
    )


def states(blocks: DataFrame) -> DataFrame:
    """State of every run that has an accepted event: the columns of ``run_states``, and its tool calls."""
    zero = F.lit(0)
    return (
        compose(blocks)
        .where("first = 0 and last_sequence is not null")
        .select(
            "run_id",
            F.coalesce("status", F.lit("idle")).alias("status"),
            "current_stage",
            "workflow_id",
            "workflow_version",
            "failure",
            "last_sequence",
            F.greatest(F.coalesce("set_to", zero), F.coalesce("raised_to", zero)).alias("progress"),
            "completed_stages",
            "tool_calls",
        )
    )
