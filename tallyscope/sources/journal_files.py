"""Event journal files: strict parsing of JSON lines, batch and stream, and append-only writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyscope.session import computed

# Event kinds of a run journal.
EVENT_KINDS = (
    "run_created",
    "run_started",
    "run_paused",
    "run_resumed",
    "run_synthesizing",
    "run_completed",
    "run_cancelled",
    "run_failed",
    "stage_started",
    "stage_completed",
    "agent_registered",
    "agent_started",
    "agent_progress",
    "agent_completed",
    "agent_failed",
    "workflow_planned",
    "task_started",
    "model_turn_started",
    "model_turn_completed",
    "action_rejected",
    "tool_started",
    "tool_completed",
    "tool_rejected",
    "tool_failed",
    "task_completed",
    "task_failed",
    "task_skipped",
    "workflow_completed",
    "evidence_added",
    "candidate_updated",
)
EVENT_COLUMNS = ("schema_version", "run_id", "sequence", "kind", "timestamp", "message", "agent_id", "payload")


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row per non-blank line: the event columns, and ``problem`` for a line that is refused.

    A line must be exactly one JSON object without repeated keys or NaN: it is parsed inside
    brackets, where trailing text or a second value cannot hide. ``payload`` is JSON text with
    sorted keys.
    """
    parsed = lines.where("trim(value) <> ''").selectExpr(
        "* except (value)",
        "value as line",
        "try_cast(try_parse_json(concat('[', value, ']')) as array<variant>) as _items",
    )
    opened = parsed.selectExpr(
        "* except (_items)",
        "_items is not null as _json",
        "case when size(_items) = 1 then try_cast(_items[0] as map<string, variant>) end as _e",
    )
    text = lambda name: f"try_cast(_e['{name}'] as string)"
    whole = lambda name: f"try_cast(try_cast(_e['{name}'] as double) as bigint)"
    missing = " or ".join(
        f"_e['{n}'] is null" for n in ("schema_version", "run_id", "sequence", "kind", "timestamp", "message")
    )
    typed = opened.selectExpr(
        "* except (_e)",
        f"cast({whole('schema_version')} as int) as schema_version",
        f"{text('run_id')} as run_id",
        f"{whole('sequence')} as sequence",
        f"{text('kind')} as kind",
        f"try_to_timestamp({text('timestamp')}) as timestamp",
        f"{text('message')} as message",
        f"{text('agent_id')} as agent_id",
        "coalesce(to_json(_e['payload']), '{}') as payload",
        "case when not _json then 'line is not strict JSON' when _e is null then 'event must be a JSON object' "
        f"when {missing} then 'event is missing a required key' "
        "when _e['payload'] is not null and try_cast(_e['payload'] as map<string, variant>) is null "
        "then 'payload must be an object' end as problem",
    )
    kinds = ", ".join(f"'{k}'" for k in EVENT_KINDS)
    checked = typed.selectExpr(
        "* except (problem, _json)",
        "coalesce(problem, case when schema_version is null or sequence is null then 'not an integer' "
        f"when kind not in ({kinds}) then 'unknown event kind' when timestamp is null then 'invalid timestamp' end) "
        "as problem",
    )
    return computed(checked)


def split_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine)."""
    return (
        parsed.where("problem is null").select(*EVENT_COLUMNS),
        parsed.where("problem is not null").drop(*EVENT_COLUMNS),
    )


def _lines(reader, path: str, *others) -> DataFrame:
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), *others)


def numbered(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """Add ``line_number`` (from 1) to rows of ``placed`` (``source_path, _block, _place``).

    Files are read in blocks by many tasks. ``_place`` counts rows upwards inside a block, so a line's number is its distance
    from the first one of its block, plus the lines of the blocks before it in the file: a prefix sum over one row per block.
    ``lines`` are all lines, blank ones included, from the same reading of the files.
    """
    blocks = lines.groupBy("source_path", "_block").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    number = F.col("_place") - F.col("_first") + F.col("_before") + 1
    return (
        placed.join(starts, ["source_path", "_block"])
        .withColumn("line_number", number)
        .drop("_block", "_place", "_first", "_lines", "_before")
    )


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine); a quarantined line has its ``source_path`` and ``line_number``, as a serial reader counts them."""
    lines = _lines(
        spark.read, path, F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")
    )
    events, quarantine = split_lines(parse_lines(lines))
    return events, numbered(lines.drop("value"), quarantine)


def stream_journal(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> tuple[DataFrame, DataFrame]:
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return split_lines(parse_lines(_lines(reader, path)))


def _event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines; the payload text is spliced in, so it keeps its own formatting."""
    head = F.to_json(
        F.struct(
            "schema_version",
            "run_id",
            "sequence",
            "kind",
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"),
            "message",
            "agent_id",
        ),
        {"ignoreNullFields": "false"},
    )
    return events.select(
        F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), "payload", F.lit("}")).alias("value")
    )


def write_journal(events: DataFrame, path: str) -> None:
    """Write a new journal; an existing one is never overwritten."""
    _event_lines(events).write.mode("errorifexists").text(path)


def append_journal(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to a journal folder."""
    return (
        _event_lines(events)
        .writeStream.format("text")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
