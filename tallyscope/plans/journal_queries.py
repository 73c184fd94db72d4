"""Event log queries over the driver's event, conversation and document tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyscope.functions.registry import per_entity_in_order
from tallyscope.operators import journal as jn
from tallyscope.operators import run_blocks as rb
from tallyscope.operators.digests import ordered_digest
from tallyscope.plans import tables as t
from tallyscope.session import ensure_checkpoint_dir, spread, use_rocksdb_state
from tallyscope.sources.journal_files import parse_lines, read_journal
from tallyscope.streaming import journal_stream as js
from tallyscope.streaming import keyed_state as ks
from tallyscope.streaming import run_blocks as sb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# Event kind by turn: every conversation is one run of one agent.
_TURN_KINDS = (
    "run_created",
    "agent_registered",
    "agent_started",
    "agent_progress",
    "tool_started",
    "run_completed",
    "agent_progress",
    "agent_completed",
)


def conversation_log(rows: DataFrame) -> DataFrame:
    """Turns as run events. Runs that a system turn opened skip a number after turn 1 (a gap)."""
    turn = F.col("turn")
    kind = F.lit(None).cast("string")
    for number, name in enumerate(_TURN_KINDS):
        kind = F.when(turn == number, name).otherwise(kind)
    shift = ((F.col("conv_id") % 5 == 0) & (turn > 1)).cast("long")
    payload = F.when(
        kind == "agent_progress", F.concat(F.lit('{"progress":'), (F.length("text") % 120).cast("string"), F.lit("}"))
    ).when(
        kind == "agent_registered", F.concat(F.lit('{"role":"'), "role", F.lit('","lane":"main"}'))
    ).otherwise("{}")
    return rows.select(
        F.lit(1).alias("schema_version"),
        F.col("conv_id").cast("string").alias("run_id"),
        (turn + shift).alias("sequence"),
        kind.alias("kind"),
        F.timestamp_seconds(F.lit(1_700_000_000) + turn).alias("timestamp"),
        F.col("text").alias("message"),
        F.when(turn > 0, "main").alias("agent_id"),
        payload.alias("payload"),
    )


_CONVERSATION_SQL = """
log as (
  select cast(conv_id as varchar) as run_id, turn + case when conv_id % 5 = 0 and turn > 1 then 1 else 0 end as sequence,
    (['run_created','agent_registered','agent_started','agent_progress','tool_started','run_completed','agent_progress','agent_completed'])[turn + 1] as kind,
    role, text, turn from conversations),
gaps as (
  select *, row_number() over (partition by run_id order by sequence) - 1 as expected from log),
limits as (
  select run_id, least(coalesce(min(case when sequence <> expected then expected end), max(sequence) + 1),
    coalesce(min(case when kind in ('run_completed','run_cancelled','run_failed') then sequence end) + 1, 1000000)) as lim
  from gaps group by run_id),
accepted as (select log.* from log join limits using (run_id) where sequence < lim)"""

_VERDICT_SQL = f"""with {_CONVERSATION_SQL}
    select log.run_id, log.sequence, case when sequence < lim then null
        when exists (select 1 from log l2 where l2.run_id = log.run_id and l2.kind = 'run_completed' and l2.sequence < log.sequence and l2.sequence < lim)
        then 'cannot append an event after terminal run state' else 'event sequence does not match expected' end as reason
    from log join limits using (run_id)"""


@query("journal_sequence", _VERDICT_SQL)
def journal_sequence(spark: SparkSession, folder: str) -> DataFrame:
    result = jn.check_sequence(conversation_log(t.table(spark, folder, "conversations")))
    good = result.accepted.select("run_id", "sequence", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(result.rejected.select("run_id", "sequence", "reason"))


_STATE_SQL = f"""with {_CONVERSATION_SQL}
    select run_id, max_by(case kind when 'run_created' then 'planning' when 'run_completed' then 'complete' end, sequence)
        filter (where kind in ('run_created', 'run_completed')) as status,
      case when count(*) filter (where kind = 'run_completed') > 0 then 'human_review' end as current_stage,
      case when count(*) filter (where kind = 'run_completed') > 0 then 100 else 0 end as progress,
      max(sequence) as last_sequence from accepted group by run_id"""


@query("journal_state", _STATE_SQL)
def journal_state(spark: SparkSession, folder: str) -> DataFrame:
    accepted = jn.check_sequence(conversation_log(t.table(spark, folder, "conversations"))).accepted
    return jn.run_states(accepted).select("run_id", "status", "current_stage", "progress", "last_sequence")


@query(
    "agent_states",
    f"""with {_CONVERSATION_SQL},
    a as (select *, least(100, length(text) % 120) as p from accepted where kind like 'agent_%' or kind = 'tool_started')
    select run_id, any_value(role) filter (where kind = 'agent_registered') as role,
      max_by(case kind when 'agent_registered' then 'queued' when 'tool_started' then 'waiting_tool'
        when 'agent_completed' then 'complete' else 'running' end, sequence) as status,
      cast(coalesce(max_by(case kind when 'agent_started' then 5 when 'agent_progress' then p end, sequence)
        filter (where kind in ('agent_started', 'agent_progress')), 0) as integer) as progress,
      count(*) filter (where kind = 'tool_started') as tool_calls
    from a group by run_id""",
)
def agent_states(spark: SparkSession, folder: str) -> DataFrame:
    accepted = jn.check_sequence(conversation_log(t.table(spark, folder, "conversations"))).accepted
    return jn.agent_states(accepted).select("run_id", "role", "status", "progress", "tool_calls")


@query(
    "task_transitions",
    f"""with {t.RUN_EVENTS_SQL},
    moves as (select *, case kind when 'task_completed' then 'complete' when 'tool_started' then 'waiting_tool' else 'running' end as status_after,
      agent_id as task_id from log where agent_id is not null)
    select run_id, sequence, task_id, kind, status_after,
      coalesce(lag(status_after) over (partition by run_id, task_id order by sequence), 'queued') as status_before from moves""",
)
def task_transitions(spark: SparkSession, folder: str) -> DataFrame:
    events = t.run_events(spark, folder).where("agent_id is not null").withColumn(
        "payload", F.concat(F.lit('{"task_id":"'), "agent_id", F.lit('"}'))
    )
    return jn.task_events(events).select("run_id", "sequence", "task_id", "kind", "status_after", "status_before")


@query(
    "recent_window",
    f"""with {t.RUN_EVENTS_SQL},
    n as (select *, row_number() over (partition by run_id order by sequence desc) as n from log)
    select run_id, sequence, kind, event_id from n where n <= 80""",
)
def recent_window(spark: SparkSession, folder: str) -> DataFrame:
    return jn.recent_events(t.run_events(spark, folder)).select("run_id", "sequence", "kind", "event_id")


@query(
    "event_search",
    f"""with {t.RUN_EVENTS_SQL}
    select run_id, sequence, kind from log where kind like 'tool\\_%' escape '\\' and agent_id is null
      and contains(lower(sequence || ' ' || kind || '  ' || message || ' ' || payload), '77')""",
)
def event_search(spark: SparkSession, folder: str) -> DataFrame:
    found = jn.filter_events(t.run_events(spark, folder), family="tool", agent=jn.UNASSIGNED, search=" 77 ")
    return found.select("run_id", "sequence", "kind")


@query(
    "event_counters",
    f"""with {t.RUN_EVENTS_SQL}
    select run_id, count(*) as total, count(*) filter (where kind like 'task%') as visible, count(distinct agent_id) as agents,
      count(*) filter (where kind = 'tool_started') as tool_calls, cast(0 as bigint) as rejections,
      count(*) filter (where kind like '%failed') as failures from log group by run_id""",
)
def event_counters(spark: SparkSession, folder: str) -> DataFrame:
    events = t.plain_run_events(spark, folder)
    return jn.event_counters(events, jn.event_family() == "task", by=["run_id"])


@query(
    "transcript",
    f"""with {t.RUN_EVENTS_SQL}
    select run_id, sequence, lpad(cast(sequence as varchar), greatest(4, length(cast(sequence as varchar)))::integer, '0') || '  ' ||
      rpad(kind, greatest(22, length(kind))::integer, ' ') || '  ' || message as line
    from log where agent_id = 'lane-1'""",
)
def transcript(spark: SparkSession, folder: str) -> DataFrame:
    return jn.transcript(t.run_events(spark, folder), "lane-1")


@query(
    "event_summary",
    f"""with {t.RUN_EVENTS_SQL},
    s as (select run_id, sequence, message || ' | task_id=' || coalesce(agent_id, 'none') || ', call_id=' || event_id as text from log)
    select run_id, sequence, text as summary from s""",
)
def event_summary(spark: SparkSession, folder: str) -> DataFrame:
    events = t.run_events(spark, folder).withColumn(
        "payload",
        F.concat(
            F.lit('{"task_id":"'),
            F.coalesce("agent_id", F.lit("none")),
            F.lit('","call_id":'),
            F.col("event_id").cast("string"),
            F.lit("}"),
        ),
    )
    return events.select("run_id", "sequence", jn.event_summary().alias("summary"))


@query(
    "overlap_peak",
    f"""with {t.RUN_EVENTS_SQL},
    steps as (select run_id, sequence, sum(case when kind = 'task_started' then 1 else -1 end) over (partition by run_id order by sequence) as level
      from log where kind in ('task_started', 'task_completed'))
    select run_id, cast(greatest(0, max(level)) as bigint) as peak from steps group by run_id""",
)
def overlap_peak(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("kind")
    return jn.overlap_peak(t.run_events(spark, folder), kind == "task_started", kind == "task_completed")


@query(
    "interval_problems",
    f"""with {t.RUN_EVENTS_SQL},
    steps as (
      select run_id, sequence, agent_id, case kind when 'task_started' then 'start' when 'tool_started' then 'tool'
          when 'task_completed' then 'end' else 'tool_end' end as step
      from log where agent_id is not null),
    tasks as (
      select *, coalesce(lag(step) over (partition by run_id, agent_id order by sequence), 'none') as before,
        row_number() over (partition by run_id, agent_id order by sequence desc) as from_end
      from steps),
    edges as (
      select run_id, step, lag(step) over (partition by run_id, agent_id order by sequence) as before
      from steps where step in ('start', 'end')),
    found as (
      select run_id, case
          when step = 'start' and before <> 'none' then 'screen task started more than once'
          when step = 'tool' and before not in ('start', 'tool_end') then 'tool start escaped its task'
          when step = 'tool_end' and before <> 'tool' then 'tool terminal escaped its task'
          when step = 'end' and before not in ('start', 'tool_end') then 'task terminated outside its lifecycle'
        end as problem from tasks
      union all select run_id, 'lane overlapped two screen tasks' from edges where step = 'start' and before = 'start'
      union all select run_id, 'journal ended with an open lifecycle' from tasks where from_end = 1 and step <> 'end')
    select run_id, problem, count(*) as events from found where problem is not null group by run_id, problem""",
)
def interval_problems(spark: SparkSession, folder: str) -> DataFrame:
    events = t.run_events(spark, folder).where("agent_id is not null").withColumn(
        "payload", F.concat(F.lit('{"task_id":"screen-'), "agent_id", F.lit('"}'))
    )
    return jn.interval_problems(events).groupBy("run_id", "problem").agg(F.count(F.lit(1)).alias("events"))


# Every customer is a run of eight lanes with its closing events; five in six have one fault each (k). SQL of both engines.
_CLOSING_KIND = """case
    when n = 0 then case when k = 1 then 'agent_completed' else 'candidate_updated' end
    when n = 1 then 'agent_progress'
    when n = 5 and k = 1 then 'candidate_updated'
    when n = 9 and k = 2 then 'agent_progress'
    when n <= 9 then 'agent_completed'
    when n = 10 then case when k = 3 then 'workflow_completed' else 'stage_completed' end
    when n = 11 then case when k = 3 then 'stage_completed' else 'workflow_completed' end
    when n = 12 then case when k = 5 then 'run_failed' else 'run_completed' end
    when k = 4 then 'agent_progress' end"""


@query(
    "terminal_order",
    f"""with log as (
      select run_id, n, kind from (
        select cast(c_custkey as varchar) as run_id, n, {_CLOSING_KIND} as kind
        from (select c_custkey, c_custkey % 6 as k, unnest(range(14)) as n from customer))
      where kind is not null),
    lanes as (select run_id, count(*) as lanes, min(n) as first, max(n) as last from log where kind = 'agent_completed' group by 1),
    runs as (
      select l.run_id, max(n) filter (where kind = 'candidate_updated') as candidate, max(n) filter (where kind = 'stage_completed') as stage,
        max(n) filter (where kind = 'workflow_completed') as workflow, max(n) as ending, arg_max(kind, n) as final
      from log l group by 1),
    judged as (
      select run_id, case when lanes <> 8 then 'terminal projection events are incomplete'
        when not (candidate < first and last < stage and stage < workflow and workflow + 1 = ending)
        then 'candidate, lane, workflow, stage, and run order regressed'
        when final <> 'run_completed' then 'journal does not end with run_completed' end as problem
      from runs join lanes using (run_id))
    select run_id, problem is null as ok, problem from judged""",
)
def terminal_order(spark: SparkSession, folder: str) -> DataFrame:
    places = "explode(sequence(0L, 13L)) as n"
    customers = spread(t.table(spark, folder, "customer").select("c_custkey"))
    log = customers.selectExpr("c_custkey", "c_custkey % 6 as k", places).selectExpr(
        "cast(c_custkey as string) as run_id",
        "n as sequence",
        f"{_CLOSING_KIND} as kind",
        """'{"stage":"synthesis"}' as payload""",
    )
    return jn.terminal_order(log.where("kind is not null"))


@query(
    "hash_integrity",
    """select cast(doc_id as varchar) as run_id, case lang when 'de' then 'request_hash mismatch for request'
        else 'output_hash mismatch' end as problem from documents where lang in ('de', 'fr')""",
)
def hash_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Each document is a request (German and English) or an output; the hash of the source name is
    recorded instead of the text's for German requests and French outputs."""
    documents = t.table(spark, folder, "documents").selectExpr(
        "cast(doc_id as string) as run_id",
        "lang",
        "to_json(struct(source, text)) as request",
        "substr(to_json(struct(text as t)), 6, length(to_json(struct(text as t))) - 6) as quoted",
        "sha2(source, 256) as source_hash",
        "sha2(text, 256) as text_hash",
    ).selectExpr(
        "*",
        "if(lang = 'fr', source_hash, text_hash) as output_hash",
        "if(lang = 'de', source_hash, sha2(request, 256)) as request_hash",
    )
    turns = documents.selectExpr(
        "*",
        """concat('{"output_hash":"', output_hash, '","output_text":', quoted, ',"output_truncated":false}') as trace""",
    )
    events = turns.selectExpr(
        "run_id",
        "cast(0 as bigint) as sequence",
        "if(lang in ('de', 'en'), 'model_turn_started', 'model_turn_completed') as kind",
        """if(lang in ('de', 'en'), concat('{"request":', request, ',"request_hash":"', request_hash, '"}'),
        concat('{"trace":', trace, ',"trace_hash":"', sha2(trace, 256), '","output_truncated":false,"output_hash":"',
        output_hash, '","output":', quoted, '}')) as payload""",
    )
    return jn.integrity_problems(events).select("run_id", "problem")


@query(
    "strict_json",
    """select event_id, case event_type when 'error' then 'line is not strict JSON' when 'view' then 'line is not strict JSON'
        when 'click' then 'unknown event kind' when 'signup' then 'event is missing a required key' end as problem from events""",
)
def strict_json(spark: SparkSession, folder: str) -> DataFrame:
    return parse_lines(event_lines(t.table(spark, folder, "events"))).select("event_id", "problem")


def event_lines(events: DataFrame) -> DataFrame:
    """Events as journal lines; four event types each break one rule."""
    return events.selectExpr(
        "event_id",
        """concat('{"schema_version":1,"run_id":"', user_id, '","sequence":', event_id, ',"kind":"',
        if(event_type = 'click', 'clicked', 'run_started'), '","timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '"',
        if(event_type = 'signup', '', ',"message":"m"'), if(event_type = 'view', ',"message":"again"', ''),
        ',"payload":', props, '}', if(event_type = 'error', ' trailing', '')) as value""",
    )


@query(
    "payload_upserts",
    f"""with {t.RUN_EVENTS_SQL},
    n as (select *, json_extract_string(payload, '$.k') as id, row_number() over (
        partition by run_id, json_extract_string(payload, '$.k') order by sequence desc) as n from log where kind = 'task_started')
    select run_id, id, sequence from n where n = 1""",
)
def payload_upserts(spark: SparkSession, folder: str) -> DataFrame:
    return jn.latest_payloads(t.run_events(spark, folder), "task_started", "k").select("run_id", "id", "sequence")


_FAMILY_SQL = """
    select cast(user_id as varchar) as run_id, case event_type when 'signup' then 'task' when 'purchase' then 'task' else 'tool' end as family,
      count(*) as events from events group by 1, 2"""


@query("family_counts", _FAMILY_SQL)
def family_counts(spark: SparkSession, folder: str) -> DataFrame:
    return jn.family_counts(_kinds(t.table(spark, folder, "events")))


# --- streaming twins ----------------------------------------------------------------------------


def _kinds(events: DataFrame) -> DataFrame:
    kind = jn.lookup(
        F.col("event_type"),
        {
            "signup": "task_started",
            "click": "tool_started",
            "view": "tool_completed",
            "purchase": "task_completed",
            "error": "tool_failed",
        },
    )
    return events.select(F.col("user_id").cast("string").alias("run_id"), kind.alias("kind"))


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One driver table, a file or a folder of files, as a file stream.

    The path is a pattern, since a stream takes a plain path for a folder.
    """
    schema = t.table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _work_folder(spark: SparkSession) -> str:
    """A fresh folder for stream output and offsets, next to the shared checkpoints."""
    return os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")


@query("stream_family_counts", _FAMILY_SQL)
def stream_family_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = js.live_counts(_kinds(_stream(spark, folder, "events")))
    work = _work_folder(spark)
    js.append_batches(counts, f"{work}/out", f"{work}/offsets", "update").awaitTermination()
    return js.newest(js.read_batches(spark, f"{work}/out", counts.schema), ["run_id", "family"])


def _run_blocks(spark: SparkSession, events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    use_rocksdb_state(spark)
    return sb.run_to_end(events, _work_folder(spark), snapshot)


@query("stream_sequence", _VERDICT_SQL)
def stream_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Limits of the runs from the blocks of a stream; the journal itself is judged by them."""
    blocks = _run_blocks(spark, conversation_log(_stream(spark, folder, "conversations")))
    result = jn.check_sequence(conversation_log(t.table(spark, folder, "conversations")), rb.limits(blocks))
    good = result.accepted.select("run_id", "sequence", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(result.rejected.select("run_id", "sequence", "reason"))


@query("stream_state", _STATE_SQL)
def stream_state(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _run_blocks(spark, conversation_log(_stream(spark, folder, "conversations")))
    return rb.states(blocks).select("run_id", "status", "current_stage", "progress", "last_sequence")


@query("stream_replay", _STATE_SQL)
def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of the first three events of each run, and a second stream that goes on from it with the rest."""
    events = conversation_log(_stream(spark, folder, "conversations"))
    snapshot = _run_blocks(spark, events.where("sequence < 3"))
    blocks = _run_blocks(spark, events.where("sequence >= 3"), snapshot)
    return rb.states(blocks).select("run_id", "status", "current_stage", "progress", "last_sequence")


# --- planned runs -------------------------------------------------------------------------------

# Events that a turn k of a conversation with n characters makes: place, condition, kind, agent, payload fields. The
# texts are SQL of both engines; they only make the log that the operators and their SQL twins read.
_OWN = "case when n % 11 = 0 then 'other' when k < 4 then 'main' else 'aux' end"
_LANE = "case when k < 4 then 'main' else 'aux' end"
_N = "cast(n as string)"
_TASK = {"task_id": "'t' || cast(cast(floor(k / 2.0) as bigint) as string)"}
_PLAN_TEXT = (
    '{"workflow_id":"w","workflow_version":"1","tasks":['
    '{"task_id":"t0","agent_id":"main","depends_on":[],"required":true},'
    '{"task_id":"t1","agent_id":"main","depends_on":["t0"],"required":true},'
    '{"task_id":"t2","agent_id":"aux","depends_on":[],"required":true},'
    '{"task_id":"t3","agent_id":"aux","depends_on":["t2"],"required":false,"allow_failed_dependencies":true}]}'
)
_TURN_EVENTS = (
    (0, "k = 0", "workflow_planned", "null", {}),
    (1, "k = 0", "agent_registered", "'main'", {"role": "role", "lane": "'l1'"}),
    (2, "k = 0", "agent_registered", "'aux'", {"role": "'helper'", "lane": "'l2'"}),
    (3, "k = 1", "agent_started", "'main'", {}),
    (4, "role = 'user'", "task_started", _OWN, _TASK),
    (5, "role = 'user'", "model_turn_started", "null", _TASK),
    (6, "role = 'assistant'", "model_turn_completed", "null", {**_TASK, "output": f"'o' || {_N}"}),
    (7, "role = 'assistant'", "tool_started", _OWN, _TASK),
    (8, "role = 'assistant' and n % 3 = 0", "tool_failed", "null", {**_TASK, "error": f"'e' || {_N}"}),
    (8, "role = 'assistant' and n % 3 <> 0", "tool_completed", "null", _TASK),
    (9, "role = 'assistant' and n % 5 = 0", "task_failed", "null", {**_TASK, "error": f"'f' || {_N}"}),
    (9, "role = 'assistant' and n % 5 = 1", "task_completed", "null", {**_TASK, "partial": "'true'"}),
    (9, "role = 'assistant' and n % 5 > 1", "task_completed", "null", {**_TASK, "output": f"'d' || {_N}"}),
    (10, "true", "agent_progress", _LANE, {"progress": "cast(n % 120 as string)"}),
    (11, "k = 5", "agent_completed", "'main'", {}),
    (12, "n % 2 = 0", "evidence_added", _LANE, {"evidence_id": f"'v' || {_N}"}),
    (13, "k = 3", "workflow_completed", "null", {}),
    (14, "k = 6 and conv_id % 7 = 0", "run_cancelled", "null", {}),
    (15, "role = 'system'", "action_rejected", "null", {**_TASK, "reason": f"'r' || {_N}"}),
)
_FIELDS = ("task_id", "output", "error", "reason", "partial", "progress", "role", "lane")


def planned_log(rows: DataFrame) -> DataFrame:
    """Conversations as runs with a plan, tasks, agents and evidence; all events of a turn come from its row."""

    def payload(kind: str, fields: dict[str, str]) -> str:
        if kind == "workflow_planned":
            return f"'{_PLAN_TEXT}'"
        return "to_json(named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + "))" if fields else "'{}'"

    made = ", ".join(
        f"if({condition}, named_struct('sequence', k * 16 + {place}, 'kind', '{kind}', 'agent_id', cast({agent} as string), "
        f"'payload', {payload(kind, fields)}), null)"
        for place, condition, kind, agent, fields in _TURN_EVENTS
    )
    turns = rows.selectExpr("conv_id", "turn as k", "role", "length(coalesce(text, '')) as n")
    return turns.selectExpr(
        "1 as schema_version",
        "cast(conv_id as string) as run_id",
        "timestamp_seconds(1700000000 + k) as timestamp",
        f"inline(array_compact(array({made})))",
    ).select(
        "schema_version", "run_id", "sequence", "kind", "timestamp",
        F.concat_ws(" ", "kind", "sequence").alias("message"), "agent_id", "payload",
    )


_PLANNED_SQL = (
    "turns as (select conv_id, cast(conv_id as varchar) as run_id, turn as k, role, length(coalesce(text, '')) as n from conversations), log as ("
    + " union all ".join(
        f"select run_id, k * 16 + {place} as sequence, '{kind}' as kind, cast({agent} as varchar) as agent_id, "
        + ", ".join(f"cast({fields.get(name, 'null')} as varchar) as {name}" for name in _FIELDS)
        + f" from turns where {condition}"
        for place, condition, kind, agent, fields in _TURN_EVENTS
    )
    + """), plans as (
      select run_id, sequence as planned_at, p.task_id, p.agent_id, required, needs, lenient from log,
        (values ('t0', 'main', true, null, false), ('t1', 'main', true, 't0', false), ('t2', 'aux', true, null, false),
                ('t3', 'aux', false, 't2', true)) as p(task_id, agent_id, required, needs, lenient)
      where kind = 'workflow_planned'),
    moves as (
      select *, lag(status_after, 1, 'queued') over (partition by run_id, task_id order by sequence) as status_before from (
        select *, case kind when 'model_turn_started' then 'waiting_model' when 'tool_started' then 'waiting_tool'
            when 'task_failed' then 'failed' when 'task_completed' then case when partial = 'true' then 'partial' else 'complete' end
            else 'running' end as status_after
        from log where task_id is not null))"""
)

_TASK_STATES_SQL = f"""with {_PLANNED_SQL},
    folded as (
      select run_id, task_id, arg_max(status_after, sequence) as status, count(*) filter (where kind = 'model_turn_started') as turns,
        count(*) filter (where kind = 'tool_started') as tool_calls,
        arg_max(output, sequence) filter (where output is not null) as output,
        (arg_max({{'e': case when kind in ('action_rejected', 'tool_failed', 'task_failed') then coalesce(error, reason) end}}, sequence)
          filter (where coalesce(partial, '') <> 'true')).e as error
      from moves group by run_id, task_id)
    select p.run_id, p.task_id, p.agent_id, p.required, coalesce(f.status, 'queued') as status, coalesce(f.turns, 0) as turns,
      coalesce(f.tool_calls, 0) as tool_calls, f.output, f.error
    from plans p left join folded f on f.run_id = p.run_id and f.task_id = p.task_id"""


@query("task_states", _TASK_STATES_SQL)
def task_states(spark: SparkSession, folder: str) -> DataFrame:
    return jn.task_states(planned_log(t.table(spark, folder, "conversations")))


def _stream_moves(spark: SparkSession, folder: str) -> DataFrame:
    use_rocksdb_state(spark)
    return ks.moves_to_end(planned_log(_stream(spark, folder, "conversations")), _work_folder(spark))


@query("stream_task_states", _TASK_STATES_SQL)
def stream_task_states(spark: SparkSession, folder: str) -> DataFrame:
    return ks.task_states(_stream_moves(spark, folder))


_TASK_FAULTS_SQL = """
    select run_id, sequence, task_id, case
        when owner is null then 'unknown task: ' || task_id
        when agent_id is not null and agent_id <> owner then 'event agent does not own task'
        when status_before <> case kind when 'task_started' then 'queued' when 'model_turn_completed' then 'waiting_model'
            when 'tool_failed' then 'waiting_tool' when 'tool_completed' then 'waiting_tool' else 'running' end
          and not (kind = 'task_failed' and status_before in ('waiting_model', 'waiting_tool'))
        then 'invalid ' || kind || ' transition: ' || status_before end as problem
    from (select m.*, p.agent_id as owner from moves m left join plans p on p.run_id = m.run_id and p.task_id = m.task_id)"""


@query("stream_task_faults", f"with {_PLANNED_SQL} select * from ({_TASK_FAULTS_SQL}) where problem is not null")
def stream_task_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Refused transitions, found while the events arrive."""
    return _stream_moves(spark, folder).where("problem is not null").select(
        "run_id", "sequence", F.col("id").alias("task_id"), "problem"
    )


@query(
    "task_problems",
    f"""with {_PLANNED_SQL},
    faults as ({_TASK_FAULTS_SQL}),
    finished as (
      select run_id, task_id, min(sequence) as done_at, arg_min(status_after, sequence) as done from moves
      where status_after in ('complete', 'partial', 'failed', 'skipped') group by run_id, task_id)
    select run_id, sequence, task_id, problem from faults where problem is not null
    union all
    select distinct m.run_id, m.sequence, m.task_id, 'started before dependencies completed'
    from moves m join plans p on p.run_id = m.run_id and p.task_id = m.task_id
    left join finished f on f.run_id = m.run_id and f.task_id = p.needs
    where m.kind = 'task_started' and p.needs is not null
      and not coalesce(f.done_at < m.sequence and (p.lenient or f.done in ('complete', 'partial')), false)
    union all
    select p.run_id, e.sequence, p.task_id, 'workflow completed with non-terminal tasks'
    from plans p join log e on e.run_id = p.run_id and e.kind = 'workflow_completed'
    left join finished f on f.run_id = p.run_id and f.task_id = p.task_id
    where f.done_at is null or f.done_at > e.sequence
    union all
    select run_id, sequence, null, 'workflow_completed requires a planned workflow' from log
    where kind = 'workflow_completed' and run_id not in (select run_id from plans)""",
)
def task_problems(spark: SparkSession, folder: str) -> DataFrame:
    return jn.task_problems(planned_log(t.table(spark, folder, "conversations")))


_AGENT_SQL = f"""with {_PLANNED_SQL},
    touched as (
      select *, case when kind = 'agent_completed' then 100 when kind = 'agent_progress' then least(100, cast(progress as integer)) end as set_to,
        case when kind = 'agent_started' then 5 end as raised_to,
        case when kind = 'evidence_added' then null when kind = 'tool_started' then 'waiting_tool' when task_id is not null then 'running'
          when kind = 'agent_registered' then 'queued' when kind = 'agent_completed' then 'complete' else 'running' end as status
      from log where agent_id is not null),
    folded as (
      select run_id, agent_id, max(role) as role, max(lane) as lane, arg_max(status, sequence) filter (where status is not null) as status,
        arg_max(set_to, sequence) filter (where set_to is not null) as base,
        coalesce(max(sequence) filter (where set_to is not null), -1) as set_at,
        arg_max(kind || ' ' || sequence, sequence) filter (where kind <> 'agent_registered') as current_task,
        count(*) filter (where kind = 'tool_started') as tool_calls, count(*) filter (where kind = 'evidence_added') as evidence_count,
        bool_or(kind = 'agent_registered') as registered
      from touched group by run_id, agent_id),
    raised as (
      select t.run_id, t.agent_id, max(t.raised_to) as top from touched t
      join folded f on f.run_id = t.run_id and f.agent_id = t.agent_id where t.sequence > f.set_at group by 1, 2)
    select f.run_id, f.agent_id, f.role, f.lane,
      case when f.status in ('queued', 'running', 'waiting_tool') and f.run_id in (select run_id from log where kind = 'run_cancelled')
        then 'cancelled' else f.status end as status,
      cast(greatest(coalesce(f.base, 0), coalesce(r.top, 0)) as integer) as progress,
      coalesce(f.current_task, 'Awaiting admission') as current_task, f.tool_calls, f.evidence_count
    from folded f left join raised r on r.run_id = f.run_id and r.agent_id = f.agent_id where f.registered"""


@query("agent_rows", _AGENT_SQL)
def agent_rows(spark: SparkSession, folder: str) -> DataFrame:
    return jn.agent_states(planned_log(t.table(spark, folder, "conversations")))


@query("stream_agent_states", _AGENT_SQL)
def stream_agent_states(spark: SparkSession, folder: str) -> DataFrame:
    """Agents and runs each as keyed state; a cancelled run ends the agents that were still at work."""
    use_rocksdb_state(spark)
    events = planned_log(_stream(spark, folder, "conversations"))
    agents = ks.agents_to_end(events, _work_folder(spark))
    return ks.agent_states(agents, rb.states(_run_blocks(spark, _numbered_run(events))))


def _numbered_run(events: DataFrame) -> DataFrame:
    """The events that end a run or start it, as a log of their own: the block fold wants numbers without gaps."""
    kind = F.col("kind")
    return events.where(kind.isin("workflow_planned", "run_cancelled")).withColumns(
        {
            "sequence": (kind == "run_cancelled").cast("long"),
            "kind": F.when(kind == "workflow_planned", "run_created").otherwise(kind),
        }
    )


_RECENT = 20


@query(
    "stream_recent",
    f"""with {_PLANNED_SQL}
    select run_id, sequence, kind from (
      select *, row_number() over (partition by run_id order by sequence desc) as n from log) where n <= {_RECENT}""",
)
def stream_recent(spark: SparkSession, folder: str) -> DataFrame:
    use_rocksdb_state(spark)
    events = planned_log(_stream(spark, folder, "conversations"))
    return ks.recent_to_end(events, _work_folder(spark), _RECENT).select("run_id", "sequence", "kind")


@query(
    "bad_lines",
    """with lines as (
      select event_id // 5000 as file, row_number() over (partition by event_id // 5000 order by event_id) as line_number,
        case event_type when 'error' then 'line is not strict JSON' when 'view' then 'line is not strict JSON'
          when 'click' then 'unknown event kind' when 'signup' then 'event is missing a required key' end as problem
      from events)
    select file, line_number, problem from lines where problem is not null""",
)
def bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as journal files of 5,000 lines; every refused line with its number in its file."""
    lines = event_lines(t.table(spark, folder, "events")).withColumn("file", F.expr("event_id div 5000"))
    path = f"{_work_folder(spark)}/journal"
    ordered = lines.repartition("file").sortWithinPartitions("file", "event_id")
    ordered.select("file", "value").write.partitionBy("file").text(path)
    _, quarantine = read_journal(spark, path)
    file = F.regexp_extract("source_path", "/file=([0-9]+)/", 1).cast("long")
    return quarantine.select(file.alias("file"), "line_number", "problem")


# --- plans as graphs ------------------------------------------------------------------------------

# The orders of a customer are a plan; the n-th order depends on order n/2. Every seventh customer's first order depends on the
# last one, which closes a cycle.
_ORDER_PLANS_SQL = """
    numbered as (
      select cast(o_custkey as varchar) as run_id, o_custkey % 7 = 0 as closed, cast(o_orderkey as varchar) as task_id,
        row_number() over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as size
      from orders)"""


def _order_plans(spark: SparkSession, folder: str) -> DataFrame:
    mine = Window.partitionBy("o_custkey")
    orders = t.table(spark, folder, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.row_number().over(mine.orderBy("o_orderkey")).alias("n"),
        F.count(F.lit(1)).over(mine).alias("size"),
    )
    n, closed = F.col("n"), F.col("o_custkey") % 7 == 0
    before = F.when(n > 1, F.floor(n / 2)).when(closed, F.col("size"))
    parent = orders.select("o_custkey", F.col("n").alias("_before"), F.col("o_orderkey").cast("string").alias("_dependency"))
    return orders.withColumn("_before", before).join(parent, ["o_custkey", "_before"], "left").select(
        F.col("o_custkey").cast("string").alias("run_id"),
        F.col("o_orderkey").cast("string").alias("task_id"),
        F.array_compact(F.array("_dependency")).alias("depends_on"),
    )


@query(
    "plan_levels",
    f"""with {_ORDER_PLANS_SQL}
    select run_id, task_id, case when not closed then cast(floor(log2(n)) as integer) end as level,
      case when closed then case when size >> cast(floor(log2(size)) - floor(log2(n)) as integer) = n
        then 'workflow dependency cycle' else 'task waits for a dependency cycle' end end as problem
    from numbered""",
)
def plan_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of the tasks of all plans, and the tasks on or behind a cycle."""
    return jn.plan_levels(_order_plans(spark, folder))


@query(
    "entity_in_order",
    """with changes as (
      select user_id, event_type, value, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
    select user_id, count(*) as events, count(*) filter (where before <> event_type) as changes from changes group by user_id""",
)
def entity_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """A user's function over the events of each user in order; it sees a frame at a time and carries its own state."""

    def changes(key, frames):
        events, found, last = 0, 0, None
        for frame in frames:
            types = frame["event_type"]
            before = types.shift(fill_value=last if last is not None else types.iloc[0])
            events, found, last = events + len(types), found + int((types != before).sum()), types.iloc[-1]
        yield pd.DataFrame({"user_id": [key[0]], "events": [events], "changes": [found]})

    rows = t.table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    return per_entity_in_order(rows, ["user_id"], ["ts", "event_id"], changes, "user_id long, events long, changes long")


@query(
    "ordered_digest",
    """with recursive rows_in_order as (
      select row_number() over (order by o_orderkey) - 1 as place, sha256(o_orderkey || '|' || o_custkey) as h from orders),
    tree as (
      select place, h, (select count(*) from rows_in_order) as size, 0 as height from rows_in_order
      union all
      select place // 256, sha256(string_agg(h, '' order by place)), (any_value(size) + 255) // 256, any_value(height) + 1
      from tree where size > 1 or height = 0 group by place // 256)
    select arg_max(h, height) as digest from tree""",
)
def ordered_digest_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    row = F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey"), 256)
    return ordered_digest(t.table(spark, folder, "orders"), row, [F.col("o_orderkey")])
