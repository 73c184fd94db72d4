import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import journal as jn
from tallyscope.sources.journal_files import (
    parse_lines,
    read_journal,
    split_lines,
    write_journal,
)

AT = datetime(2025, 3, 1)
SCHEMA = (
    "schema_version int, run_id string, sequence long, kind string, timestamp timestamp, message string, "
    "agent_id string, payload string"
)


def log(run, *steps):
    rows = []
    for i, step in enumerate(steps):
        kind, payload, agent = (step, {}, None) if isinstance(step, str) else (*step, None)[:3]
        rows.append((1, run, i, kind, AT + timedelta(seconds=i), f"{kind} {i}", agent, json.dumps(payload)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plan(*tasks):
    return {
        "workflow_id": "w",
        "workflow_version": "1",
        "tasks": [
            {"task_id": t, "agent_id": a, "depends_on": list(d), "required": True, "allow_failed_dependencies": f}
            for t, a, d, f in tasks
        ],
    }


LIFE = log(
    "life",
    ("run_created", {"spec": {}}),
    "run_started",
    ("stage_started", {"stage": "universe", "progress": 5}),
    ("stage_completed", {"stage": "universe", "progress": 20}),
    ("agent_registered", {"role": "analyst", "lane": "l1"}, "a1"),
    ("agent_started", {}, "a1"),
    ("workflow_planned", plan(("t1", "a1", (), False), ("t2", "a1", ("t1",), False))),
    ("task_started", {"task_id": "t1"}, "a1"),
    ("model_turn_started", {"task_id": "t1"}),
    ("model_turn_completed", {"task_id": "t1", "output": "x"}),
    ("tool_started", {"task_id": "t1"}, "a1"),
    ("tool_failed", {"task_id": "t1", "error": "boom"}),
    ("evidence_added", {"evidence_id": "e1", "title": "old"}, "a1"),
    ("evidence_added", {"evidence_id": "e1", "title": "new"}, "a1"),
    ("task_completed", {"task_id": "t1", "partial": True, "output": "y"}),
    ("task_started", {"task_id": "t2"}),
    ("task_completed", {"task_id": "t2"}),
    ("agent_progress", {"progress": 150}, "a1"),
    ("candidate_updated", {"candidate_id": "c1", "priority_score": 3}),
    ("run_synthesizing", {}),
    ("stage_completed", {"stage": "analysis", "progress": 60}),
    ("run_synthesizing", {"progress": 70}),
    ("agent_completed", {}, "a1"),
    ("workflow_completed", {}),
    "run_completed",
)


def test_replay(spark):
    state = jn.replay(frame(spark, LIFE).repartition(5))
    assert state.problems.collect() == []
    (run,) = state.runs.collect()
    assert run["status"] == "complete" and run["progress"] == 100 and run["current_stage"] == "human_review"
    assert run["completed_stages"] == ["universe", "analysis", "synthesis"]
    assert run["workflow_id"] == "w" and run["last_sequence"] == 24 and run["failure"] is None
    tasks = {r["task_id"]: r for r in state.tasks.collect()}
    assert tasks["t1"]["status"] == "partial" and tasks["t1"]["error"] == "boom" and tasks["t1"]["output"] == "y"
    assert tasks["t1"]["turns"] == 1 and tasks["t1"]["tool_calls"] == 1
    assert tasks["t2"]["status"] == "complete" and tasks["t2"]["error"] is None
    (agent,) = state.agents.collect()
    assert agent["status"] == "complete" and agent["progress"] == 100 and agent["evidence_count"] == 2
    assert agent["tool_calls"] == 1 and agent["role"] == "analyst"
    (evidence,) = state.evidence.collect()
    assert json.loads(evidence["payload"])["title"] == "new"
    assert state.candidates.count() == 1
    before = jn.replay(frame(spark, [r for r in LIFE if r[2] < 22]))
    (run,) = before.runs.collect()
    assert run["progress"] == 70 and run["status"] == "synthesizing"
    assert before.agents.first()["progress"] == 100


def test_statuses_along_the_way(spark):
    moves = jn.task_events(frame(spark, LIFE)).where("task_id = 't1'").orderBy("sequence").collect()
    assert [m["status_before"] for m in moves] == ["queued", "running", "waiting_model", "running", "waiting_tool", "running"]
    assert moves[-1]["status_after"] == "partial"


def test_lifecycle_problems(spark):
    planned = ("workflow_planned", plan(("t1", "a1", (), False), ("t2", "a1", ("t1",), False)))
    rows = (
        log("early", "run_created", planned, ("task_started", {"task_id": "t2"}))
        + log("open", "run_created", planned, "workflow_completed")
        + log("twice", "run_created", planned, planned)
        + log("unplanned", "run_created", "workflow_completed")
        + log("unknown", "run_created", planned, ("task_started", {"task_id": "zz"}))
        + log("owner", "run_created", planned, ("task_started", {"task_id": "t1"}, "other"))
        + log("jump", "run_created", planned, ("tool_started", {"task_id": "t1"}))
        + log("cycle", "run_created", ("workflow_planned", plan(("t1", "a", ("nope",), False))))
        + log("late", "run_created", "run_completed", "run_started")
        + log("first", "run_started")
    )
    found = {}
    for r in jn.replay(frame(spark, rows)).problems.collect():
        found.setdefault(r["run_id"], set()).add((r["sequence"], r["problem"]))
    assert found["early"] == {(2, "started before dependencies completed")}
    assert found["open"] == {(2, "workflow completed with non-terminal tasks")}
    assert found["twice"] == {(2, "workflow already planned")}
    assert found["unplanned"] == {(1, "workflow_completed requires a planned workflow")}
    assert found["unknown"] == {(2, "unknown task: zz")}
    assert found["owner"] == {(2, "event agent does not own task")}
    assert found["jump"] == {(2, "invalid tool_started transition: queued")}
    assert found["cycle"] == {(1, "task has unknown dependencies")}
    assert found["late"] == {(2, "cannot append an event after terminal run state")}
    assert found["first"] == {(0, "journal must begin with run_created")}


def accepted_by_loop(rows):
    """Brute force: replay in (sequence, timestamp) order, stop at the first violation."""
    out = set()
    for run in {r[1] for r in rows}:
        expected, ended = 0, False
        for r in sorted((x for x in rows if x[1] == run), key=lambda x: (x[2], x[4])):
            if r[2] < 0:
                continue
            if r[2] != expected or ended or r[0] != 1 or r[3] not in jn.EVENT_KINDS:
                break
            out.add((run, r[2]))
            expected += 1
            ended = r[3] in jn.TERMINAL_KINDS
    return out


@pytest.mark.parametrize("steps", [65_536, 4])
def test_sequence_against_brute_force(spark, monkeypatch, steps):
    monkeypatch.setattr(jn, "STEPS_PER_BLOCK", steps)
    rng = random.Random(7)
    rows = []
    for run in range(40):
        n = rng.randint(1, 30)
        events = [(1, f"r{run}", i, "run_started", AT + timedelta(seconds=i), "m", None, "{}") for i in range(n)]
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(events))
            change = rng.choice(["drop", "copy", "kind", "version", "end", "negative"])
            e = list(events[i])
            if change == "drop":
                events.pop(i)
            elif change == "copy":
                events.append(tuple(e[:5] + ["m2"] + e[6:]))
            elif change == "negative":
                events.append(tuple(e[:2] + [-1] + e[3:]))
            else:
                field, value = {"kind": (3, "bogus"), "version": (0, 2), "end": (3, "run_failed")}[change]
                e[field] = value
                events[i] = tuple(e)
            if not events:
                break
        rows += events
    result = jn.check_sequence(frame(spark, rows).repartition(6))
    assert {(r["run_id"], r["sequence"]) for r in result.accepted.collect()} == accepted_by_loop(rows)
    refused = sum(r["copies"] for r in result.rejected.collect())
    assert refused + result.accepted.count() == len(rows)


def test_strict_lines(spark, tmp_path):
    good = {"schema_version": 1, "run_id": "r", "sequence": 0, "kind": "run_created", "timestamp": "2025-03-01T00:00:00+00:00", "message": "hi", "agent_id": None, "payload": {"b": 1, "a": [True]}}
    text = json.dumps(good)
    lines = [
        text,
        " ",
        text.replace('"run_id": "r"', '"run_id": "r", "run_id": "s"'),
        text.replace("[true]", "[NaN]"),
        text + " trailing",
        text + "," + text,
        "[]",
        json.dumps({k: v for k, v in good.items() if k != "message"}),
        text.replace("run_created", "bogus"),
        json.dumps({**good, "payload": [1]}),
        json.dumps({**good, "timestamp": "soon"}),
    ]
    path = tmp_path / "j.jsonl"
    path.write_text("\n".join(lines))
    events, quarantine = read_journal(spark, str(path))
    (event,) = events.collect()
    assert event["payload"] == '{"a":[true],"b":1}' and event["timestamp"] == AT
    assert sorted(r["problem"] for r in quarantine.collect()) == sorted(
        ["line is not strict JSON"] * 3
        + ["event must be a JSON object"] * 2
        + ["event is missing a required key", "unknown event kind", "payload must be an object", "invalid timestamp"]
    )
    out = str(tmp_path / "copy")
    write_journal(frame(spark, LIFE), out)
    again, bad = read_journal(spark, out)
    assert bad.count() == 0 and again.count() == len(LIFE)
    assert {(r["sequence"], r["kind"], r["timestamp"]) for r in again.collect()} == {(r[2], r[3], r[4]) for r in LIFE}
    with pytest.raises(Exception):
        write_journal(frame(spark, LIFE), out)
    empty, _ = split_lines(parse_lines(spark.createDataFrame([("",)], "value string")))
    assert empty.count() == 0


def digest(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_integrity(spark):
    body = {"workflow_id": "w", "version": "1", "tasks": []}
    planned = {"workflow_id": "w", "workflow_version": "1", "tasks": [], "plan": body, "plan_hash": digest(body)}
    trace = {"output_text": "hi", "output_hash": hashlib.sha256(b"hi").hexdigest(), "output_truncated": False}
    turn = {"trace": trace, "trace_hash": digest(trace), "output": "hi", "output_hash": trace["output_hash"], "output_truncated": False}
    envelope = {"call_id": "c", "payload": {"error": "e"}, "source_ids": ["s"], "retryable": False}
    done = {"call_id": "c", "result": {"error": "e"}, "source_ids": ["s"], "retryable": False, "error": "e", "result_envelope": envelope, "result_hash": digest(envelope)}
    args = {"task_id": "t", "arguments": {"b": 1, "a": 2}, "arguments_hash": digest({"b": 1, "a": 2})}
    request = {"request": {"z": 1}, "request_hash": digest({"z": 1})}
    finish = {"workflow_id": "w", "workflow_version": "1", "plan_hash": digest(body)}
    good = [
        ("workflow_planned", planned),
        ("model_turn_started", request),
        ("model_turn_completed", turn),
        ("tool_started", args),
        ("tool_completed", done),
        ("workflow_completed", finish),
    ]
    legacy = {k: v for k, v in done.items() if k != "result_envelope"}
    bad = [
        ("workflow_planned", {**planned, "workflow_id": "x"}, "workflow_id does not match plan"),
        ("workflow_planned", {**planned, "plan": {**body, "extra": 1}}, "plan_hash mismatch for plan"),
        ("workflow_planned", {**planned, "tasks": [1]}, "tasks do not match plan"),
        ("model_turn_started", {**request, "request": {"z": 2}}, "request_hash mismatch for request"),
        ("model_turn_completed", {**turn, "output": "ho"}, "output_hash mismatch"),
        ("model_turn_completed", {**turn, "output_truncated": True}, "truncated output must be null"),
        ("tool_started", {**args, "arguments": {"a": 2}}, "arguments_hash mismatch for arguments"),
        ("tool_started", {**args, "proposed_arguments": 1}, "proposed_arguments_hash mismatch for proposed_arguments"),
        ("tool_completed", {**done, "source_ids": ["t"]}, "result_envelope source_ids does not match payload"),
        ("tool_completed", {**done, "error": "other"}, "error does not match result_envelope payload"),
        ("tool_rejected", {**legacy, "call_id": "d"}, "tool result_hash mismatch"),
        ("tool_completed", legacy, None),
        ("tool_started", {"arguments": 1}, None),
    ]
    rows = log("good", *good)
    for i, (kind, payload, _) in enumerate(bad):
        rows += log(f"bad{i}", (kind, payload))
    rows += log("plan", good[0], ("tool_completed", legacy), ("workflow_completed", {**finish, "plan_hash": "0" * 64}))
    found = {(r["run_id"], r["sequence"]): r["problem"] for r in jn.integrity_problems(frame(spark, rows)).collect()}
    expected = {(f"bad{i}", 0): text for i, (_, _, text) in enumerate(bad) if text}
    expected[("plan", 1)] = "fixed-DAG tool result is missing result_envelope"
    expected[("plan", 2)] = "workflow_completed does not match workflow_planned"
    assert found == expected


def test_search_counters_transcript(spark):
    rows = log(
        "r",
        ("tool_started", {"task_id": "t1", "call_id": "t1:c0"}, "a1"),
        ("tool_rejected", {}, "a1"),
        ("run_failed", {"note": "ÉCLAIR"}),
        ("agent_failed", {}, "b2"),
    )
    events = frame(spark, rows)
    count = lambda **q: jn.filter_events(events, **q).count()
    assert count(family="tool") == 2 and count(agent=jn.UNASSIGNED) == 1 and count(agent="a1") == 2
    assert count(search=" T1:C0 ") == 1 and count(search="missing") == 0 and count(family="tool", search="rejected") == 1
    counters = jn.event_counters(events, jn.event_family() == "tool").first().asDict()
    assert counters == {"total": 4, "visible": 2, "agents": 2, "tool_calls": 1, "rejections": 1, "failures": 2}
    lines = [r["line"] for r in jn.transcript(events, "a1").collect()]
    assert lines[0] == "0000  tool_started            tool_started 0"
    late = events.withColumn("sequence", F.lit(12345)).withColumn("kind", F.lit("a_kind_of_more_than_22_letters"))
    assert jn.transcript(late, "a1").first()["line"].startswith("12345  a_kind_of_more_than_22_letters  ")
    summary = [r[0] for r in events.orderBy("sequence").select(jn.event_summary(30)).collect()]
    assert events.select(F.max(F.length(jn.event_summary()))).first()[0] > 30
    assert summary[0] == "tool_started 0 | task_id=t1, …" and summary[1] == "tool_rejected 1"
    assert jn.recent_events(events, 2).count() == 2
    assert {(r["family"], r["events"]) for r in jn.family_counts(events).collect()} == {("tool", 2), ("run", 1), ("agent", 1)}


@pytest.mark.parametrize("steps", [65_536, 3])
def test_overlap_peak(spark, monkeypatch, steps):
    monkeypatch.setattr("tallyscope.operators.series.STEPS_PER_BLOCK", steps)
    rng = random.Random(3)
    rows, peaks = [], {}
    for run in range(8):
        level = peak = 0
        kinds = []
        for _ in range(40):
            up = level == 0 or rng.random() < 0.5
            level += 1 if up else -1
            peak = max(peak, level)
            kinds.append("task_started" if up else "task_completed")
        rows += log(f"r{run}", *kinds)
        peaks[f"r{run}"] = peak
    got = jn.overlap_peak(frame(spark, rows), F.col("kind") == "task_started", F.col("kind") == "task_completed")
    assert {r["run_id"]: r["peak"] for r in got.collect()} == peaks


def test_intervals_and_terminal_order(spark):
    def step(kind, task, agent="l1"):
        return (kind, {"task_id": f"screen-{task}"}, agent)

    rows = log("ok", step("task_started", 1), step("tool_started", 1), step("tool_completed", 1), step("task_completed", 1), step("task_started", 2), step("task_failed", 2))
    rows += log("overlap", step("task_started", 1), step("task_started", 2), step("task_completed", 1), step("task_completed", 2))
    rows += log("escaped", step("tool_started", 1), step("tool_completed", 1))
    rows += log("open", step("task_started", 1))
    found = {}
    for r in jn.interval_problems(frame(spark, rows)).collect():
        found.setdefault(r["run_id"], set()).add(r["problem"])
    assert found == {
        "overlap": {"lane overlapped two screen tasks"},
        "escaped": {"tool start escaped its task", "journal ended with an open lifecycle"},
        "open": {"journal ended with an open lifecycle"},
    }
    tail = ["candidate_updated", "agent_completed", ("stage_completed", {"stage": "synthesis"}), "workflow_completed", "run_completed"]
    swapped = [tail[1], tail[0], *tail[2:]]
    rows = log("ok", *tail) + log("bad", *swapped) + log("cut", *tail[:-2])
    got = {r["run_id"]: r["problem"] for r in jn.terminal_order(frame(spark, rows), lanes=1).collect()}
    assert got["ok"] is None and "regressed" in got["bad"] and "incomplete" in got["cut"]


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Bad lines have the numbers of a serial reader, however many tasks read a file; blank lines count."""
    rng = random.Random(6)
    good = json.dumps(dict(schema_version=1, run_id="r", sequence=0, kind="run_created", timestamp="2025-01-01T00:00:00", message="m"))
    expected = set()
    for name, count in (("a.jsonl", 3000), ("b.jsonl", 1), ("c.jsonl", 700)):
        lines = [rng.choice([good, good + " " * rng.randrange(300), "", "   ", "{", "[1]" * rng.randrange(1, 60)]) for _ in range(count)]
        ending = "" if name == "c.jsonl" else "\n"
        (tmp_path / name).write_text("\n".join(lines) + ending)
        expected |= {(name, i) for i, line in enumerate(lines, 1) if line.strip() and not line.startswith("{\"")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        events, quarantine = read_journal(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
        found = [(r["source_path"].rpartition("/")[2], r["line_number"]) for r in quarantine.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(found) == len(set(found)) and set(found) == expected
    assert "line_number" not in events.columns


def test_terminal_order_sorts_no_events(spark):
    """Fixed-width aggregates stay in a hash map; texts in an aggregate would have all events of a task sorted."""
    rows = log("r", ("agent_completed", {}, "l1"), ("run_completed", {}, None))
    plan = jn.terminal_order(frame(spark, rows))._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
