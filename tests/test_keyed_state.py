import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import journal as jn
from tallyscope.operators import run_blocks as rb
from tallyscope.streaming import keyed_state as ks
from tallyscope.streaming import run_blocks as srb
from tests.test_journal import AT, LIFE, frame, plan
from tests.test_streaming import scattered


def busy_log(seed=3, runs=8, steps=60):
    """Runs with a plan, agents and random task events, most of them allowed."""
    rng = random.Random(seed)
    rows = list(LIFE)
    for run in range(runs):
        tasks = [(f"t{k}", rng.choice(["a1", "a2"]), (), False) for k in range(4)]
        status = {name: "queued" for name, *_ in tasks}
        own = [("workflow_planned", plan(*tasks), None)]
        own += [("agent_registered", {"role": f"r{a}", "lane": "l"}, f"a{a}") for a in (1, 2)]
        for i in range(steps):
            name, owner, *_ = rng.choice(tasks)
            allowed = [k for k, (before, _) in jn.TASK_TRANSITIONS.items() if status[name] in before.split()]
            kind = rng.choice(allowed) if allowed and rng.random() < 0.95 else rng.choice(list(jn.TASK_TRANSITIONS))
            status[name] = jn.TASK_TRANSITIONS[kind][1]
            payload = {"task_id": name}
            payload |= rng.choice([{}, {"output": f"o{i}"}, {"error": f"e{i}"}, {"partial": True}, {"reason": "why"}])
            agent = owner if rng.random() < 0.9 else rng.choice([None, "a1", "zz"])
            own.append((kind, payload, agent))
            extra = [("agent_started", {}), ("agent_progress", {"progress": rng.randrange(150)}), ("evidence_added", {"evidence_id": "e"})]
            own.append((*rng.choice(extra), rng.choice(["a1", "a2"])))
        if run % 3 == 0:
            own.append(("run_cancelled", {}, None))
        for i, (kind, payload, agent) in enumerate(own):
            rows.append((1, f"b{run}", i, kind, AT + timedelta(seconds=i // 4), f"{kind} {i}", agent, json.dumps(payload)))
    return rows


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


TASK = ["run_id", "task_id", "agent_id", "required", "status", "turns", "tool_calls", "output", "error"]
AGENT = ["run_id", "agent_id", "role", "lane", "status", "progress", "current_task", "tool_calls", "evidence_count"]


def test_tasks_equal_batch(spark, tmp_path):
    rows = busy_log()
    batch = frame(spark, rows)
    moves = ks.moves_to_end(scattered(spark, tmp_path, rows, seed=21), str(tmp_path / "w"), "1 hour").cache()
    # Nothing is due before the watermark; the rest of the stream brings it along.
    assert moves.count() < jn.task_events(batch).count()
    later = [(1, "clock", 0, "run_created", AT + timedelta(days=2), "m", None, "{}")]
    later.append((1, "clock", 1, "task_started", AT + timedelta(days=2), "m", "a", '{"task_id":"t"}'))
    moves = ks.moves_to_end(scattered(spark, tmp_path, rows + rows[:40] + later, seed=22), str(tmp_path / "v"), "7 days")
    assert moves.count() == 0
    moves = ks.moves_to_end(scattered(spark, tmp_path, rows + rows[:40], files=1, seed=23), str(tmp_path / "x")).cache()
    expected = jn.task_events(batch)
    columns = ["run_id", "sequence", "kind", "status_before", "status_after"]
    assert found(moves.where(F.col("kind") != ks.PLANNED), *columns) == found(expected, *columns)
    assert found(ks.task_states(moves), *TASK) == found(jn.task_states(batch), *TASK)
    direct = jn.task_problems(batch).where("problem not like 'started before%' and problem not like 'workflow_completed%'")
    problems = moves.where("problem is not null").withColumnRenamed("id", "task_id")
    assert found(problems, "run_id", "sequence", "task_id", "problem") == found(direct, "run_id", "sequence", "task_id", "problem")
    assert problems.count() > 10


def test_out_of_order_batches(spark, tmp_path):
    """Events of one task over many micro-batches in any order come out once, in order, when the watermark passes."""
    rows = busy_log(5, 3)
    clock = [(1, "clock", i, "task_started", AT + timedelta(days=i + 1), "m", "a", '{"task_id":"t"}') for i in range(3)]
    rng = random.Random(1)
    folder = tmp_path / "in"
    shuffled = list(rows)
    rng.shuffle(shuffled)
    for i, part in enumerate([shuffled[0::3], shuffled[1::3], shuffled[2::3], clock[:1], clock[1:2], clock[2:]]):
        frame(spark, part).coalesce(1).write.parquet(str(folder / f"part={i}"))
    stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1)
    stream = stream.option("recursiveFileLookup", "true").parquet(str(folder))
    moves = ks.moves_to_end(stream, str(tmp_path / "w"), "1 hour").where("run_id <> 'clock'")
    assert found(ks.task_states(moves), *TASK) == found(jn.task_states(frame(spark, rows)), *TASK)


def test_agents_equal_batch(spark, tmp_path):
    rows = busy_log(9)
    batch = frame(spark, rows)
    agents = ks.agents_to_end(scattered(spark, tmp_path, rows, files=1, seed=24), str(tmp_path / "w"))
    runs = rb.states(srb.run_to_end(scattered(spark, tmp_path, rows, files=3, seed=25), str(tmp_path / "w")))
    assert found(ks.agent_states(agents, runs), *AGENT) == found(jn.agent_states(batch), *AGENT)
    assert batch.where("kind = 'run_cancelled'").count() > 0


@pytest.mark.parametrize("count", [5, 80])
def test_recent_equals_batch(spark, tmp_path, count, monkeypatch):
    monkeypatch.setattr(ks, "SPAN", 32)
    rows = busy_log(11, 4, 90)
    recent = ks.recent_to_end(scattered(spark, tmp_path, rows + rows[::7], seed=26), str(tmp_path / "w"), count, "1 day")
    columns = ["run_id", "sequence", "kind", "timestamp", "message", "agent_id", "payload"]
    assert found(recent, *columns) == found(jn.recent_events(frame(spark, rows), count), *columns)


def test_rings_expire(spark, tmp_path):
    """Old blocks leave the state; what they emitted stays in the output."""
    rows = [(1, "r", i, "run_started", AT + timedelta(hours=i), "m", None, "{}") for i in range(12)]
    folder = tmp_path / "in"
    for i, row in enumerate(rows):
        frame(spark, [row]).coalesce(1).write.parquet(str(folder / f"part={i:02d}"))
    stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1)
    stream = stream.option("recursiveFileLookup", "true").parquet(str(folder))
    recent = ks.recent_to_end(stream, str(tmp_path / "w"), 3, "0 seconds", 3600.0)
    assert {r["sequence"] for r in recent.collect()} == {9, 10, 11}


def test_ring_takes_rows():
    """A key costs no frames: its processor reads and gives rows, and keeps the least copy of a number."""
    from types import SimpleNamespace as Fake

    from pyspark.sql import Row

    ring = ks.RecentRing(2, 60.0)
    state: dict = {"ring": [], "deadline": None, "timers": []}
    handle = Fake(
        getListState=lambda *_: Fake(get=lambda: iter(state["ring"]), put=lambda rows: state.update(ring=rows)),
        getValueState=lambda *_: Fake(get=lambda: state["deadline"], update=lambda value: state.update(deadline=value)),
        registerTimer=state["timers"].append,
    )
    ring.init(handle)
    rows = [Row(sequence=n, kind=kind, stamp=n * 1000, message=None, agent_id=None, payload="{}") for n, kind in ((3, "b"), (1, "a"), (2, None), (3, "a"))]
    out = list(ring.handleInputRows(("r", 0), iter(rows), None))
    assert [(r.run_id, r.block, r.sequence, r.kind) for r in out] == [("r", 0, 2, None), ("r", 0, 3, "a")]
    assert state["timers"] == [60003] and len(state["ring"]) == 2
