import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.functions.registry import per_entity, per_entity_in_order
from tallyscope.operators import digests
from tallyscope.operators import journal as jn
from tests.test_journal import frame, log, plan


def digest(df):
    row = F.sha2(F.concat_ws("|", "k", "v"), 256)
    return digests.ordered_digest(df, row, [F.col("k")]).first()["digest"]


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_digest_of_an_order(spark, monkeypatch, fan):
    monkeypatch.setattr(digests, "FAN", fan)
    rows = [(k, f"v{k % 5}") for k in range(41)]
    base = digest(spark.createDataFrame(rows, "k long, v string"))
    shuffled = list(rows)
    random.Random(2).shuffle(shuffled)
    assert digest(spark.createDataFrame(shuffled, "k long, v string").repartition(7)) == base
    swapped = [(k, {3: "v4", 4: "v3"}.get(k, v)) for k, v in rows]
    assert digest(spark.createDataFrame(swapped, "k long, v string")) != base
    assert digest(spark.createDataFrame(rows[:-1], "k long, v string")) != base
    assert digest(spark.createDataFrame([], "k long, v string")) == digest(spark.createDataFrame(rows, "k long, v string").limit(0))


def plain_levels(tasks):
    """Longest chains by repeated relaxation; cycles by reachability."""
    out = {}
    for run in {r for r, *_ in tasks}:
        own = {t: {d for d in deps} for r, t, deps in tasks if r == run}
        own = {t: deps & own.keys() for t, deps in own.items()}
        reach = {t: set(deps) for t, deps in own.items()}
        for _ in own:
            reach = {t: found.union(*(own[d] for d in found)) if found else found for t, found in reach.items()}
        level = {}
        while True:
            ready = [t for t in own if t not in level and own[t] <= level.keys()]
            if not ready:
                break
            level |= {t: max((level[d] + 1 for d in own[t]), default=0) for t in ready}
        # Peeled from both ends: on a cycle, or on a way from one to another.
        knots = {t for t in own if t in reach[t]}
        for t in own:
            between = t not in level and any(t in reach[k] for k in knots) and (t in knots or reach[t] & knots)
            problem = None if t in level else jn.CYCLE if between else jn.BEHIND_CYCLE
            out[run, t] = (level.get(t), problem)
    return out


def test_levels_of_random_plans(spark):
    rng = random.Random(3)
    tasks = []
    for run in range(30):
        names = [f"t{k}" for k in range(rng.randrange(1, 12))]
        for k, name in enumerate(names):
            earlier = names[:k] + (names if run % 3 == 0 and rng.random() < 0.3 else [])
            deps = rng.sample(earlier, min(len(earlier), rng.randrange(3))) if earlier else []
            tasks.append((f"r{run}", name, list(dict.fromkeys(deps)) + ["elsewhere"] * (run % 5 == 0)))
    found = jn.plan_levels(spark.createDataFrame(tasks, "run_id string, task_id string, depends_on array<string>").repartition(5))
    expected = plain_levels(tasks)
    # A task on a way from one cycle to another cannot be told from one on a cycle by peeling.
    assert {(r["run_id"], r["task_id"]): (r["level"], r["problem"]) for r in found.collect()} == expected
    assert {p for _, p in expected.values()} == {None, jn.CYCLE, jn.BEHIND_CYCLE}


@pytest.mark.parametrize("small", [0, 6, 1000])
def test_levels_of_small_and_large_plans_are_the_same(spark, small):
    rng = random.Random(5)
    tasks = []
    for run in range(24):
        names = [f"t{k}" for k in range(rng.randrange(1, 9))]
        for k, name in enumerate(names):
            deps = rng.sample(names, rng.randrange(min(2, len(names)) + 1)) if run % 2 else names[max(0, k - 2) : k]
            tasks.append((f"r{run}", name, deps))
    odd = [("r0", None, ["t0"]), ("r0", "bare", None), (None, "a", ["b"]), (None, "b", ["a"]), (None, "a", ["b"]), (None, None, None)]
    frame = spark.createDataFrame(tasks + odd + tasks[:9], "run_id string, task_id string, depends_on array<string>").repartition(5)
    found = [tuple(r) for r in jn.plan_levels(frame, small).collect()]
    expected = plain_levels(tasks) | {("r0", None): (0, None), ("r0", "bare"): (0, None)}
    expected |= {(None, task): (0, None) for task in ("a", "b", None)}
    assert len(found) == len(expected)
    assert {(run, task): (level, problem) for run, task, level, problem in found} == expected


def test_small_plans_take_no_round_for_each_level(spark, monkeypatch):
    monkeypatch.setattr(jn, "_peeled", None)
    chain = [("r", f"t{k}", [f"t{k - 1}"] if k else []) for k in range(300)]
    found = jn.plan_levels(spark.createDataFrame(chain, "run_id string, task_id string, depends_on array<string>"))
    assert {r["task_id"]: r["level"] for r in found.collect()} == {f"t{k}": k for k in range(300)}


def test_levels_agree_with_start_order(spark):
    steps = [("workflow_planned", plan(("a", "x", (), False), ("b", "x", ("a",), False), ("c", "x", ("a", "b"), False)))]
    for name in "abc":
        steps += [("task_started", {"task_id": name}, "x"), ("task_completed", {"task_id": name}, "x")]
    events = frame(spark, log("r", *steps))
    assert jn.task_problems(events).count() == 0
    levels = jn.plan_levels(jn.plan_rows(events)).select("task_id", "level")
    starts = jn.task_events(events).where("kind = 'task_started'").join(levels, "task_id").orderBy("sequence")
    assert [r["level"] for r in starts.collect()] == [0, 1, 2]
    assert jn.plan_levels(jn.plan_rows(events.limit(0))).collect() == []


def test_entity_larger_than_a_batch(spark):
    rows = [("hot", i, float(i % 7)) for i in range(5000)] + [("b", 1, 2.0), (None, 2, 1.0), (None, 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(6)
    schema = "k string, n long, total double, first long, frames long"

    def streamed(key, frames):
        n = total = count = 0
        first = None
        for part in frames:
            assert part["i"].is_monotonic_increasing and len(part) <= 100
            n, total, count = n + len(part), total + part["v"].sum(), count + 1
            first = part["i"].iloc[0] if first is None else first
        yield pd.DataFrame({"k": [key[0]], "n": [n], "total": [total], "first": [first], "frames": [count]})

    def whole(part):
        part = part.sort_values("i")
        return pd.DataFrame({"k": [part["k"].iloc[0]], "n": [len(part)], "total": [part["v"].sum()], "first": [part["i"].iloc[0]], "frames": [0]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = per_entity_in_order(df, ["k"], ["i"], streamed, schema).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grouped = per_entity(df, ["k"], whole, schema).collect()
    key = lambda r: (r[0] is not None, r[0] or "")
    assert [tuple(r)[:4] for r in sorted(found, key=key)] == [tuple(r)[:4] for r in sorted(grouped, key=key)]
    assert max(r["frames"] for r in found) >= 50


def test_function_may_leave_frames(spark):
    df = spark.createDataFrame([(k, i) for k in range(4) for i in range(50)], "k long, i long")

    def first_only(key, frames):
        if key[0] != 2:
            yield next(frames).head(1)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = per_entity_in_order(df, ["k"], ["i"], first_only, "k long, i long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == [(0, 0), (1, 0), (3, 0)]
