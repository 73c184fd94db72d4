import random
from datetime import timedelta

from pyspark.sql import functions as F

from tallyscope.operators import journal as jn
from tallyscope.sources.journal_files import stream_journal, write_journal
from tallyscope.streaming import journal_stream as js
from tests.test_journal import AT, LIFE, SCHEMA, frame, log


def scattered(spark, tmp_path, rows, files=6, seed=1):
    """Rows spread over files at random, one file per micro-batch."""
    rng = random.Random(seed)
    parts = [[] for _ in range(files)]
    for row in rows:
        rng.choice(parts).append(row)
    folder = tmp_path / f"in{seed}"
    for i, part in enumerate(parts):
        rng.shuffle(part)
        frame(spark, part).coalesce(1).write.parquet(str(folder / f"part={i}"))
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    )


def finish(query):
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive


def sample_rows():
    rows = list(LIFE)
    for run in range(12):
        kinds = ["run_created", "run_started"] + ["tool_started", "tool_completed"] * 5
        if run % 3 == 0:
            kinds += ["run_failed", "agent_started"]
        rows += log(f"r{run}", *kinds)
    return rows


def test_order_matches_batch(spark, tmp_path):
    rows = sample_rows()
    stream = scattered(spark, tmp_path, rows)
    finish(js.append_batches(js.order_events(stream), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = js.read_batches(spark, str(tmp_path / "out"), js.VERDICT_SCHEMA)
    accepted = {(r["run_id"], r["sequence"]) for r in got.where("reason is null").collect()}
    batch = jn.check_sequence(frame(spark, rows))
    assert accepted == {(r["run_id"], r["sequence"]) for r in batch.accepted.collect()}
    refused = {(r["run_id"], r["sequence"], r["reason"]) for r in got.where("reason is not null").collect()}
    assert refused == {(r["run_id"], r["sequence"], r["reason"]) for r in batch.rejected.collect()}


def test_fold_counts_and_upserts(spark, tmp_path):
    rows = sample_rows()
    finish(js.append_batches(js.fold_runs(scattered(spark, tmp_path, rows, seed=2)), str(tmp_path / "s"), str(tmp_path / "c1"), "update"))
    states = {r["run_id"]: r for r in js.newest(js.read_batches(spark, str(tmp_path / "s"), js.STATE_SCHEMA), ["run_id"]).collect()}
    expected = {r["run_id"]: r for r in jn.run_states(jn.check_sequence(frame(spark, rows)).accepted).collect()}
    assert set(states) == set(expected)
    for run, row in expected.items():
        for name in ("status", "current_stage", "progress", "last_sequence"):
            assert states[run][name] == row[name], (run, name)
    assert states["r0"]["rejected"] == 1 and states["r1"]["tool_calls"] == 5

    counts = js.live_counts(scattered(spark, tmp_path, rows, seed=3))
    finish(js.append_batches(counts, str(tmp_path / "n"), str(tmp_path / "c2"), "update"))
    newest = js.newest(js.read_batches(spark, str(tmp_path / "n"), counts.schema), ["run_id", "family"])
    assert {tuple(r) for r in newest.collect()} == {tuple(r) for r in jn.family_counts(frame(spark, rows)).collect()}

    finish(js.upsert_payloads(scattered(spark, tmp_path, rows, seed=4), "evidence_added", "evidence_id", str(tmp_path / "u"), str(tmp_path / "c3")))
    (row,) = js.newest_payloads(spark, str(tmp_path / "u")).collect()
    assert row["id"] == "e1" and '"new"' in row["payload"]


def test_open_gap_times_out(spark, tmp_path):
    early = [r for r in log("gap", *["run_started"] * 4) if r[2] != 1]
    late = [tuple([1, "clock", i, "run_started", AT + timedelta(days=i + 1), "m", None, "{}"]) for i in range(3)]
    folder = tmp_path / "in"
    for i, part in enumerate([early, late[:1], late[1:2], late[2:]]):
        frame(spark, part).coalesce(1).write.parquet(str(folder / f"part={i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    finish(js.append_batches(js.order_events(stream, "1 minute", 60.0), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = js.read_batches(spark, str(tmp_path / "out"), js.VERDICT_SCHEMA).where("run_id = 'gap'")
    assert {(r["sequence"], r["reason"]) for r in got.collect()} == {
        (0, None),
        (2, "event sequence does not match expected"),
        (3, "event sequence does not match expected"),
    }


def test_journal_files_stream(spark, tmp_path):
    write_journal(frame(spark, LIFE), str(tmp_path / "j"))
    events, quarantine = stream_journal(spark, str(tmp_path / "j"))
    assert events.isStreaming and quarantine.isStreaming
    finish(js.append_batches(events, str(tmp_path / "o"), str(tmp_path / "c")))
    assert spark.read.parquet(str(tmp_path / "o")).agg(F.count_distinct("sequence")).first()[0] == len(LIFE)
