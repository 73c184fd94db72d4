import random
from datetime import timedelta

import pytest
from pyspark.sql import Row, functions as F

from tallyscope.operators import journal as jn
from tallyscope.operators import run_blocks as rb
from tallyscope.streaming import run_blocks as srb
from tests.test_journal import AT, LIFE, SCHEMA, frame, log
from tests.test_streaming import scattered

STATE = ["status", "current_stage", "workflow_id", "workflow_version", "failure", "last_sequence", "progress", "completed_stages"]
KINDS = [
    ("run_started", "{}"),
    ("stage_started", '{"stage":"evidence","progress":30}'),
    ("stage_completed", '{"stage":"universe","progress":12}'),
    ("stage_completed", '{"stage":"analysis"}'),
    ("run_synthesizing", "{}"),
    ("run_synthesizing", '{"progress":90}'),
    ("tool_started", "{}"),
    ("workflow_planned", '{"workflow_id":"w","workflow_version":"2"}'),
    ("agent_progress", "{}"),
]


def many_runs(seed, span, runs=25):
    """Runs around the block bounds: whole, with gaps, copies, endings, unknown kinds, and without their start."""
    rng = random.Random(seed)
    rows = list(LIFE)
    for run in range(runs):
        length = rng.choice([1, span - 1, span, span + 1, 2 * span, 5 * span + 3])
        own = []
        for i in range(length):
            kind, payload = rng.choice(KINDS)
            own.append((1, f"r{run}", i, kind, AT + timedelta(seconds=i // 3), f"m{i}", None, payload))
        fault = run % 6
        at = rng.randrange(length)
        if fault == 1:
            del own[at]
        elif fault == 2:
            own += [own[at]] * 2
            own.append(own[at][:5] + ("another copy",) + own[at][6:])
        elif fault == 3:
            own[at] = own[at][:3] + ("run_failed", own[at][4], "broken", None, "{}")
        elif fault == 4:
            own[at] = own[at][:3] + ("nonsense",) + own[at][4:]
        elif fault == 5 and length > span:
            own = own[span:]
        rows += own
    return [*rows, (1, "r0", -1, "run_started", AT, "m", None, "{}"), (1, "r0", None, "run_started", AT, "m", None, "{}")]


def both(blocks, events):
    """States and verdicts from the blocks and by the batch operators."""
    known = rb.limits(blocks)
    for limits in (known, None):
        checked = jn.check_sequence(events, limits)
        states = rb.states(blocks) if limits is not None else jn.run_states(checked.accepted)
        yield (
            sorted(map(tuple, states.select("run_id", *STATE).collect())),
            sorted((r["run_id"], r["sequence"]) for r in checked.accepted.collect()),
            sorted((r["run_id"], r["sequence"] is not None, r["sequence"], r["reason"], r["copies"]) for r in checked.rejected.collect()),
        )


@pytest.fixture
def short_blocks(monkeypatch):
    """Blocks of 16 events, composed four at a time, so that runs have several levels."""
    monkeypatch.setattr(rb, "SPAN", 16)
    monkeypatch.setattr(rb, "FAN", 4)
    monkeypatch.setattr(srb, "_SPAN", 16)


def test_stream_equals_batch(spark, tmp_path, short_blocks):
    rows = many_runs(1, 16)
    blocks = srb.run_to_end(scattered(spark, tmp_path, rows, seed=11), str(tmp_path / "w")).cache()
    from_blocks, from_batch = both(blocks, frame(spark, rows))
    assert from_blocks == from_batch
    assert blocks.where("run_id = 'r5'").count() <= 6 and blocks.count() == blocks.dropDuplicates(["run_id", "block"]).count()


def test_a_long_run_is_many_blocks(spark, tmp_path):
    """A run with nearly all events: no block holds more than its span, and the state is that of the whole log."""
    kind = F.when(F.col("id") == 0, "run_created").when(F.col("id") % 7 == 0, "tool_started").otherwise("stage_completed")
    payload = F.concat(F.lit('{"stage":"universe","progress":'), (F.col("id") % 90).cast("string"), F.lit("}"))
    events = spark.range(30_000).select(
        F.lit(1).alias("schema_version"), F.lit("hot").alias("run_id"), F.col("id").alias("sequence"), kind.alias("kind"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("timestamp"), F.lit("m").alias("message"),
        F.lit(None).cast("string").alias("agent_id"), payload.alias("payload"),
    )
    events = events.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")])
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    blocks = srb.run_to_end(stream, str(tmp_path / "w")).cache()
    assert blocks.count() == -(-30_000 // rb.SPAN) and blocks.where("gap is null").count() == 30_000 // rb.SPAN
    (state,) = rb.states(blocks).collect()
    (batch,) = jn.run_states(events).collect()
    assert [state[n] for n in STATE] == [batch[n] for n in STATE] and state["last_sequence"] == 29_999
    assert state["tool_calls"] == events.where("kind = 'tool_started'").count()


def test_composition_is_associative(spark, tmp_path, short_blocks, monkeypatch):
    rows = many_runs(7, 16, 12)
    blocks = srb.run_to_end(scattered(spark, tmp_path, rows, seed=12), str(tmp_path / "w")).cache()
    found = []
    for fan in (2, 3, 64):
        monkeypatch.setattr(rb, "FAN", fan)
        found.append(sorted(map(str, rb.compose(blocks).collect())))
    assert found[0] == found[1] == found[2]


def test_snapshot_and_tail(spark, tmp_path, short_blocks):
    """A stream that starts from a snapshot and reads only the later events ends in the state of the whole log."""
    rows = many_runs(3, 16)
    early = [r for r in rows if r[2] is not None and r[2] < 21]
    late = [r for r in rows if r[2] is None or r[2] >= 21]
    snapshot = srb.run_to_end(scattered(spark, tmp_path, early, seed=13), str(tmp_path / "w1")).cache()
    blocks = srb.run_to_end(scattered(spark, tmp_path, late, seed=14), str(tmp_path / "w2"), snapshot).cache()
    from_blocks, from_batch = both(blocks, frame(spark, rows))
    assert from_blocks == from_batch


def test_no_events(spark, tmp_path):
    frame(spark, log("r", "run_created")).limit(0).write.parquet(str(tmp_path / "in"))
    assert rb.states(spark.createDataFrame([], srb.BLOCK_ROWS)).collect() == []
    assert rb.limits(spark.createDataFrame([], srb.BLOCK_ROWS)).collect() == []


class _Value:
    """A value state in memory."""

    def __init__(self):
        self.row = None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class _Handle:
    def getValueState(self, name, schema):
        return _Value()


def test_a_key_gets_rows_and_takes_them_in_parts(monkeypatch):
    """Rows in parts, over several calls, give what all of them give at once; copies and missing values included."""
    names = srb._PACKED.names
    rng = random.Random(5)
    row = Row(*names)
    rows = [
        row(k, 1, k != 8, False, 100 + k, rng.randrange(9), k % 3 == 0, None if k % 2 else float(k), None, None, "s" if k == 4 else None, *[None] * 4)
        for k in [*range(12), 3]
    ]
    rng.shuffle(rows)

    def fold(*calls):
        processor = srb.BlockFold()
        processor.init(_Handle())
        return [next(iter(processor.handleInputRows(("r", 0), iter(call), None))).asDict() for call in calls][-1]

    whole = fold(rows)
    monkeypatch.setattr(srb, "_AT_ONCE", 2)
    parts = fold(rows[:5], rows[5:])
    assert parts == whole and whole["invalid"] == 8 and whole["twice"] == 4 and whole["last_sequence"] == 3 and whole["set_to"] == 2
