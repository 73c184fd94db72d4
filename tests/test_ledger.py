from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyscope.functions.text import instant, period_struct, sha256_json, unit_struct
from tallyscope.operators import ledger as lg
from tallyscope.operators import packets as pk
from tallyscope.operators.quality import DataViolation
from tallyscope.operators.records import EVIDENCE_COLUMNS, OBSERVATION_COLUMNS, Batch
from tallyscope.sources.payloads import latest_payloads, stamp_payloads

AT = datetime(2025, 3, 1)


def observations(spark, *rows):
    """(id, entity, name, value, year, symbol, evidence ids)."""
    base = spark.createDataFrame(
        list(rows), "observation_id string, entity_id string, name string, value double, year int, symbol string, evidence_ids array<string>"
    )
    end = F.make_date("year", F.lit(12), F.lit(31))
    start = F.make_date("year", F.lit(1), F.lit(1))
    return base.select(
        "*",
        F.lit("T").alias("ticker"),
        F.col("value").cast("string").alias("value_text"),
        unit_struct(F.lit("currency"), F.col("symbol")).alias("unit"),
        period_struct(F.lit("duration"), start, end, F.col("year"), F.lit("FY")).alias("period"),
        F.lit("{}").alias("metadata"),
    ).select(*OBSERVATION_COLUMNS)


def evidence(spark, *ids):
    base = spark.createDataFrame([(i,) for i in ids], "evidence_id string")
    return base.select(
        "evidence_id",
        F.lit("sec").alias("provider"),
        F.lit("company_fact").alias("source_kind"),
        F.lit("{}").alias("source_locator"),
        F.lit("https://example.com").alias("source_url"),
        F.lit(AT).alias("observed_at"),
        F.lit(AT).alias("retrieved_at"),
        F.sha2("evidence_id", 256).alias("content_hash"),
    ).select(*EVIDENCE_COLUMNS)


def issues(spark, *rows):
    return spark.createDataFrame(list(rows), "entity_id string, code string, provider_path string, message string, ord long")


def batch(spark):
    return Batch(
        observations(
            spark,
            ("o3", "e", "revenue", 125.0, 2024, "USD", ["v3"]),
            ("o1", "e", "revenue", 100.0, 2023, "USD", ["v1"]),
            ("o2", "e", "revenue", 115.0, 2024, "EUR", ["v2", "v1"]),
        ),
        evidence(spark, "v1", "v2", "v3"),
        issues(spark, ("e", "c", "p", "m", 0), ("e", "c", "p", "m", 1)),
    )


def test_store_and_ingest(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = batch(spark)
    lg.create_ledger(first, path)
    lg.ingest(spark, path, first)
    stored = lg.read_ledger(spark, path)
    assert stored.observations.count() == 3 and stored.evidence.count() == 3
    chosen = lg.select_observations(stored.observations, "e", "revenue").collect()
    assert [(r["period"]["end"].year, r["unit"]["symbol"], r["value"]) for r in chosen] == [
        (2023, "USD", 100.0),
        (2024, "EUR", 115.0),
        (2024, "USD", 125.0),
    ]
    period = period_struct(F.lit("duration"), F.lit(date(2023, 1, 1)), F.lit(date(2023, 12, 31)), F.lit(2023), F.lit("fy"))
    assert [r["observation_id"] for r in lg.select_observations(stored.observations, "e", "revenue", period).collect()] == ["o1"]
    changed = Batch(observations(spark, ("o1", "e", "revenue", 101.0, 2023, "USD", ["v1"])), evidence(spark, "v1"), issues(spark))
    with pytest.raises(lg.LedgerCollision, match="observation o1"):
        lg.ingest(spark, path, changed)
    assert lg.read_ledger(spark, path).observations.count() == 3
    spark.createDataFrame([(2,)], "schema_version int").write.parquet(str(tmp_path / "bad" / "evidence"))
    for name in ("observations", "issues"):
        spark.createDataFrame([(1,)], "schema_version int").write.parquet(str(tmp_path / "bad" / name))
    with pytest.raises(DataViolation, match="schema_version"):
        lg.read_ledger(spark, str(tmp_path / "bad"))


def test_dangling_and_resolution(spark):
    b = batch(spark)
    with pytest.raises(DataViolation, match="absent"):
        lg.merge(b, Batch(b.observations, evidence(spark, "v1"), b.issues))
    requested = spark.createDataFrame(
        [("a", 0, "v2"), ("a", 1, "v1"), ("b", 0, "v1"), ("b", 1, "v1"), ("c", 0, "zz")],
        "request_id string, pos int, evidence_id string",
    )
    found, problems = lg.resolve_evidence(requested, b.evidence)
    assert [r["evidence_id"] for r in found.where("request_id='a'").orderBy("pos").collect()] == ["v2", "v1"]
    assert sorted((r["request_id"], r["problem"]) for r in problems.collect()) == [
        ("b", "duplicate evidence ID"),
        ("c", "unknown evidence ID"),
    ]


def test_packets(spark):
    b = batch(spark)
    asked = spark.createDataFrame(
        [("p", "o3"), ("p", "o2"), ("q", "o1"), ("r", "nope"), ("s", "o1"), ("s", "o1")],
        "packet_id string, observation_id string",
    )
    built = pk.build_packets(asked, b.observations, b.evidence)
    packets = {r["packet_id"]: r for r in built.packets.collect()}
    assert set(packets) == {"p", "q"}
    assert packets["p"]["source_ids"] == ["v1", "v2", "v3"] and len(packets["p"]["observations"]) == 2
    assert '"o2"' in packets["p"]["observations"][0]
    assert {r["packet_id"]: r["reason"] for r in built.rejected.collect()} == {
        "r": "unknown observation IDs",
        "s": "observation_ids must not contain duplicates",
    }
    for limits, text in (
        (pk.PacketLimits(observations=1), "max_observations=1"),
        (pk.PacketLimits(evidence=1), "max_evidence=1"),
        (pk.PacketLimits(bytes=100), "max_bytes=100"),
    ):
        rejected = {r["packet_id"]: r["reason"] for r in pk.build_packets(asked, b.observations, b.evidence, limits).rejected.collect()}
        assert text in rejected["p"]
    with pytest.raises(ValueError):
        pk.PacketLimits(observations=0)


def test_packet_sets(spark):
    rows = spark.createDataFrame(
        [
            ("ok", ["a", "b"], ["b", "a"], ["a", "b"]),
            ("gone", ["a", "b"], ["a"], ["a"]),
            ("extra", ["a"], ["a", "b"], ["a", "b"]),
            ("declared", ["a"], ["a"], ["b"]),
        ],
        "packet_id string, referenced array<string>, available array<string>, declared array<string>",
    )
    assert {r["packet_id"]: r["problem"] for r in pk.packet_problems(rows).collect()} == {
        "gone": "missing b",
        "extra": "unreferenced b",
        "declared": "source_ids do not match the evidence records",
    }
    briefs = spark.createDataFrame(
        [("x", ["a"], ["a"]), ("y", ["a", "a"], ["a"]), ("z", ["b"], ["a"])],
        "id string, source_ids array<string>, packet_source_ids array<string>",
    )
    assert sorted(r["id"] for r in pk.attribution_problems(briefs).collect()) == ["y", "z"]


def test_binding(spark):
    b = observations(
        spark,
        ("o1", "e", "revenue", 100.0, 2023, "USD", ["v1"]),
        ("o2", "e", "revenue", 115.0, 2024, "USD", ["v2", "v1"]),
        ("o3", "other", "revenue", 9.0, 2024, "USD", ["v3"]),
        ("o4", "e", "revenue", 9.0, 2024, "EUR", ["v4"]),
    )
    packets = b.withColumn("packet_id", F.lit("p"))
    calls = spark.createDataFrame(
        [
            ("b1", "good", "p", "metrics", ["metrics"]),
            ("b2", "entities", "p", "calculate", ["operations"]),
            ("b3", "currency", "p", "calculate", []),
            ("b4", "raw", "p", "calculate", []),
            ("b5", "outside", "p", "calculate", []),
            ("b6", "lineage", "p", "calculate", ["source_ids"]),
            ("b7", "values", "p", "metrics", ["values"]),
            ("b7", "fine", "p", "metrics", []),
            ("b8", "rank", "p", "rank", []),
        ],
        "batch_id string, call_id string, packet_id string, operation string, supplied array<string>",
    )
    references = spark.createDataFrame(
        [
            ("good", "revenue", 0, "o2", True),
            ("good", "prior_revenue", 1, "o1", True),
            ("entities", "a", 0, "o1", True),
            ("entities", "b", 1, "o3", True),
            ("currency", "a", 0, "o1", True),
            ("currency", "b", 1, "o4", True),
            ("raw", "a", 0, None, False),
            ("outside", "a", 0, "zz", True),
            ("fine", "a", 0, "o1", True),
        ],
        "call_id string, path string, pos int, observation_id string, is_reference boolean",
    )
    bound = pk.bind_observations(calls, references, packets)
    assert sorted((r["call_id"], r["path"], r["value"]) for r in bound.inputs.collect()) == [
        ("good", "prior_revenue", 100.0),
        ("good", "revenue", 115.0),
    ]
    (context,) = bound.context.collect()
    assert context["as_of"] == date(2024, 12, 31) and context["currency"] == "USD" and context["ticker"] == "T"
    assert context["current_period"] == date(2024, 12, 31) and context["prior_period"] == date(2023, 12, 31)
    assert context["period_type"] == "year" and context["source_ids"] == ["v2", "v1"]
    assert {r["call_id"]: r["code"] for r in bound.rejected.collect()} == {
        "entities": "incompatible_observations",
        "currency": "incompatible_observations",
        "raw": "unbound_numeric_input",
        "outside": "observation_not_allowed",
        "lineage": "controller_field_not_allowed",
        "values": "unbound_numeric_input",
        "rank": "binding_not_supported",
    }


def test_price_series(spark):
    rows = [("ok", i, 100.0 + i, date(2024, 1, 1 + i)) for i in range(3)]
    rows += [("short", 0, 1.0, date(2024, 1, 1))]
    rows += [("low", i, float(-i), date(2024, 1, 1 + i)) for i in range(2)]
    rows += [("back", i, 1.0, date(2024, 1, 1)) for i in range(2)]
    series = spark.createDataFrame(rows, "id string, pos int, value double, day date").select(
        "id", "pos", "value", instant(F.col("day")).alias("period")
    )
    assert {r["id"]: r["problem"].split()[-1] for r in pk.price_series_problems(series, ["id"]).collect()} == {
        "short": "references",
        "low": "prices",
        "back": "increasing",
    }


def test_payloads(spark):
    rows = spark.createDataFrame(
        [
            ("sec", "facts", "1", "{}", '{"a":1}', AT - timedelta(hours=9)),
            ("sec", "facts", "1", "{}", '{"a":2}', AT - timedelta(hours=1)),
            ("sec", "facts", "2", "{}", '{"b":1}', AT - timedelta(days=9)),
            ("sec", "facts", "3", "{}", '{"c":1}', AT),
        ],
        "provider string, operation string, identity string, parameters string, payload string, fetched_at timestamp",
    )
    stamped = stamp_payloads(rows).withColumn(
        "payload", F.when(F.col("identity") == "3", "tampered").otherwise(F.col("payload"))
    )
    result = latest_payloads(stamped, AT, timedelta(hours=6))
    assert sorted((r["identity"], r["payload"], r["fresh"]) for r in result.latest.collect()) == [
        ("1", '{"a":2}', True),
        ("2", '{"b":1}', False),
    ]
    assert [r["reason"] for r in result.rejected.collect()] == ["content hash mismatch"]
    one = spark.range(1).select(sha256_json({"b": F.lit(1), "a": F.lit(None).cast("string")}), F.sha2(F.lit('{"a":null,"b":1}'), 256)).first()
    assert one[0] == one[1]


def test_issues_of_two_issuers_are_two(spark):
    issues = spark.createDataFrame(
        [("ticker:A", "missing_currency", "snapshot.currency", "m", 0), ("ticker:B", "missing_currency", "snapshot.currency", "m", 0)]
        + [(None, "invalid_ticker", "snapshot.ticker", "m", 0)] * 2,
        "entity_id string, code string, provider_path string, message string, ord long",
    )
    b = batch(spark)
    empty = Batch(*[t.limit(0) for t in b._replace(issues=issues)])
    step = lg.plan_ingest(empty, b._replace(issues=issues))
    assert sorted(str(r["entity_id"]) for r in step.issues.collect()) == ["None", "ticker:A", "ticker:B"]
    again = lg.plan_ingest(b._replace(issues=issues), b._replace(issues=issues))
    assert again.issues.count() == 0
