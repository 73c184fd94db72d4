import json

import pytest
from pyspark.sql import functions as F

from tallyscope.functions.registry import per_entity, register_functions
from tallyscope.operators import funnel as fn
from tallyscope.operators import screen as sc
from tallyscope.operators.annotations import validate_annotations
from tallyscope.operators.quality import DataViolation, split_candidates
from tallyscope.operators.universe import UniversePolicy, manifest
from tallyscope.plans.screen_plan import run_screen
from tallyscope.sources.screen_pages import parse_pages
from tests.test_universe import document_pages

ISSUERS = 300


def issuer(rank):
    """Pure formulas of the rank: statement facts and market fields of one synthetic issuer."""
    prior = 100_000_000 + 1_000_000 * rank
    revenue = prior * (105 + rank * 17 % 36) // 100
    return {
        "cap": 50_000_000_000 - 50_000_000 * rank,
        "price": 20 + rank / 10,
        "volume": 500_000 + 1_000 * rank,
        "prior": prior,
        "revenue": revenue,
        "net_income": revenue * (7 + rank * 13 % 22) // 100,
        "cash_flow": revenue * (10 + rank * 11 % 24) // 100,
        "capex": -(revenue * (2 + rank * 5 % 6) // 100),
    }


def facts_document(rank):
    x = issuer(rank)

    def year(value, y):
        return {"val": value, "start": f"{y}-01-01", "end": f"{y}-12-31", "filed": f"{y + 1}-02-01", "form": "10-K", "accn": f"{rank:010d}-{y % 100}-000001", "fy": y, "fp": "FY"}

    def concept(*values):
        return {"units": {"USD": list(values)}}

    gaap = {
        "Revenues": concept(year(x["prior"], 2023), year(x["revenue"], 2024)),
        "NetIncomeLoss": concept(year(x["net_income"], 2024)),
        "NetCashProvidedByUsedInOperatingActivities": concept(year(x["cash_flow"], 2024)),
        "PaymentsToAcquirePropertyPlantAndEquipment": concept(year(x["capex"], 2024)),
    }
    return json.dumps({"cik": rank + 1, "entityName": f"Company {rank}", "facts": {"us-gaap": gaap}})


@pytest.fixture(scope="module")
def inputs(spark):
    at = F.lit("2025-03-01").cast("timestamp")
    documents = spark.createDataFrame([(facts_document(i),) for i in range(ISSUERS)], "document string").withColumn("retrieved_at", at)
    quotes = []
    for i in range(ISSUERS):
        x = issuer(i)
        quotes.append((f"T{i:03d}", "EQUITY", "NMS", x["cap"], x["price"], x["volume"], "USD"))
    parsed, pages = parse_pages(document_pages(spark, quotes, 250))
    identities = spark.createDataFrame(
        [(f"T{i:03d}", f"{i + 1:010d}", f"Company {i}", "NYSE") for i in range(ISSUERS)],
        "ticker string, cik string, company string, exchange string",
    )
    return documents, parsed, pages.drop("problem"), identities


def test_three_hundred_issuers(spark, inputs):
    screen = run_screen(*inputs, F.lit("0" * 64), candidate_limit=25)
    row = screen.funnel.first().asDict()
    assert {k: row[k] for k in ("selected", "eligible", "screened", "surfaced", "failed", "excluded", "inspected")} == {
        "selected": 300, "eligible": 300, "screened": 300, "surfaced": 25, "failed": 0, "excluded": 0, "inspected": 300,
    }
    assert row["cache_posture"] == "network"
    top = screen.candidates.orderBy("screen_rank").collect()
    assert [c["screen_rank"] for c in top] == list(range(1, 26))
    assert top[0]["bucket"] == "advance" and top[0]["confidence"] == "high" and top[0]["data_quality"] == "complete"
    first = top[0]
    x = issuer(int(first["ticker"][1:]))
    financials = {f["metric"]: f for f in first["financials"]}
    assert financials["revenue"]["value"] == pytest.approx(x["revenue"] / 1e6)
    assert financials["revenue_growth"]["value"] == round(x["revenue"] / x["prior"] - 1, 6)
    assert financials["net_margin"]["value"] == round(x["net_income"] / x["revenue"], 6)
    assert financials["free_cash_flow_margin"]["value"] == round((x["cash_flow"] + x["capex"]) / x["revenue"], 6)
    assert financials["price_to_sales"]["value"] == round(x["cap"] / x["revenue"], 6)
    assert financials["share_price"]["unit"] == "USD" and financials["revenue"]["unit"] == "USD millions"
    assert set(financials["net_margin"]["source_ids"]) < set(first["evidence_ids"])
    assert split_candidates(screen.candidates)[1].count() == 0
    assert fn.binding_problems(screen.analyses, screen.universe.members, screen.ledger.evidence).count() == 0
    audit = screen.audit.collect()
    assert len(audit) == 300 and all(a["status"] == "screened" and a["source_ids"] for a in audit)
    assert sum(a["surfaced"] for a in audit) == 25
    summary = manifest(screen.universe, "0" * 64, UniversePolicy())

    def fingerprint(candidates):
        return fn.result_fingerprint(summary, screen.funnel, candidates).first()["fingerprint"]

    mark = fingerprint(screen.candidates)
    assert len(mark) == 64 and fingerprint(screen.candidates.repartition(3)) == mark
    assert fingerprint(screen.candidates.withColumn("priority_score", F.lit(1))) != mark
    rows = fn.collection_rows(
        screen.universe.members.select("ticker"),
        screen.ledger.observations.groupBy("ticker").agg(F.count(F.lit(1)).alias("observation_count")),
    )
    assert rows.where("status = 'ready'").count() == 300


def test_failures_and_gate(spark, inputs):
    failures = spark.createDataFrame(
        [
            ("T003", "sec", "facts", "HTTP 500", 1),
            ("T003", "sec", "identity", "missing", 0),
            ("T000", "yfinance", "snapshot", "timed out", 0),
        ],
        "ticker string, provider string, phase string, error string, ord int",
    )
    policy = UniversePolicy(target_size=100, minimum_size=100, page_size=50)
    screen = run_screen(*inputs, F.lit("0" * 64), policy, failures, candidate_limit=5)
    row = screen.funnel.first()
    assert (row["selected"], row["screened"], row["failed"], row["surfaced"]) == (100, 99, 1, 5)
    # Without market values an issuer stays in the screen; its market-based metrics have no value.
    kept = screen.analyses.where("ticker = 'T000'").first()
    assert not kept["has_market"] and kept["failed_providers"] == ["yfinance"] and kept["market_cap_observation"] is None
    every = sc.build_candidates(screen.analyses, screen.ranked)
    assert every.where("bucket = 'exposure_unproven'").select("ticker").collect() == [("T000",)]
    (failed,) = screen.audit.where("status = 'failed'").collect()
    assert failed["failure"] == "sec/identity: missing; sec/facts: HTTP 500" and failed["data_quality"] == "failed"
    done = screen.audit.where("status = 'screened'")
    assert fn.coverage_gate(screen.universe.members, done, 90) == 99
    with pytest.raises(DataViolation):
        fn.coverage_gate(screen.universe.members, done, 100)
    statuses = done.select("ticker", F.lit("sec").alias("provider"), F.lit("ok").alias("status"))
    rows = fn.collection_rows(screen.universe.members.select("ticker"), done.select("ticker", F.lit(1).alias("observation_count")))
    summary = fn.collection_summary(rows, statuses, failures).first().asDict()
    assert summary["ready_count"] == 99 and summary["failed_count"] == 1 and summary["partial"]
    assert summary["sec_successes"] == 99 and summary["sec_failures"] == 2 and summary["yfinance_failures"] == 1


def test_candidate_rules(spark):
    rows = spark.createDataFrame([(True, r, 5, float(s)) for r, s in ((1, 99.5), (2, 50.5), (3, 1.5), (4, 0.4))] + [(False, 1, 5, 120.0)], "m boolean, r int, n int, s double")
    got = rows.select(sc.bucket(F.col("m"), F.col("r"), F.col("n")).alias("b"), sc.priority_score(F.col("s")).alias("p")).collect()
    assert [r["b"] for r in got] == ["advance", "valuation_gated", "valuation_gated", "deprioritized", "exposure_unproven"]
    assert [r["p"] for r in got] == [100, 50, 2, 0, 100]
    assert fn.required_screened(100, 90) == 90 and fn.required_screened(301, 1) == 211
    bad = spark.createDataFrame([("c", "t", 101), ("c", " ", 5), ("c", "t", 5)], "candidate_id string, ticker string, priority_score int")
    good, refused = split_candidates(bad)
    assert good.count() == 1 and {r["problem"] for r in refused.collect()} == {
        "priority_score must be between 0 and 100",
        "candidate ticker must not be empty",
    }


def test_annotations(spark):
    good = {"summary": "fine ]\" x", "risks": ["r"], "questions": [], "source_ids": ["a"]}
    outputs = {
        "ok": json.dumps(good),
        "json": json.dumps(good) + "x",
        "dup": '{"summary":"a","summary":"b"}',
        "extra": json.dumps({**good, "more": 1}),
        "long": json.dumps({**good, "summary": "x" * 2001}),
        "many": json.dumps({**good, "risks": ["r"] * 6}),
        "type": json.dumps({**good, "risks": [1]}),
        "none": json.dumps({**good, "source_ids": []}),
        "twice": json.dumps({**good, "source_ids": ["a", "a"]}),
        "outside": json.dumps({**good, "source_ids": ["a", "zz"]}),
    }
    df = spark.createDataFrame(list(outputs.items()), "id string, output_text string")
    allowed = spark.createDataFrame([(k, "a") for k in outputs], "id string, source_id string")
    result = validate_annotations(df, allowed)
    assert [r["id"] for r in result.accepted.collect()] == ["ok"]
    shape = "invalid_diligence_output"
    assert {r["id"]: r["code"] for r in result.rejected.collect()} == {
        "json": "invalid_json", "dup": "invalid_json", "extra": shape, "long": shape, "many": shape,
        "type": shape, "none": shape, "twice": "invalid_citations", "outside": "source_not_allowed",
    }


def test_sql_functions_and_hook(spark):
    names = register_functions(spark)
    assert len(names) == 53
    row = spark.sql(
        "select fin_gross_margin(40D, 100D) a, fin_revenue_growth(125D, 100D) b, fin_ratio(1D, 0D) c, "
        "fin_enterprise_value(1000D, 300D, null, null, 125D) d, fin_days_sales_outstanding(100D, 1000D, null) e, "
        "fin_cagr(100D, 121D, 2D) f, fin_round_half_even(0.0000005D) g"
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (0.4, 0.25, None, 1175.0, 36.5)
    assert row.f == pytest.approx(0.1) and row.g == 0.0
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    total = per_entity(df, ["k"], lambda pdf: pdf.groupby("k", as_index=False)["v"].sum(), "k string, v double")
    assert sorted(map(tuple, total.collect())) == [("a", 3.0), ("b", 5.0)]
