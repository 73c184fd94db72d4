import json
import re

from pyspark.sql import functions as F

from tallyscope.operators.records import bounded_issues, check_batch
from tallyscope.sources.company_facts import RULES, normalize_company_facts, rekey_to_ticker

AT = "2025-03-01 00:00:00"


def fact(val, end, filed, form="10-K", start=None, accn="0000000001-25-000001", **extra):
    row = {"val": val, "end": end, "filed": filed, "form": form, "accn": accn, **extra}
    if start is not None:
        row["start"] = start
    return row


def document(facts, cik=1, **extra):
    return json.dumps({"cik": cik, "entityName": "Example Inc", "tickers": ["EXM"], "facts": facts, **extra})


def normalize(spark, *documents):
    raw = spark.createDataFrame([(d,) for d in documents], "document string").withColumn(
        "retrieved_at", F.lit(AT).cast("timestamp")
    )
    return normalize_company_facts(raw)


def test_rule_table():
    assert len(RULES) == 43
    by_concept = {r[1]: r for r in RULES}
    assert by_concept["Revenues"][4] == 2
    assert by_concept["PaymentsOfDividendsCommonStock"][4:] == (1, True)


def test_restatement_units_and_signs(spark):
    year = {"start": "2024-01-01", "fy": 2024, "fp": "FY"}
    gaap = {
        "RevenueFromContractWithCustomerExcludingAssessedTax": {
            "label": "Revenue",
            "units": {
                "USD": [
                    fact(100, "2024-12-31", "2025-01-31", **year),
                    fact(105, "2024-12-31", "2025-02-15", "10-K/A", **year),
                    fact(30, "2024-03-31", "2024-05-01", "10-Q", start="2024-01-01", fy=2024, fp="Q1"),
                    fact(7, "2024-12-31", "2025-02-15", "8-K", **year),
                ]
            },
        },
        "Revenues": {"units": {"USD": [fact(104, "2024-12-31", "2025-02-15", "10-K/A", **year)]}},
        "PaymentsToAcquirePropertyPlantAndEquipment": {
            "units": {"USD": [fact(-12, "2024-12-31", "2025-01-31", **year)]}
        },
        "Assets": {"units": {"USD": [fact(400, "2024-12-31", "2025-01-31", fy=2024, fp="FY")]}},
        "SomethingElse": {"units": {"USD": [fact(1, "2024-12-31", "2025-01-31")]}},
    }
    batch = normalize(spark, document({"us-gaap": gaap}))
    rows = {(r["name"], str(r["period"]["end"])): r for r in batch.observations.collect()}
    assert len(rows) == 4 and batch.evidence.count() == 4 and batch.issues.count() == 0
    assert rows[("revenue", "2024-12-31")]["value"] == 105.0
    assert json.loads(rows[("revenue", "2024-12-31")]["metadata"])["concept"].startswith("RevenueFrom")
    assert rows[("revenue", "2024-03-31")]["value"] == 30.0
    capex = rows[("capital_expenditures", "2024-12-31")]
    meta = json.loads(capex["metadata"])
    assert capex["value"] == 12.0 and meta["reported_value"] == -12 and meta["sign_policy"] == "absolute"
    assets = rows[("total_assets", "2024-12-31")]
    assert assets["period"]["kind"] == "instant" and assets["period"]["start"] is None
    assert assets["ticker"] == "EXM" and assets["entity_id"] == "cik:0000000001"
    urls = {r["source_url"] for r in batch.evidence.collect()}
    assert urls == {"https://www.sec.gov/Archives/edgar/data/1/000000000125000001/"}
    check_batch(batch)


def test_contexts_stay_apart(spark):
    units = {
        "USD": [
            fact(20, "2024-06-30", "2024-08-01", "10-Q", start="2024-04-01"),
            fact(35, "2024-06-30", "2024-08-01", "10-Q", start="2024-01-01"),
        ],
        "EUR": [fact(32, "2024-06-30", "2024-08-01", "10-Q", start="2024-01-01")],
    }
    batch = normalize(spark, document({"us-gaap": {"Revenues": {"units": units}}}))
    assert sorted((r["value"], r["unit"]["symbol"]) for r in batch.observations.collect()) == [
        (20.0, "USD"),
        (32.0, "EUR"),
        (35.0, "USD"),
    ]


def test_issue_codes(spark):
    good = ("2024-12-31", "2025-01-31")
    units = {
        "USD": [
            "text",
            fact(1, *good, form=None),
            fact(1, *good, accn=" "),
            fact(True, *good),
            fact("1", *good),
            fact(1, "2024-13-01", good[1]),
            fact(1, good[0], "soon"),
            fact(1, *good, start="2025-01-01"),
            fact(1, *good, fy=True),
            fact(1, *good, fy=99),
            fact(1, *good, start=5),
        ],
        "shares": [fact(1, *good)],
        "JPY": {},
    }
    gaap = {"Revenues": {"units": units}, "Assets": {"units": []}, "GrossProfit": 5, "NetIncomeLoss": None}
    batch = normalize(spark, document({"us-gaap": gaap}))
    assert batch.observations.count() == 0
    found = sorted((r["code"], r["provider_path"].rsplit(".", 1)[-1], r["message"]) for r in batch.issues.collect())
    assert found == sorted(
        [
            ("invalid_concept", "GrossProfit", "known concept payload must be an object"),
            ("invalid_concept", "NetIncomeLoss", "known concept payload must be an object"),
            ("invalid_units", "units", "units must be an object"),
            ("invalid_unit_facts", "JPY", "unit facts must be an array"),
            ("unsupported_unit", "shares", "'shares' is not valid for canonical metric revenue"),
            ("invalid_fact", "USD[0]", "fact must be an object"),
            ("missing_form", "USD[1]", "fact is missing its filing form"),
            ("missing_accession", "USD[2]", "fact is missing its accession number"),
            ("invalid_fact", "USD[3]", "val must be a finite JSON number"),
            ("invalid_fact", "USD[4]", "val must be a finite JSON number"),
            ("invalid_fact", "USD[5]", "end must be an ISO date"),
            ("invalid_fact", "USD[6]", "filed must be an ISO date"),
            ("invalid_fact", "USD[7]", "period start must not be after period end"),
            ("invalid_fact", "USD[8]", "fy must be a four-digit year"),
            ("invalid_fact", "USD[9]", "fiscal_year must be a four-digit year"),
            ("invalid_fact", "USD[10]", "start must be an ISO date"),
        ]
    )


def test_issue_cap_and_bad_documents(spark):
    bad = [fact(None, "2024-12-31", "2025-01-31") for _ in range(120)]
    capped = document({"us-gaap": {"Revenues": {"units": {"USD": bad, "shares": []}}}})
    batch = normalize(spark, capped, document({}, cik="x"), document([], cik=2), '{"cik": 3, "cik": 4}')
    issues = batch.issues.collect()
    first = [r for r in issues if r["entity_id"] == "cik:0000000001"]
    assert len(first) == 121
    capped_rows = bounded_issues(batch.issues, 100).where("entity_id = 'cik:0000000001'").collect()
    assert len(capped_rows) == 100
    closing = [r for r in capped_rows if r["code"] == "issues_truncated"]
    assert [r["message"] for r in closing] == ["22 additional normalization issue(s) omitted"]
    others = sorted((r["entity_id"] or "", r["code"]) for r in issues if r["entity_id"] != "cik:0000000001")
    assert others == [("", "invalid_document"), ("", "invalid_document"), ("cik:0000000002", "invalid_facts")]


def test_rekey(spark):
    gaap = {"Assets": {"units": {"USD": [fact(400, "2024-12-31", "2025-01-31")]}}}
    batch = normalize(spark, document({"us-gaap": gaap}))
    issuers = spark.createDataFrame([("EXM", "0000000001", "Example")], "ticker string, cik string, company string")
    (row,) = rekey_to_ticker(batch.observations, issuers).collect()
    assert row["entity_id"] == "ticker:EXM" and row["observation_id"] != batch.observations.first()["observation_id"]
    assert json.loads(row["metadata"])["resolved_cik"] == "0000000001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_derived_texts_do_not_travel(spark):
    """Only narrow rows go into the choice of the latest fact; texts that follow from them are made afterwards."""
    gaap = {"Assets": {"units": {"USD": [fact(400, "2024-12-31", "2025-01-31")]}}}
    plan = plan_of(normalize(spark, document({"us-gaap": gaap})).observations)
    (chosen,) = re.findall(r"max_by\(struct\((.*?)\), struct\(filed", plan)
    assert "accession" in chosen and not {"metadata", "source_locator", "source_url", "fact_path"} & set(re.findall(r"\w+", chosen))


def test_issues_need_no_second_parse(spark):
    batch = normalize(spark, document([], cik=2), document({"us-gaap": {"Assets": []}}), "no")
    assert sorted(r["code"] for r in batch.issues.collect()) == ["invalid_concept", "invalid_document", "invalid_facts"]
    assert "parse_json" not in plan_of(batch.issues).lower() and "parsejson" not in plan_of(batch.issues).lower()


def test_long_documents_are_not_dealt_out(spark):
    """The driver's queries deal the narrow rows out before the documents are built."""
    from tallyscope.plans.data_queries import _concept_documents, _fact_documents

    for build in (_concept_documents, _fact_documents):
        plan = plan_of(build(spark, "/root/testdata/sf0.001"))
        assert plan.index("Project") < plan.index("Repartition") and "document" not in plan[plan.index("Repartition") :]


def test_issues_alone_equal_those_of_the_batch_and_write_nothing(spark):
    from tallyscope import session
    from tallyscope.sources.company_facts import company_fact_issues

    good = ("2024-12-31", "2025-01-31")
    values = [1, 1.5, -2, 1e300, True, "1", None, {}, [1]]
    dates = ["2024-12-31", "20241231", "2024-1-31", "2024-02-30", " 2024-12-31", "2024123", 20241231, None]
    facts = [fact(v, *good) for v in values] + [fact(1, d, good[1]) for d in dates] + [fact(1, good[0], d) for d in dates]
    facts += [fact(1, *good, form=x) for x in ("8-K", " 10-k ", "", 5)] + [fact(1, *good, fy=x) for x in (2024, "2024", 99, [], "x")]
    gaap = {"Revenues": {"units": {"USD": facts, "USD/shares": facts, "pure": [], "x/shares": {}}}, "Assets": {"units": []}}
    odd = [document(x) for x in ([], {}, None, 5, {"us-gaap": []}, {"us-gaap": gaap})]
    odd += [document({"us-gaap": gaap}, cik=x) for x in ("CIK7", " 8 ", "CIKCIK9", "", None, 1.5)]
    odd.append(document({"us-gaap": {"Assets": {"units": {"USD": [fact(0, *good)]}}}}).replace('"val": 0', '"val": 1e400'))
    raw = spark.createDataFrame([(d,) for d in odd], "document string").withColumn("retrieved_at", F.lit(AT).cast("timestamp"))
    wanted = sorted(map(str, normalize_company_facts(raw).issues.collect()))
    before = len(session._settled)
    issues = company_fact_issues(raw)
    assert sorted(map(str, issues.collect())) == wanted and len(wanted) > 80
    assert len(session._settled) == before
    # Type texts of whole documents cost more than their parse.
    assert "schemaofvariant(_facts" not in plan_of(issues).lower() and "schemaofvariant(_whole" not in plan_of(issues).lower()


def test_kinds_are_told_without_copies(spark):
    from tallyscope.sources.company_facts import _is, company_fact_issues

    objects = ['{}', '{"a": 1}', '{"a": {"b": [1]}, "": null, "0": "x"}']
    arrays = ['[]', '[1]', '[null]', '["x", 1.5, true, {}, [[]]]', '[{"a": 1}]', '[{}, "x"]']
    others = ['1', '1.5', 'true', 'null', '"[]"', '"{}"', '""', "no"]
    rows = [(text, text in objects, text in arrays) for text in (*objects, *arrays, *others)]
    values = spark.createDataFrame(rows, "text string, is_object boolean, is_array boolean").selectExpr("*", "try_parse_json(text) as v")
    told = values.selectExpr("is_object", "is_array", f"{_is('OBJECT', 'v')} as o", f"{_is('ARRAY', 'v')} as a").collect()
    assert [(r.o, r.a) for r in told] == [(r.is_object, r.is_array) for r in told]

    units = {"USD": [], "EUR": {}, "GBP": [5], "JPY": ["x", fact(1, "2024-12-31", "2025-01-31")], "CHF": "[]", "shares": 5, "pure": None}
    raw = spark.createDataFrame([(document({"us-gaap": {"Assets": {"units": units}}}),)], "document string")
    issues = company_fact_issues(raw.withColumn("retrieved_at", F.lit(AT).cast("timestamp")))
    found = sorted((r["code"], r["provider_path"].rsplit(".", 1)[1]) for r in issues.collect())
    assert found == [
        ("invalid_fact", "GBP[0]"),
        ("invalid_fact", "JPY[0]"),
        *[("invalid_unit_facts", unit) for unit in ("CHF", "EUR", "pure", "shares")],
    ]
    # A copy of all members costs time for each document, concept and unit.
    assert not {"MapType(StringType,VariantType", "ArrayType(VariantType"} & set(re.findall(r"(?:Map|Array)Type\([^()]*VariantType", plan_of(issues)))
