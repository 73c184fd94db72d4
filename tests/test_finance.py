import random
import statistics
from datetime import date, timedelta
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import arithmetic as A
from tallyscope.functions.numeric import one_decimal_text, round_half_even
from tallyscope.operators import forecast as fc
from tallyscope.operators import market as mk
from tallyscope.operators.ordering import medians
from tallyscope.operators.metrics import FACT_NAMES, METRIC_NAMES, add_metrics, metrics_long, pivot_facts


def facts(spark, **values):
    columns = ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([(1, *[None if v is None else float(v) for v in values.values()])], f"id int, {columns}")


def measured(spark, *names, precision=6, **values):
    rows = metrics_long(facts(spark, **values), ["id"], names or None, precision).collect()
    return {r["metric"]: r for r in rows}


def test_catalog(spark):
    assert len(METRIC_NAMES) == 47 and len(FACT_NAMES) == 55
    rows = measured(spark, revenue=1)
    assert list(rows) == list(METRIC_NAMES)
    assert rows["incremental_operating_margin"]["formula"] == "(operating_income - prior_operating_income) / (revenue - prior_revenue)"
    assert rows["days_sales_outstanding"]["formula"] == "average_accounts_receivable / revenue * days_in_period"


def test_growth_and_reasons(spark):
    rows = measured(spark, "revenue_growth", "gross_profit", "net_margin", revenue=125, prior_revenue=100)
    assert rows["revenue_growth"]["value"] == 0.25 and rows["revenue_growth"]["inputs"] == {"revenue": 125.0, "prior_revenue": 100.0}
    assert rows["gross_profit"]["reason"] == "missing required input(s): cost_of_revenue"
    rows = measured(spark, "gross_margin", "gross_profit", revenue=0, cost_of_revenue=5)
    assert rows["gross_margin"]["value"] is None and rows["gross_margin"]["reason"] == "zero denominator: revenue"
    assert rows["gross_profit"]["value"] == -5
    both = measured(spark, "working_capital", market_cap=1)["working_capital"]["reason"]
    assert both == "missing required input(s): current_assets; missing required input(s): current_liabilities"


def test_enterprise_value_and_aliases(spark):
    rows = measured(spark, "enterprise_value", "net_debt_to_ebitda", market_capitalization=1000, debt=300, cash=125, ebitda=70)
    assert rows["enterprise_value"]["value"] == 1175 and rows["enterprise_value"]["inputs"]["preferred_stock"] == 0
    assert rows["net_debt_to_ebitda"]["value"] == 2.5


def test_derived_metrics_ignore_supplied_values(spark):
    rows = measured(spark, "gross_profit", "gross_margin", revenue=100, cost_of_revenue=60, gross_profit=50)
    assert rows["gross_profit"]["value"] == 40 and rows["gross_margin"]["value"] == 0.5


def test_components(spark):
    rows = measured(
        spark, "ebitda_margin", "quick_ratio", "return_on_invested_capital", "dividend_yield", "earnings_per_share_growth",
        "return_on_assets", "rule_of_40",
        revenue=1000, operating_income=100, depreciation_and_amortization=20, cash_and_equivalents=30, accounts_receivable=20,
        current_liabilities=30, effective_tax_rate=0.25, invested_capital=500, dividends_per_share=2, shares_outstanding=10,
        share_price=40, net_income=50, prior_net_income=40, prior_shares_outstanding=10, total_assets=500, revenue_growth=0.3,
    )
    got = {k: v["value"] for k, v in rows.items()}
    assert got == {
        "ebitda_margin": 0.12, "quick_ratio": 1.666667, "return_on_invested_capital": 0.15, "dividend_yield": 0.05,
        "earnings_per_share_growth": 0.25, "return_on_assets": 0.1, "rule_of_40": 0.42,
    }
    why = measured(spark, "quick_ratio", "return_on_invested_capital", "interest_coverage", ebit=1)
    assert why["quick_ratio"]["reason"].startswith("missing required input(s): quick_assets, (current_assets and inventory)")
    assert "net_operating_profit_after_tax or (ebit and effective_tax_rate)" in why["return_on_invested_capital"]["reason"]
    zero = measured(spark, "earnings_per_share_growth", net_income=1, diluted_shares_outstanding=0, prior_earnings_per_share=1)
    assert zero["earnings_per_share_growth"]["reason"] == "zero denominator: diluted_shares_outstanding"


def test_cash_cycle(spark):
    rows = measured(
        spark, "days_sales_outstanding", "days_inventory_outstanding", "days_payables_outstanding", "cash_conversion_cycle",
        accounts_receivable=100, inventory=80, accounts_payable=60, revenue=1000, cost_of_revenue=400,
    )
    assert [r["value"] for r in rows.values()] == [36.5, 73.0, 54.75, 54.75]
    reason = measured(spark, "cash_conversion_cycle", accounts_receivable=1, revenue=0, inventory=1, accounts_payable=1)["cash_conversion_cycle"]["reason"]
    assert reason == (
        "days_sales_outstanding: zero denominator: revenue; "
        "days_inventory_outstanding: missing required input(s): cost_of_revenue; "
        "days_payables_outstanding: missing required input(s): cost_of_revenue"
    )


def test_add_metrics_and_arguments(spark):
    df = facts(spark, revenue=3, cost_of_revenue=1, gross_profit=9)
    wide = add_metrics(df, ["gross_profit", "gross_margin"], 2, reasons=True).first().asDict()
    assert wide["gross_profit"] == 2 and wide["gross_margin"] == 3.0 and wide["gross_margin_reason"] is None
    assert add_metrics(df, ["gross_profit"], prefix="m_").first().asDict()["gross_profit"] == 9
    for bad in (["nope"], [], ["gross_profit", "gross_profit"]):
        with pytest.raises(ValueError):
            add_metrics(df, bad)
    with pytest.raises(ValueError):
        add_metrics(df, precision=13)
    with pytest.raises(ValueError):
        add_metrics(spark.createDataFrame([("x",)], "revenue string"), ["net_margin"])


def test_pivot(spark):
    rows = spark.createDataFrame(
        [("e", "revenue", 1.0, "o1"), ("e", "revenue", 2.0, "o2"), ("e", "net_income", 3.0, "o3"), ("f", "other", 4.0, "o4")],
        "entity_id string, name string, value double, observation_id string",
    )
    (row,) = pivot_facts(rows, ["entity_id"], ["revenue", "net_income", "ebit"]).collect()
    assert (row["revenue"], row["net_income"], row["ebit"]) == (2.0, 3.0, None)


def test_rounding(spark):
    values = [2.345, 2.355, -0.0000001, 1e22, 123456.5, 0.0078125, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(round_half_even("x", 2)).collect()] == [2.34, 2.36, 0.0, 1e22, 123456.5, 0.01, None]
    assert df.select(round_half_even(F.col("x"), 0)).collect()[4][0] == 123456.0
    texts = [65.35, 0.05, -0.04, 0.25, 99.95, 1234567.85, 20.88, 0.0, -7.25, 1e-9]
    got = spark.createDataFrame([(v,) for v in texts], "x double").select(one_decimal_text("x")).collect()
    assert [r[0] for r in got] == [f"{v:.1f}" for v in texts]


def test_arithmetic(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0, 10.0], [1.0, 0.0, 0.0, 3.0], 121.0, 100.0, 2.0)], "k int, v array<double>, w array<double>, a double, b double, n double")
    pair = {"current": "a", "prior": "b"}
    operations = [
        A.Operation("s", "sum", {"values": "v"}),
        A.Operation("p", "product", {"values": "v"}),
        A.Operation("m", "mean", {"values": "v"}),
        A.Operation("md", "median", {"values": "v"}),
        A.Operation("wa", "weighted_average", {"values": "v", "weights": "w"}),
        A.Operation("d", "difference", pair),
        A.Operation("r", "ratio", {"numerator": "a", "denominator": F.lit(0.0)}),
        A.Operation("pc", "percent_change", pair),
        A.Operation("bp", "basis_point_change", pair),
        A.Operation("c", "cagr", {"start": "b", "end": "a", "periods": "n"}),
        A.Operation("neg", "weighted_average", {"values": "v", "weights": F.transform("w", lambda x: -x)}),
    ]
    rows = {r["id"]: r for r in A.calculate(df, ["k"], operations).collect()}
    got = {k: r["value"] for k, r in rows.items()}
    assert got == {"s": 17.0, "p": 80.0, "m": 4.25, "md": 3.0, "wa": 7.75, "d": 21.0, "r": None, "pc": 0.21, "bp": 210000.0, "c": 0.1, "neg": None}
    assert rows["r"]["reason"] == "denominator must not be zero" and rows["neg"]["reason"] == "weights must be non-negative"
    assert rows["bp"]["unit"] == "basis_points" and rows["c"]["formula"] == "(end / start) ** (1 / periods) - 1"
    for bad in ([], [A.Operation("x", "sum", {})], [A.Operation(" ", "sum", {"values": "v"})], [operations[0], operations[0]], [A.Operation("q", "mode", {})]):
        with pytest.raises(ValueError):
            A.calculate(df, ["k"], bad)
    tenths = spark.range(1000).select(F.lit(0.1).alias("x")).repartition(7)
    assert tenths.agg(A.grouped_sum("x"), A.grouped_mean("x"), A.grouped_median("x")).first()[0:3] == (100.0, 0.1, 0.1)


def test_forecast(spark):
    df = spark.createDataFrame([("a", 100.0), ("z", 0.0)], "k string, b double")
    result = fc.forecast_growth(df, ["k"], "b", {"base": [0.1], "own": [0.0, -0.1, 0.2]}, 3, ["y1", "y2", "y3"], "USD")
    values = {}
    for r in result.schedule.orderBy("scenario", "period").collect():
        values.setdefault(r["scenario"], []).append((r["label"], r["value"]))
    assert values == {"base": [("y1", 110.0), ("y2", 121.0), ("y3", 133.1)], "own": [("y1", 100.0), ("y2", 90.0), ("y3", 108.0)]}
    summary = {r["scenario"]: (r["cagr"], r["total_growth"], r["rate_mode"]) for r in result.summary.collect()}
    assert summary == {"base": (0.1, 0.331, "constant"), "own": (0.025986, 0.08, "period_specific")}
    assert [r["k"] for r in result.rejected.collect()] == ["z"]
    for bad in (dict(scenarios={}), dict(scenarios={"a": [0.1, 0.2]}), dict(scenarios={"a": [-1.0]}), dict(periods=0), dict(labels=["x"]), dict(scenarios={"a": [0.1], "a ": [0.1]})):
        with pytest.raises(ValueError):
            fc.forecast_growth(df, ["k"], "b", **{"scenarios": {"s": [0.1]}, "periods": 3, **bad})


def test_dcf(spark):
    df = spark.createDataFrame([("a", [100.0, 100.0], 0.1), ("r", [1.0], 0.0), ("e", [], 0.1), ("n", [float("nan")], 0.1)], "k string, f array<double>, r double")
    result = fc.discounted_cash_flow(df, ["k"], "f", "r", fc.PerpetuityGrowth(0.0), 100.0, F.lit(90.0))
    (row,) = result.summary.collect()
    assert (row["enterprise_value"], row["equity_value"], row["per_share_value"]) == (1000.0, 900.0, 10.0)
    assert [r["present_value"] for r in result.schedule.orderBy("period").collect()] == [90.909091, 82.644628]
    assert {r["k"]: r["reason"] for r in result.rejected.collect()} == {
        "r": "terminal.growth_rate must be less than discount_rate",
        "e": "cash_flows must be a non-empty array",
        "n": "cash_flows must be finite",
    }
    one = spark.createDataFrame([("a", [100.0], 50.0)], "k string, f array<double>, m double")
    row = fc.discounted_cash_flow(one, ["k"], "f", 0.21, fc.ExitMultiple(10.0), mid_year=True).summary.first()
    assert row["terminal_discount_factor"] == 0.909091 and row["enterprise_value"] == 1000.0 and row["per_share_value"] is None
    row = fc.discounted_cash_flow(one, ["k"], "f", 0.21, fc.ExitMultiple(10.0, "m")).summary.first()
    assert row["terminal_value"] == 500.0 and row["terminal_metric_source"] == "terminal.metric_value"


def series(spark, name, values, benchmark=None, step=400):
    days = [date(2020, 1, 1) + timedelta(days=step * i) for i in range(len(values))]
    other = benchmark or [None] * len(values)
    return spark.createDataFrame([(name, d, float(v), b) for d, v, b in zip(days, values, other)], "id string, d date, v double, b double")


@pytest.mark.parametrize("step", [1, 400])
def test_market_goldens(spark, step):
    row = mk.market_statistics(series(spark, "s", [0.1, -0.05, 0.2], [0.05, -0.02, 0.1], step), ["id"], "d", "v", 3, benchmark="b", kind="returns").first()
    expected = {
        "total_return": 0.254, "annualized_return": 0.254, "annualized_volatility": 0.217945, "sharpe_ratio": 1.147079,
        "sortino_ratio": 5.0, "max_drawdown": -0.05, "best_period_return": 0.2, "worst_period_return": -0.05,
        "positive_period_ratio": 0.666667, "beta": 2.087156, "alpha": -0.02133, "correlation": 0.999819,
    }
    assert {k: row[k] for k in expected} == expected
    prices = mk.market_statistics(series(spark, "p", [100, 110, 104.5, 125.4], step=step), ["id"], "d", "v", 3).first()
    assert prices["total_return"] == 0.254 and prices["max_drawdown"] == -0.05 and prices["input_observations"] == 4
    assert prices["beta_reason"] == mk.NO_BENCHMARK


def test_market_undefined(spark):
    df = series(spark, "flat", [0.1, 0.1, 0.1], [0.2, 0.2, 0.2]).unionByName(series(spark, "one", [0.1], [0.1])).unionByName(series(spark, "lost", [-1.0, 0.5]))
    rows = {r["id"]: r for r in mk.market_statistics(df, ["id"], "d", "v", 12, benchmark="b", kind="returns").collect()}
    assert rows["flat"]["sharpe_ratio"] is None and rows["flat"]["sharpe_ratio_reason"] == mk.FLAT
    assert rows["flat"]["annualized_volatility"] == 0.0 and rows["flat"]["sortino_ratio_reason"] == mk.NO_DOWNSIDE
    assert rows["flat"]["beta_reason"] == mk.FLAT_BENCHMARK and rows["flat"]["alpha_reason"] == mk.FLAT_BENCHMARK_BETA
    assert rows["one"]["annualized_volatility_reason"] == mk.NEED_TWO and rows["one"]["beta_reason"] == mk.NEED_TWO_ALIGNED
    assert rows["lost"]["annualized_return"] == -1.0 and rows["lost"]["max_drawdown"] == -1.0 and rows["lost"]["beta_reason"] == mk.MISALIGNED
    long = mk.statistics_long(mk.market_statistics(df, ["id"], "d", "v", 12, kind="returns"), ["id"])
    assert long.count() == 36
    problems = series(spark, "low", [1, 0]).unionByName(series(spark, "short", [1])).unionByName(series(spark, "twice", [1, 2], step=0))
    assert {r["id"]: r["reason"].split()[-1] for r in mk.series_problems(problems, ["id"], "d", "v").collect()} == {
        "low": "values", "short": "observations", "twice": "increasing",
    }
    for bad in (dict(periods_per_year=0), dict(periods_per_year=1, annual_risk_free_rate=-1.0), dict(periods_per_year=1, kind="x")):
        with pytest.raises(ValueError):
            mk.market_statistics(df, ["id"], "d", "v", **bad)


def test_drawdown_matches_loop_across_blocks(spark):
    import random

    rng = random.Random(5)
    rows, expected = [], {}
    for s in range(6):
        wealth = peak = 1.0
        worst = 0.0
        for i in range(60):
            r = rng.uniform(-0.2, 0.2)
            rows.append((f"s{s}", date(2000, 1, 1) + timedelta(days=100 * i), r))
            wealth *= 1 + r
            peak = max(peak, wealth)
            worst = min(worst, wealth / peak - 1)
        expected[f"s{s}"] = round(worst, 9)
    df = spark.createDataFrame(rows, "id string, d date, r double").repartition(5)
    got = mk.market_statistics(df, ["id"], "d", "r", 12, kind="returns", precision=9)
    assert {r["id"]: r["max_drawdown"] for r in got.collect()} == pytest.approx(expected, abs=2e-9)


SUMS = {
    "cents": [0.1] * 10 + [2.345, -7.25],
    "huge": [1e300, 1.0],
    "cancel": [1e300, 1.0, -1e300],
    "mixed": [1e20, 0.5, -1e20, 12345678.123456789, -3.25],
    "tiny": [1e-20] * 3,
    "places": [1 / 3, 2 / 3, 1e-7, -0.0000005, 0.68 + 1e-16],
    "wide": [123456789012.123, 1e15 + 0.125, 9007199254740993.0, 1e18, -1e18],
    "edges": [1e9, 999999999.999999, -1e8, 1e16, 1e-9, 9.99e-10],
    "alone": [-0.0],
}


def test_sums_of_any_size(spark):
    rows = [(name, float(v)) for name, values in SUMS.items() for v in values] + [("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    grouped = {r["g"]: r for r in frame.groupBy("g").agg(A.grouped_sum("v").alias("s"), A.grouped_mean("v").alias("m")).collect()}
    arrays = spark.createDataFrame([(k, v) for k, v in SUMS.items()], "g string, v array<double>")
    whole = {r["g"]: r["s"] for r in arrays.select("g", A.array_sum("v").alias("s")).collect()}
    for name, values in SUMS.items():
        with localcontext() as context:
            context.prec = 700
            exact = float(sum((Decimal(repr(v)) for v in values), Decimal(0)))
        assert grouped[name]["s"] == pytest.approx(exact, rel=1e-15, abs=0), name
        assert whole[name] == pytest.approx(exact, rel=1e-15, abs=0), name
        assert grouped[name]["m"] == pytest.approx(exact / len(values), rel=1e-15, abs=0), name
    assert grouped["none"]["s"] is None and grouped["none"]["m"] is None
    weights = spark.createDataFrame([(2.0, 1e-20), (4.0, 1e-20)], "v double, w double")
    assert weights.agg(A.grouped_weighted_average("v", "w")).first()[0] == pytest.approx(3.0)
    bad = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert bad.agg(A.grouped_sum("v")).first()[0] is None


def test_sum_does_not_depend_on_order(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.uniform(-1, 1), rng.uniform(-1e12, 1e12), round(rng.uniform(-1e6, 1e6), 2)]) for _ in range(3000)]
    exact = float(sum((Decimal(repr(v)) for v in values), Decimal(0)))
    for seed in range(3):
        random.Random(seed).shuffle(values)
        frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5 + seed)
        assert frame.agg(A.grouped_sum("v")).first()[0] == exact


def test_medians_without_a_group_in_one_task(spark):
    rng = random.Random(6)
    rows = [("hot", rng.choice([round(rng.gauss(0, 50), 1), 7.0])) for _ in range(4000)]
    rows += [("two", 1.0), ("two", 4.0), ("one", -2.5), (None, 3.0), (None, 5.0), (None, 3.0), ("two", None), ("nulls", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = {r["g"]: (r["median"], r["population"]) for r in medians(frame, ["g"], "v").collect()}
    expected = {}
    for name in {r[0] for r in rows} - {"nulls"}:
        values = [v for g, v in rows if g == name and v is not None]
        expected[name] = (statistics.median(values), len(values))
    assert found == expected


def test_array_operations_compute_once(spark):
    """A fold of an array that is named several times is run again each time."""
    frame = spark.createDataFrame([([0.1, 0.2, 1e17, -1e17, 3.5],)], "v array<double>")
    out = frame.select(
        A.array_sum("v").alias("s"), A.array_product("v").alias("p"), A.array_median("v").alias("m"),
        A.array_weighted_average("v", F.array(*[F.lit(1.0)] * 5)).alias("w"),
    )
    assert tuple(out.first()) == (3.8, 0.1 * 0.2 * 1e17 * -1e17 * 3.5, 0.2, 0.76)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 4 and plan.count("array_sort(") <= 1
