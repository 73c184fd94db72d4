"""Arithmetic, metric, forecast, market and ranking queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyscope.functions import arithmetic as A
from tallyscope.functions.numeric import round_half_even
from tallyscope.operators import forecast as fc
from tallyscope.operators import market as mk
from tallyscope.operators import ranking as rk
from tallyscope.operators import screen as sc
from tallyscope.operators.metrics import METRICS, add_metrics, metrics_long
from tallyscope.operators.ordering import medians
from tallyscope.plans import tables as t
from tallyscope.plans.tables import half_even_sql as R
from tallyscope.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# --- arithmetic ---------------------------------------------------------------------------------


@query(
    "arith_grouped",
    f"""
    select l_returnflag, l_linestatus,
      {R("cast(sum(cast(l_extendedprice as decimal(18,2))) as double)")} as sum_price,
      {R("cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*)")} as mean_price,
      {R("quantile_cont(l_quantity, 0.5)")} as median_quantity,
      {R("cast(sum(cast(cast(l_discount * l_quantity as varchar) as decimal(38,18))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double)")} as weighted_discount
    from lineitem group by 1, 2""",
)
def arith_grouped(spark: SparkSession, folder: str) -> DataFrame:
    lines = t.table(spark, folder, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        round_half_even(A.grouped_sum("l_extendedprice")).alias("sum_price"),
        round_half_even(A.grouped_mean("l_extendedprice")).alias("mean_price"),
        round_half_even(A.grouped_median("l_quantity")).alias("median_quantity"),
        round_half_even(A.grouped_weighted_average("l_discount", "l_quantity")).alias("weighted_discount"),
    )


@query(
    "grouped_medians",
    """select l_returnflag, quantile_cont(l_extendedprice, 0.5) as median_price, count(l_extendedprice) as prices
    from lineitem group by 1""",
)
def grouped_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Exact medians of a few very large groups of mostly distinct values."""
    found = medians(t.table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", "median_price")
    return found.select("l_returnflag", "median_price", F.col("population").alias("prices"))


@query(
    "arith_product",
    f"select l_orderkey, {R('product(1 + l_tax)')} as tax_factor from lineitem group by l_orderkey",
)
def arith_product(spark: SparkSession, folder: str) -> DataFrame:
    lines = t.table(spark, folder, "lineitem")
    return lines.groupBy("l_orderkey").agg(
        round_half_even(A.grouped_product(F.col("l_tax") + 1.0)).alias("tax_factor")
    )


@query(
    "arith_arrays",
    f"""
    with v as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings),
    w as (select *, list_transform(x, lambda a: abs(a)) as aw from v)
    select vec_id,
      {R("list_sum(x)")} as total, {R("list_product(list_transform(x, lambda a: 1 + a))")} as growth,
      {R("list_sum(x) / len(x)")} as mean, {R("list_aggregate(x, 'quantile_cont', 0.5)")} as median,
      {R("list_sum(list_transform(x, lambda a: a * abs(a))) / list_sum(aw)")} as weighted
    from w""",
)
def arith_arrays(spark: SparkSession, folder: str) -> DataFrame:
    vectors = t.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return vectors.select(
        "vec_id",
        round_half_even(A.array_sum("x")).alias("total"),
        round_half_even(A.array_product(F.transform("x", lambda v: v + 1.0))).alias("growth"),
        round_half_even(A.array_mean("x")).alias("mean"),
        round_half_even(A.array_median("x")).alias("median"),
        round_half_even(A.array_weighted_average("x", F.transform("x", F.abs))).alias("weighted"),
    )


@query(
    "arith_pairs",
    f"""
    with {t.ISSUER_SQL},
    ops as (
      select entity, 'change' as id, revenue - prior_revenue as v,
        case when prior_revenue is null then 'missing input' end as reason from issuers
      union all select entity, 'share', revenue / prior_revenue,
        case when prior_revenue is null then 'missing input' end from issuers
      union all select entity, 'growth', (revenue - prior_revenue) / prior_revenue,
        case when prior_revenue is null then 'missing input' end from issuers
      union all select entity, 'points', (net_income / revenue - prior_net_income / prior_revenue) * 10000.0::double,
        case when prior_revenue is null then 'missing input' end from issuers
      union all select entity, 'yearly',
        case when net_income > 0 and prior_net_income > 0
          then pow(net_income / prior_net_income, 1.0::double / (fy - prior_fy)) - 1.0::double end,
        case when prior_net_income is null then 'missing input'
          when net_income <= 0 or prior_net_income <= 0 then 'CAGR requires positive start and end values' end
        from issuers)
    select entity, id, {R("v")} as value, reason from ops""",
)
def arith_pairs(spark: SparkSession, folder: str) -> DataFrame:
    facts = t.issuer_facts(spark, folder)
    margin = F.col("net_income") / F.col("revenue")
    prior_margin = F.col("prior_net_income") / F.col("prior_revenue")
    pair = {"current": "revenue", "prior": "prior_revenue"}
    operations = [
        A.Operation("change", "difference", pair),
        A.Operation("share", "ratio", {"numerator": "revenue", "denominator": "prior_revenue"}),
        A.Operation("growth", "percent_change", pair),
        A.Operation("points", "basis_point_change", {"current": margin, "prior": prior_margin}),
        A.Operation(
            "yearly",
            "cagr",
            {"start": "prior_net_income", "end": "net_income", "periods": F.col("fy") - F.col("prior_fy")},
        ),
    ]
    return A.calculate(facts, ["entity"], operations).select("entity", "id", "value", "reason")


@query("round_half_even", f"select p_partkey, {R('p_retailprice / 7', 2)} as rounded from part")
def rounding(spark: SparkSession, folder: str) -> DataFrame:
    parts = t.table(spark, folder, "part")
    return parts.select("p_partkey", round_half_even(F.col("p_retailprice") / 7.0, 2).alias("rounded"))


# --- metrics ------------------------------------------------------------------------------------

_WIDE = ("gross_profit", "revenue_growth", "gross_profit_growth", "gross_margin", "net_margin", "price_to_sales", "earnings_yield")


@query(
    "metrics_wide",
    f"""
    with {t.ISSUER_SQL}
    select entity,
      {R("revenue - cost_of_revenue")} as gross_profit,
      {R("(revenue - prior_revenue) / prior_revenue")} as revenue_growth,
      {R("((revenue - cost_of_revenue) - (prior_revenue - prior_cost_of_revenue)) / nullif(prior_revenue - prior_cost_of_revenue, 0)")} as gross_profit_growth,
      {R("(revenue - cost_of_revenue) / revenue")} as gross_margin,
      {R("net_income / revenue")} as net_margin,
      {R("market_cap / revenue")} as price_to_sales,
      {R("net_income / market_cap")} as earnings_yield
    from issuers""",
)
def metrics_wide(spark: SparkSession, folder: str) -> DataFrame:
    return add_metrics(t.issuer_facts(spark, folder), _WIDE).select("entity", *_WIDE)


def _metric_oracle() -> str:
    """One SELECT per metric from SQL written for this statement view: value and reason."""
    miss = "missing required input(s): "
    components = {
        # name: (value, reason when null)
        "gross_profit": ("revenue - cost_of_revenue", f"'{miss}gross_profit or (revenue and cost_of_revenue)'"),
        "prior_gross_profit": (
            "prior_revenue - prior_cost_of_revenue",
            f"'{miss}prior_gross_profit or (prior_revenue and prior_cost_of_revenue)'",
        ),
        "free_cash_flow": ("operating_cash_flow - capital_expenditures", "'never'"),
        "net_debt": ("total_debt - cash_and_equivalents", "'never'"),
        "earnings_per_share": (
            "net_income / diluted_shares_outstanding",
            f"'{miss}earnings_per_share or (net_income and diluted_shares_outstanding)'",
        ),
        "prior_earnings_per_share": (
            "null::double",
            f"'{miss}prior_earnings_per_share or (prior_net_income and prior_diluted_shares_outstanding)'",
        ),
        "market_cap": (
            "market_cap",
            f"'{miss}market_cap or (share_price and diluted_shares_outstanding)'",
        ),
        "ebit": ("operating_income", f"'{miss}operating_income'"),
        "ebitda": (
            "operating_income + depreciation_and_amortization",
            f"'{miss}ebitda or (ebit and depreciation_and_amortization)'",
        ),
        "quick_assets": (
            "coalesce(current_assets - inventory - 0.0::double, cash_and_equivalents + 0.0::double + accounts_receivable)",
            "'never'",
        ),
        "average_total_assets": ("total_assets", "'never'"),
        "average_shareholders_equity": ("shareholders_equity", "'never'"),
        "average_accounts_receivable": ("accounts_receivable", "'never'"),
        "average_inventory": ("inventory", f"'{miss}inventory'"),
        "average_accounts_payable": ("accounts_payable", "'never'"),
        "net_operating_profit_after_tax": (
            "operating_income * (1.0::double - income_tax_expense / nullif(income_before_tax, 0))",
            f"'{miss}net_operating_profit_after_tax or (ebit and effective_tax_rate)'",
        ),
        "average_invested_capital": ("total_debt + shareholders_equity - cash_and_equivalents", "'never'"),
        "dividends_paid": (
            "dividends_per_share * diluted_shares_outstanding",
            f"'{miss}dividends_paid or (dividends_per_share and diluted_shares_outstanding)'",
        ),
        "enterprise_value": (
            "market_cap + total_debt + 0.0::double + 0.0::double - cash_and_equivalents",
            f"'{miss}market_cap or (share_price and diluted_shares_outstanding)'",
        ),
    }
    plain = (
        "revenue prior_revenue cost_of_revenue operating_income prior_operating_income net_income prior_net_income "
        "operating_cash_flow capital_expenditures current_assets current_liabilities total_debt "
        "cash_and_equivalents shareholders_equity diluted_shares_outstanding interest_expense"
    ).split()
    prepared = ",\n".join(
        [f"{name} as v_{name}, '{miss}{name}' as w_{name}" for name in plain]
        + [f"{value} as v_{name}, {why} as w_{name}" for name, (value, why) in components.items()]
    )

    def missing(*names: str) -> str:
        listed = ", ".join(f"case when v_{n} is null then w_{n} end" for n in names)
        return f"nullif(concat_ws('; ', {listed}), '')"

    def over(top: str, bottom: str, label: str, *names: str) -> tuple[str, str]:
        return (
            f"({top}) / nullif({bottom}, 0)",
            f"coalesce({missing(*names)}, case when {bottom} = 0 then 'zero denominator: {label}' end)",
        )

    done: dict[str, tuple[str, str]] = {}
    for spec in METRICS:
        p = spec.parts
        if spec.rule == "difference":
            done[spec.name] = (f"v_{p[0]} - v_{p[1]}", missing(*p))
        elif spec.rule == "value":
            done[spec.name] = ("v_enterprise_value", missing("market_cap"))
        elif spec.rule in ("ratio", "fact_ratio"):
            done[spec.name] = over(f"v_{p[0]}", f"v_{p[1]}", p[1], *p)
        elif spec.rule == "growth":
            done[spec.name] = over(f"v_{p[0]} - v_{p[1]}", f"v_{p[1]}", p[1], *p)
        elif spec.rule == "slope":
            run = f"(v_{p[2]} - v_{p[3]})"
            done[spec.name] = over(f"v_{p[0]} - v_{p[1]}", run, f"{p[2]} - {p[3]}", *p)
        elif spec.rule == "days":
            value, why = over(f"v_{p[0]}", f"v_{p[1]}", p[1], p[0], p[1])
            done[spec.name] = (f"{value} * 365.0::double", why)
        elif spec.rule == "cycle":
            parts = [done[n] for n in p]
            value = f"({parts[0][0]}) + ({parts[1][0]}) - ({parts[2][0]})"
            whys = ", ".join(f"'{n}: ' || ({done[n][1]})" for n in p)
            done[spec.name] = (value, f"nullif(concat_ws('; ', {whys}), '')")
        else:
            parts = [done[n] for n in p]
            whys = ", ".join(f"({w})" for _, w in parts)
            done[spec.name] = (f"({parts[0][0]}) + ({parts[1][0]})", f"nullif(concat_ws('; ', {whys}), '')")
    selects = "\nunion all ".join(
        f"select entity, '{s.name}' as metric, {R(done[s.name][0])} as value, '{s.category}' as category, "
        f"'{s.unit}' as unit, '{s.formula}' as formula, {done[s.name][1]} as reason from prepared"
        for s in METRICS
    )
    return f"with {t.STATEMENT_SQL}, prepared as (select entity, {prepared} from statements) {selects}"


@query("metrics_full_long", _metric_oracle())
def metrics_full_long(spark: SparkSession, folder: str) -> DataFrame:
    long = metrics_long(t.statement_facts(spark, folder), ["entity"])
    return long.select("entity", "metric", "value", "category", "unit", "formula", "reason")


# --- forecast and valuation ---------------------------------------------------------------------

_SCENARIOS = {"base": [0.05], "bull": [0.10], "bear": [-0.02, -0.02, 0.0, 0.01, 0.03]}
_RATES_SQL = """
rates as (select * from (values ('base','constant',[0.05,0.05,0.05,0.05,0.05]::double[]),
  ('bull','constant',[0.10,0.10,0.10,0.10,0.10]::double[]),
  ('bear','period_specific',[-0.02,-0.02,0.0,0.01,0.03]::double[])) as r(scenario, rate_mode, g)),
paths as (
  select s_suppkey, s_acctbal as base, scenario, rate_mode, g, unnest(range(1, 6)) as period
  from supplier cross join rates where s_acctbal > 0),
grown as (select *, list_reduce(list_prepend(base, list_transform(g[1:period], lambda x: 1 + x)), lambda a, b: a * b) as value from paths)"""


@query(
    "forecast_growth",
    f"""with {_RATES_SQL}
    select s_suppkey, scenario, cast(period as integer) as period, 'Period ' || period as label,
      {R("g[period]")} as growth_rate, {R("value")} as value from grown""",
)
def forecast_schedule(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = t.table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    return fc.forecast_growth(suppliers, ["s_suppkey"], "s_acctbal", _SCENARIOS, 5).schedule


@query(
    "forecast_summary",
    f"""with {_RATES_SQL}
    select s_suppkey, scenario, rate_mode, {R("value")} as ending_value,
      {R("value / base - 1")} as total_growth, {R("pow(value / base, 0.2::double) - 1")} as cagr
    from grown where period = 5""",
)
def forecast_summary(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = t.table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    summary = fc.forecast_growth(suppliers, ["s_suppkey"], "s_acctbal", _SCENARIOS, 5).summary
    return summary.select("s_suppkey", "scenario", "rate_mode", "ending_value", "total_growth", "cagr")


def _cash_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly net income as an array per customer: one element per calendar year."""
    yearly = t.yearly_facts(spark, folder).select("entity", "fy", "net_income")
    ordered = F.array_sort(F.collect_list(F.struct("fy", "net_income")))
    return yearly.groupBy("entity").agg(F.transform(ordered, lambda x: x["net_income"]).alias("flows"))


_FLOWS_SQL = (
    t.YEARLY_SQL
    + """,
flows as (select entity, list(net_income order by fy) as f from yearly group by entity)"""
)


@query(
    "dcf_perpetuity",
    f"""with {_FLOWS_SQL},
    v as (
      select entity, f, len(f) as n, list_sum(list_transform(f, lambda x, i: x / pow(1.1::double, i))) as pv,
        f[len(f)] * 1.02::double / (0.1::double - 0.02::double) as tv from flows),
    w as (select *, tv * (1 / pow(1.1::double, n)) as pvt from v)
    select entity, {R("pv", 3)} as pv_forecast_cash_flows, {R("tv", 3)} as terminal_value,
      {R("pvt", 3)} as pv_terminal_value, {R("pv + pvt", 3)} as enterprise_value,
      {R("pv + pvt - 1000", 3)} as equity_value,
      {R("(pv + pvt - 1000) / (entity + 1000)", 3)} as per_share_value from w""",
)
def dcf_perpetuity(spark: SparkSession, folder: str) -> DataFrame:
    flows = _cash_flows(spark, folder).withColumn("shares", (F.col("entity") + 1000).cast("double"))
    result = fc.discounted_cash_flow(
        flows, ["entity"], "flows", 0.1, fc.PerpetuityGrowth(0.02), 1000.0, "shares", precision=3
    )
    return result.summary.select(
        "entity",
        "pv_forecast_cash_flows",
        "terminal_value",
        "pv_terminal_value",
        "enterprise_value",
        "equity_value",
        "per_share_value",
    )


@query(
    "dcf_exit_mid_year",
    f"""with {_FLOWS_SQL},
    v as (
      select entity, f, len(f) as n,
        list_sum(list_transform(f, lambda x, i: x / (pow(1.21::double, i) / sqrt(1.21::double)))) as pv,
        f[len(f)] * 10.0::double as tv from flows),
    w as (select *, tv * (1 / (pow(1.21::double, n) / sqrt(1.21::double))) as pvt from v)
    select entity, cast(n - 0.5 as double) as terminal_discount_period, {R("tv", 3)} as terminal_value,
      {R("pv + pvt", 3)} as enterprise_value, cast(null as double) as per_share_value from w""",
)
def dcf_exit_mid_year(spark: SparkSession, folder: str) -> DataFrame:
    result = fc.discounted_cash_flow(
        _cash_flows(spark, folder), ["entity"], "flows", 0.21, fc.ExitMultiple(10.0), mid_year=True, precision=3
    )
    return result.summary.select(
        "entity",
        F.col("terminal_discount_period").cast("double").alias("terminal_discount_period"),
        "terminal_value",
        "enterprise_value",
        "per_share_value",
    )


@query(
    "dcf_schedule",
    f"""with {_FLOWS_SQL},
    e as (select entity, f, unnest(range(1, len(f) + 1)) as t from flows)
    select entity, cast(t as integer) as period, {R("f[t]", 3)} as cash_flow, {R("1 / pow(1.1::double, t)", 3)} as discount_factor,
      {R("f[t] * (1 / pow(1.1::double, t))", 3)} as present_value from e""",
)
def dcf_schedule(spark: SparkSession, folder: str) -> DataFrame:
    result = fc.discounted_cash_flow(
        _cash_flows(spark, folder), ["entity"], "flows", 0.1, fc.PerpetuityGrowth(0.02), precision=3
    )
    return result.schedule.select("entity", "period", "cash_flow", "discount_factor", "present_value")


# --- market statistics --------------------------------------------------------------------------

_RETURNS_SQL = (
    t.PRICES_SQL
    + """,
lagged as (
  select *, lag(price) over w as p0, lag(benchmark) over w as b0 from prices
  window w as (partition by user_id order by day)),
returns as (
  select user_id, day, price / p0 - 1.0::double as r, benchmark / b0 - 1.0::double as b
  from lagged where p0 is not null)"""
)


@query(
    "returns",
    f"with {_RETURNS_SQL} select user_id, day, {R('r')} as \"return\" from returns",
)
def returns(spark: SparkSession, folder: str) -> DataFrame:
    moves = mk.simple_returns(t.daily_prices(spark, folder), ["user_id"], "day", "price")
    return moves.select("user_id", "day", round_half_even("return").alias("return"))


_STATS_SQL = (
    _RETURNS_SQL
    + """,
s as (
  select user_id, count(*) as n, exp(sum(ln(1 + r))) - 1 as total, avg(r) as mean, stddev_samp(r) as sd,
    min(r) as lo, max(r) as hi, avg(case when r > 0 then 1.0::double else 0.0::double end) as pos,
    sqrt(avg(pow(least(r - 0.02::double / 252, 0), 2))) as down,
    covar_samp(r, b) as cov, var_samp(b) as bvar, avg(b) as bmean, min(b) as blo, max(b) as bhi
  from returns group by user_id)"""
)


@query(
    "market_stats",
    f"""with {_STATS_SQL}
    select user_id, n as return_observations, {R("total", 3)} as total_return,
      {R("sd * sqrt(252)", 3)} as annualized_volatility,
      {R("case when n >= 2 and lo <> hi then (mean - 0.02::double / 252) / sd * sqrt(252) end", 3)} as sharpe_ratio,
      {R("(mean - 0.02::double / 252) * 252 / nullif(down * sqrt(252), 0)", 3)} as sortino_ratio,
      {R("hi", 3)} as best_period_return, {R("lo", 3)} as worst_period_return, {R("pos", 3)} as positive_period_ratio,
      case when n < 2 then 'requires at least 2 return observations' when lo = hi then 'sample volatility is zero' end
        as sharpe_ratio_reason
    from s""",
)
def market_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = mk.market_statistics(
        t.daily_prices(spark, folder), ["user_id"], "day", "price", 252, 0.02, precision=3
    )
    return stats.select(
        "user_id",
        "return_observations",
        "total_return",
        "annualized_volatility",
        "sharpe_ratio",
        "sortino_ratio",
        "best_period_return",
        "worst_period_return",
        "positive_period_ratio",
        "sharpe_ratio_reason",
    )


@query(
    "beta_alpha_corr",
    f"""with {_STATS_SQL}
    select user_id,
      {R("case when n >= 2 and blo <> bhi then cov / bvar end", 4)} as beta,
      {R("case when n >= 2 and blo <> bhi then (mean - 0.02::double / 252 - cov / bvar * (bmean - 0.02::double / 252)) * 252 end", 4)} as alpha,
      {R("case when n >= 2 and blo <> bhi and lo <> hi then cov / (sd * sqrt(bvar)) end", 4)} as correlation,
      case when n < 2 then 'requires at least 2 aligned return observations'
        when blo = bhi then 'benchmark sample variance is zero' end as beta_reason
    from s""",
)
def beta_alpha_corr(spark: SparkSession, folder: str) -> DataFrame:
    stats = mk.market_statistics(
        t.daily_prices(spark, folder), ["user_id"], "day", "price", 252, 0.02, benchmark="benchmark", precision=4
    )
    return stats.select("user_id", "beta", "alpha", "correlation", "beta_reason")


@query(
    "drawdown",
    f"""with {_RETURNS_SQL},
    walk as (
      select user_id, day, exp(sum(ln(1 + r)) over (partition by user_id order by day)) as wealth from returns),
    peaks as (select *, greatest(1.0::double, max(wealth) over (partition by user_id order by day)) as peak from walk)
    select user_id, {R("least(0, min(wealth / peak - 1))")} as max_drawdown from peaks group by user_id""",
)
def drawdown(spark: SparkSession, folder: str) -> DataFrame:
    moves = mk.simple_returns(t.daily_prices(spark, folder), ["user_id"], "day", "price")
    return mk.drawdowns(moves, ["user_id"], "day").select(
        "user_id", round_half_even("max_drawdown").alias("max_drawdown")
    )


@query(
    "series_check",
    """
    with raw as (select user_id, cast(ts as date) as day, value - 5.0::double as price from events),
    d as (select user_id, count(*) as twice from (
      select user_id, day from raw group by 1, 2 having count(*) > 1) group by user_id),
    c as (select user_id, count(*) as observations, count(*) filter (where price <= 0) as low from raw group by 1)
    select c.user_id, observations,
      case when observations < 2 then 'prices must contain at least 2 observations'
        when low > 0 then 'prices must contain only positive values'
        else 'prices periods must be strictly increasing' end as reason
    from c left join d using (user_id)
    where observations < 2 or low > 0 or twice is not null""",
)
def series_check(spark: SparkSession, folder: str) -> DataFrame:
    raw = t.table(spark, folder, "events").select(
        "user_id", F.to_date("ts").alias("day"), (F.col("value") - 5.0).alias("price")
    )
    return mk.series_problems(raw, ["user_id"], "day", "price")


@query(
    "benchmark_alignment",
    f"""with {t.PRICES_SQL},
    total as (select count(distinct day) as n from prices)
    select user_id, count(*) as observations, count(*) = any_value(total.n) as aligned
    from prices cross join total group by user_id""",
)
def benchmark_alignment(spark: SparkSession, folder: str) -> DataFrame:
    prices = t.daily_prices(spark, folder)
    benchmark = prices.groupBy("day").agg(F.max("benchmark").alias("level"))
    aligned = mk.align_benchmark(prices.select("user_id", "day", "price"), ["user_id"], "day", benchmark)
    return aligned.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("observations"), F.bool_and("aligned").alias("aligned")
    )


# --- ranking ------------------------------------------------------------------------------------

_CRITERIA = (
    rk.Criterion("net_margin", "higher", 2.0),
    rk.Criterion("revenue_growth", "higher", 1.0),
    rk.Criterion("price_to_sales", "lower", 1.0),
)


def _rank_input(spark: SparkSession, folder: str) -> DataFrame:
    """Margins rounded to two places so that ties are common."""
    measured = add_metrics(t.issuer_facts(spark, folder), ["net_margin", "revenue_growth", "price_to_sales"], 2)
    return measured.select("entity", "nation", "net_margin", "revenue_growth", "price_to_sales")


def _rank_sql(policy: str, group: str | None = None) -> str:
    by = f"{group}, " if group else ""
    metrics = (("net_margin", "desc", "0.5"), ("revenue_growth", "desc", "0.25"), ("price_to_sales", "asc", "0.25"))
    source = "m"
    where = ""
    if policy == "exclude":
        where = "where net_margin is not null and revenue_growth is not null and price_to_sales is not null"
    fill = {"worst": "0.0", "neutral": "50.0", "exclude": "0.0"}[policy]
    ranks, scores, total = [], [], []
    for name, direction, weight in metrics:
        part = f"partition by {by}{name} is null"
        ranks.append(
            f"case when {name} is not null then rank() over ({part} order by {name} {direction}) "
            f"+ (count(*) over (partition by {by}{name}) - 1) / 2.0::double end as r_{name}, "
            f"count(*) over ({part}) as n_{name}"
        )
        score = (
            f"case when {name} is null then {fill}::double when n_{name} = 1 then 100.0::double "
            f"else 100.0::double * (n_{name} - r_{name}) / (n_{name} - 1) end"
        )
        scores.append(f"{R('r_' + name)} as {name}_rank, {R(score)} as {name}_score")
        total.append(f"({score}) * {weight}::double")
    columns = "entity, " + by
    return f"""with {t.ISSUER_SQL},
    m as (select entity, nation, {R("net_income / revenue", 2)} as net_margin,
      {R("(revenue - prior_revenue) / prior_revenue", 2)} as revenue_growth,
      {R("market_cap / revenue", 2)} as price_to_sales from issuers),
    r as (select *, {", ".join(ranks)} from {source} {where})
    select {columns} {", ".join(scores)}, {R(" + ".join(total))} as composite_score from r"""


_RANK_COLUMNS = [f"{c.metric}_{part}" for c in _CRITERIA for part in ("rank", "score")] + ["composite_score"]


def _ranked(spark: SparkSession, folder: str, policy: str) -> DataFrame:
    return rk.rank_entities(_rank_input(spark, folder), "entity", _CRITERIA, policy).ranked


@query("rank_weighted", _rank_sql("worst"))
def rank_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder, "worst").select("entity", *_RANK_COLUMNS)


@query("rank_exclude", _rank_sql("exclude"))
def rank_exclude(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder, "exclude").select("entity", *_RANK_COLUMNS)


@query("rank_neutral", _rank_sql("neutral"))
def rank_neutral(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder, "neutral").select("entity", *_RANK_COLUMNS)


@query(
    "rank_excluded_rows",
    f"""with {t.ISSUER_SQL}
    select entity, 'missing one or more ranking metrics' as reason,
      concat_ws(',', case when prior_revenue is null then 'revenue_growth' end,
        case when market_cap is null then 'price_to_sales' end) as missing
    from issuers where prior_revenue is null or market_cap is null""",
)
def rank_excluded_rows(spark: SparkSession, folder: str) -> DataFrame:
    excluded = rk.rank_entities(_rank_input(spark, folder), "entity", _CRITERIA, "exclude").excluded
    return excluded.select("entity", "reason", F.concat_ws(",", "missing_metrics").alias("missing"))


@query(
    "rank_top_n",
    f"select entity, composite_score from ({_rank_sql('worst')}) order by composite_score desc, entity limit 25",
)
def rank_top_n(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rk.rank_entities(_rank_input(spark, folder), "entity", _CRITERIA, "worst", top_n=25).ranked
    return ranked.select("entity", "composite_score")


@query("rank_by_group", _rank_sql("worst", "nation"))
def rank_by_group(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rk.rank_entities(_rank_input(spark, folder), "entity", _CRITERIA, "worst", by=["nation"]).ranked
    return ranked.select("entity", "nation", *_RANK_COLUMNS)


@query(
    "rank_counts",
    f"""with {t.ISSUER_SQL}
    select count(*) as input_count,
      count(*) filter (where prior_revenue is not null and market_cap is not null) as eligible_count,
      count(*) filter (where prior_revenue is not null and market_cap is not null) as returned_count
    from issuers""",
)
def rank_counts(spark: SparkSession, folder: str) -> DataFrame:
    source = _rank_input(spark, folder)
    return rk.rank_counts(source, rk.rank_entities(source, "entity", _CRITERIA, "exclude"))


# --- the screen ---------------------------------------------------------------------------------


def _screened(spark: SparkSession, folder: str) -> DataFrame:
    facts = t.issuer_facts(spark, folder).select(
        F.col("entity").alias("entity_id"),
        "revenue",
        "prior_revenue",
        "net_income",
        (F.col("revenue") * 0.25).alias("operating_cash_flow"),
        F.col("income_tax_expense").alias("capital_expenditures"),
        "market_cap",
    )
    return sc.screen_metrics(facts).select("entity_id", *sc.SCREEN_METRICS, "market_cap")


def screen_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Facts to metrics to weighted rank to candidate fields, for every issuer."""
    screened = settle(_screened(spark, folder))
    scores = settle(sc.screen_rank(screened, settled=True).ranked.select("entity_id", "composite_score"))
    numbered = sc.with_screen_rank(scores)
    total = scores.agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = screened.join(numbered, "entity_id").withColumn("screened_count", total)
    fields = sc.candidate_columns(
        F.col("market_cap").isNotNull(), F.col("screen_rank"), F.col("screened_count")
    )
    return joined.select(
        "entity_id",
        *sc.SCREEN_METRICS,
        "composite_score",
        "screen_rank",
        *[column.alias(name) for name, column in fields.items() if name != "evidence_gaps"],
        F.concat_ws("; ", fields["evidence_gaps"]).alias("evidence_gaps"),
    )


def _screen_sql() -> str:
    weights = (
        ("revenue_growth", "desc", "0.35"),
        ("net_margin", "desc", "0.25"),
        ("free_cash_flow_margin", "desc", "0.15"),
        ("price_to_sales", "asc", "0.25"),
    )
    ranks, total = [], []
    for name, direction, weight in weights:
        ranks.append(
            f"rank() over (partition by {name} is null order by {name} {direction}) "
            f"+ (count(*) over (partition by {name}) - 1) / 2.0::double as r_{name}, "
            f"count(*) over (partition by {name} is null) as n_{name}"
        )
        total.append(
            f"(case when {name} is null then 0.0::double when n_{name} = 1 then 100.0::double "
            f"else 100.0::double * (n_{name} - r_{name}) / (n_{name} - 1) end) * {weight}::double"
        )
    text = lambda v, p, mul, suf: (
        f"case when {v} is null then 'unavailable' else printf('%.1f', {v} * {mul}) || '{suf}' end"
    )
    gap = lambda m, d: f"case when {m} is null then 'Missing {d}; {m.replace('_', ' ')} unavailable' end"
    gaps = ", ".join(
        gap(m, d)
        for m, d in (
            ("revenue_growth", "prior comparable revenue"),
            ("net_margin", "same-period net income"),
            ("free_cash_flow_margin", "same-period cash flow and capital expenditure"),
            ("price_to_sales", "current market capitalization"),
        )
    )
    metrics = "revenue_growth, net_margin, free_cash_flow, free_cash_flow_margin, price_to_sales"
    available = " + ".join(f"cast({m} is not null as integer)" for m in metrics.split(", "))
    return f"""with {t.ISSUER_SQL},
    f as (select entity as entity_id, market_cap,
      {R("(revenue - prior_revenue) / prior_revenue")} as revenue_growth,
      {R("net_income / revenue")} as net_margin,
      {R("revenue * 0.25::double - income_tax_expense")} as free_cash_flow,
      {R("(revenue * 0.25::double - income_tax_expense) / revenue")} as free_cash_flow_margin,
      {R("market_cap / revenue")} as price_to_sales from issuers),
    r as (select *, {", ".join(ranks)} from f),
    c as (select *, {R(" + ".join(total))} as composite_score from r),
    n as (select *, row_number() over (order by composite_score desc, entity_id) as screen_rank,
      count(*) over () as total, {available} as available, concat_ws('; ', {gaps}) as evidence_gaps from c)
    select entity_id, {metrics}, composite_score, screen_rank, evidence_gaps,
      case when market_cap is null then 'exposure_unproven' when screen_rank = 1 then 'advance'
        when screen_rank <= greatest(2, ceil(total / 2.0)) then 'valuation_gated' else 'deprioritized' end as bucket,
      cast({R("composite_score", 0)} as integer) as priority_score,
      'Rule screen rank ' || screen_rank || '/' || total || ': revenue growth ' || {text("revenue_growth", 1, "100.0::double", "%")}
        || ', net margin ' || {text("net_margin", 1, "100.0::double", "%")} || ', price/sales '
        || {text("price_to_sales", 1, "1.0::double", "x")} || '.' as variant_wedge,
      case when market_cap is not null and available >= 4 then 'high' when available >= 2 then 'medium' else 'low' end
        as confidence,
      case when evidence_gaps = '' then 'complete' when available >= 2 then 'partial' else 'limited' end as data_quality
    from n"""


query("screen_candidates", _screen_sql())(screen_candidates)
