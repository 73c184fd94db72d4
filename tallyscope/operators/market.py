"""Return, risk and benchmark statistics per price or return series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyscope.functions.numeric import check_precision, finite_or_null, is_finite, round_half_even
from tallyscope.operators.series import block_of, with_previous

# Statistic name and formula text; every unit is a ratio.
STATISTICS: dict[str, str] = {
    "total_return": "product(1 + period_return) - 1",
    "annualized_return": "(1 + total_return) ** (periods_per_year / observations) - 1",
    "annualized_volatility": "sample_standard_deviation(returns) * sqrt(periods_per_year)",
    "sharpe_ratio": "(mean(returns) - annual_risk_free_rate / periods_per_year) / sample_volatility"
    " * sqrt(periods_per_year)",
    "sortino_ratio": "annualized_mean_excess_return / "
    "(sqrt(mean(min(return - periodic_risk_free_rate, 0) ** 2)) * sqrt(periods_per_year))",
    "max_drawdown": "min(cumulative_wealth / running_peak - 1)",
    "best_period_return": "max(returns)",
    "worst_period_return": "min(returns)",
    "positive_period_ratio": "count(returns > 0) / observations",
    "beta": "sample_covariance(returns, benchmark_returns) / sample_variance(benchmark_returns)",
    "alpha": "(mean(returns) - periodic_risk_free_rate - beta * "
    "(mean(benchmark_returns) - periodic_risk_free_rate)) * periods_per_year",
    "correlation": "sample_covariance(returns, benchmark_returns) / "
    "(sample_std(returns) * sample_std(benchmark_returns))",
}
# Reasons for a null statistic.
NEED_TWO = "requires at least 2 return observations"
FLAT = "sample volatility is zero"
NO_DOWNSIDE = "no returns below the periodic risk-free rate"
NO_BENCHMARK = "benchmark_returns was not provided"
NEED_TWO_ALIGNED = "requires at least 2 aligned return observations"
FLAT_BENCHMARK = "benchmark sample variance is zero"
FLAT_BENCHMARK_BETA = "beta is unavailable because benchmark sample variance is zero"
FLAT_RETURNS = "return sample variance is zero"
MISALIGNED = "benchmark_returns must have the same number of observations as returns"


def simple_returns(
    prices: DataFrame, by: Sequence[str], order: str, price: str, benchmark: str | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Adjacent simple returns: by, order, ``return`` and, when asked, ``benchmark_return``.

    Rows without a price (or benchmark price) are skipped: the next return is from the last known price.
    """
    columns = [price] if benchmark is None else [price, benchmark]
    for column in columns:
        prices = prices.where(F.col(column).isNotNull())
    paired = with_previous(prices, by, [order], columns, block).where(F.col(f"previous_{price}").isNotNull())
    change = F.try_divide(F.col(price), F.col(f"previous_{price}")) - 1.0
    result = [*by, order, "_block", change.alias("return")]
    if benchmark is not None:
        move = F.try_divide(F.col(benchmark), F.col(f"previous_{benchmark}")) - 1.0
        result.append(move.alias("benchmark_return"))
    return paired.select(*result)


def drawdowns(returns: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Largest fall from the running wealth peak per series, at most zero.

    Each block is reduced to its growth, its highest and lowest wealth and its inner drawdown,
    relative to the wealth at its start. Blocks then combine: a fall across blocks runs from the
    highest peak so far to the lowest point of a later block.
    """
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    walked = returns.withColumn("_wealth", F.product(F.col("return") + 1.0).over(inside)).withColumn(
        "_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(inside))
    )
    blocks = walked.groupBy(*by, "_block").agg(
        F.max_by("_wealth", order).alias("_growth"),
        F.max("_peak").alias("_high"),
        F.min("_wealth").alias("_low"),
        F.min(F.col("_wealth") / F.col("_peak") - 1.0).alias("_inner"),
    )
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    started = blocks.withColumn("_start", F.coalesce(F.product("_growth").over(before), F.lit(1.0)))
    peaked = started.withColumn(
        "_peak_before", F.greatest(F.lit(1.0), F.coalesce(F.max(F.col("_start") * F.col("_high")).over(before), F.lit(1.0)))
    )
    across = F.col("_start") * F.col("_low") / F.col("_peak_before") - 1.0
    return peaked.groupBy(*by).agg(
        F.least(F.lit(0.0), F.min(F.least("_inner", across))).alias("max_drawdown")
    )


def series_problems(prices: DataFrame, by: Sequence[str], order: str, price: str, kind: str = "prices") -> DataFrame:
    """One row per series that cannot be used, with the first rule it breaks."""
    value = F.col(price)
    floor_broken = value <= 0 if kind == "prices" else value < -1
    checked = prices.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(~is_finite(value) | value.isNull()).alias("_odd"),
        F.count_if(floor_broken).alias("_low"),
    )
    repeated = prices.groupBy(*by, order).count().where("count > 1").groupBy(*by).agg(F.count(F.lit(1)).alias("_twice"))
    least = 2 if kind == "prices" else 1
    short = f"{kind} must contain at least {least} observation" + ("s" if least > 1 else "")
    limit = "prices must contain only positive values" if kind == "prices" else "returns must be greater than or equal to -1"
    reason = (
        F.when(F.col("observations") < least, short)
        .when(F.col("_odd") > 0, f"{kind} must be finite")
        .when(F.col("_low") > 0, limit)
        .when(F.col("_twice").isNotNull(), f"{kind} periods must be strictly increasing")
    )
    return (
        checked.join(repeated, list(by), "left")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select(*by, "observations", "reason")
    )


def align_benchmark(prices: DataFrame, by: Sequence[str], order: str, benchmark: DataFrame) -> DataFrame:
    """Attach the benchmark value of the same period and flag series whose periods differ.

    ``benchmark`` has the order column and one value column. A series is aligned when its periods
    are exactly the benchmark's: every row finds a partner and no benchmark period is left over.
    """
    value = next(c for c in benchmark.columns if c != order)
    joined = prices.join(benchmark.withColumnRenamed(value, "benchmark"), order, "left")
    expected = benchmark.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.count("benchmark").alias("_matched"))
    flags = counts.select(
        *by, ((F.col("_rows") == F.col("_matched")) & (F.col("_rows") == expected)).alias("aligned")
    )
    return joined.join(flags, list(by)).select(*prices.columns, "benchmark", "aligned")


def market_statistics(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    value: str,
    periods_per_year: float,
    annual_risk_free_rate: float = 0.0,
    benchmark: str | None = None,
    kind: str = "prices",
    precision: int = 6,
    block: Column | None = None,
) -> DataFrame:
    """One row per series: counts, twelve statistics and a reason for each one that is undefined.

    ``kind`` says whether ``value`` (and the aligned ``benchmark`` column) holds prices or simple
    returns. Everything but the drawdown is an aggregate with map-side partial aggregation.
    """
    check_precision(precision)
    if kind not in ("prices", "returns"):
        raise ValueError("kind must be prices or returns")
    for number, label in ((periods_per_year, "periods_per_year"), (annual_risk_free_rate, "annual_risk_free_rate")):
        if isinstance(number, bool) or not isinstance(number, (int, float)) or not math.isfinite(number):
            raise ValueError(f"{label} must be a finite number")
    if periods_per_year <= 0:
        raise ValueError("periods_per_year must be greater than zero")
    if annual_risk_free_rate <= -1:
        raise ValueError("annual_risk_free_rate must be greater than -1")

    if kind == "prices":
        returns = simple_returns(df, by, order, value, benchmark, block)
    else:
        columns = [*by, order, (block_of(df, order) if block is None else block).alias("_block"), F.col(value).alias("return")]
        if benchmark is not None:
            columns.append(F.col(benchmark).alias("benchmark_return"))
        returns = df.select(*columns)

    rate = float(annual_risk_free_rate) / float(periods_per_year)
    year = F.lit(float(periods_per_year))
    root_year = F.lit(math.sqrt(periods_per_year))
    r = F.col("return")
    measures = [
        F.count(F.lit(1)).alias("return_observations"),
        (F.product(r + 1.0) - 1.0).alias("_total"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_sd"),
        F.min(r).alias("_min"),
        F.max(r).alias("_max"),
        F.avg((r > 0).cast("double")).alias("_positive"),
        F.sqrt(F.avg(F.pow(F.least(r - rate, F.lit(0.0)), 2))).alias("_downside"),
    ]
    if benchmark is not None:
        b = F.col("benchmark_return")
        measures += [
            F.count(b).alias("benchmark_observations"),
            F.covar_samp(r, b).alias("_cov"),
            F.var_samp(b).alias("_bvar"),
            F.avg(b).alias("_bmean"),
            F.min(b).alias("_bmin"),
            F.max(b).alias("_bmax"),
        ]
    stats = returns.groupBy(*by).agg(*measures).join(drawdowns(returns, by, order), list(by))

    n = F.col("return_observations")
    few, flat = n < 2, F.col("_min") == F.col("_max")
    total = F.col("_total")
    values: dict[str, Column] = {
        "total_return": total,
        "annualized_return": F.when(total == -1, F.lit(-1.0)).otherwise(F.pow(total + 1.0, year / n) - 1.0),
        "annualized_volatility": F.when(flat & ~few, F.lit(0.0)).otherwise(F.col("_sd")) * root_year,
        "sharpe_ratio": F.when(~few & ~flat, F.try_divide(F.col("_mean") - rate, F.col("_sd")) * root_year),
        "sortino_ratio": F.try_divide((F.col("_mean") - rate) * year, F.col("_downside") * root_year),
        "max_drawdown": F.col("max_drawdown"),
        "best_period_return": F.col("_max"),
        "worst_period_return": F.col("_min"),
        "positive_period_ratio": F.col("_positive"),
    }
    reasons: dict[str, Column] = {
        "annualized_volatility": F.when(few, NEED_TWO),
        "sharpe_ratio": F.when(few, NEED_TWO).when(flat, FLAT),
        "sortino_ratio": F.when(F.col("_downside") == 0, NO_DOWNSIDE),
    }
    if benchmark is None:
        extra = [F.lit(0).cast("long").alias("benchmark_observations")]
        for name in ("beta", "alpha", "correlation"):
            values[name] = F.lit(None).cast("double")
            reasons[name] = F.lit(NO_BENCHMARK)
    else:
        extra = [F.col("benchmark_observations")]
        uneven = F.col("benchmark_observations") != n
        flat_b = F.col("_bmin") == F.col("_bmax")
        usable = ~few & ~uneven & ~flat_b
        beta = F.when(usable, F.try_divide("_cov", "_bvar"))
        values["beta"] = beta
        values["alpha"] = (F.col("_mean") - rate - beta * (F.col("_bmean") - rate)) * year
        values["correlation"] = F.when(
            usable & ~flat, F.try_divide(F.col("_cov"), F.col("_sd") * F.sqrt(F.col("_bvar")))
        )
        shared = F.when(uneven, MISALIGNED).when(few, NEED_TWO_ALIGNED)
        reasons["beta"] = shared.when(flat_b, FLAT_BENCHMARK)
        reasons["alpha"] = shared.when(flat_b, FLAT_BENCHMARK_BETA)
        reasons["correlation"] = shared.when(flat_b, FLAT_BENCHMARK).when(flat, FLAT_RETURNS)
    columns = []
    for name in STATISTICS:
        columns.append(round_half_even(finite_or_null(values[name]), precision).alias(name))
        if name in reasons:
            columns.append(reasons[name].alias(f"{name}_reason"))
    observations = (n + (1 if kind == "prices" else 0)).alias("input_observations")
    return stats.select(*by, observations, "return_observations", *extra, *columns)


def statistics_long(statistics: DataFrame, by: Sequence[str]) -> DataFrame:
    """The wide result as rows: statistic, value, unit, formula, unavailable_reason."""
    present = set(statistics.columns)
    rows = [
        F.struct(
            F.lit(name).alias("statistic"),
            F.col(name).alias("value"),
            F.lit("ratio").alias("unit"),
            F.lit(formula).alias("formula"),
            (F.col(f"{name}_reason") if f"{name}_reason" in present else F.lit(None).cast("string")).alias(
                "unavailable_reason"
            ),
        )
        for name, formula in STATISTICS.items()
    ]
    return statistics.select(*by, F.explode(F.array(*rows)).alias("_row")).select(*by, "_row.*")
