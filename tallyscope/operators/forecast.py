"""Growth scenarios and discounted cash flow, evaluated inside each row (no shuffle)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.functions.numeric import as_column, check_precision, is_finite, round_half_even

# Formula texts.
FORECAST_FORMULAS = {
    "period_value": "value[t] = value[t-1] * (1 + growth_rate[t])",
    "total_growth": "ending_value / base_value - 1",
    "cagr": "(ending_value / base_value) ** (1 / periods) - 1",
}
PERPETUITY_FORMULA = "last_cash_flow * (1 + terminal_growth_rate) / (discount_rate - terminal_growth_rate)"
EXIT_FORMULA = "terminal_metric_value * exit_multiple"


class ForecastResult(NamedTuple):
    schedule: DataFrame
    summary: DataFrame
    rejected: DataFrame


class DcfResult(NamedTuple):
    summary: DataFrame
    schedule: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class PerpetuityGrowth:
    growth_rate: float | Column | str


@dataclass(frozen=True)
class ExitMultiple:
    multiple: float | Column | str
    metric_value: Column | str | None = None


def _number(value: float | Column | str) -> Column:
    return as_column(value).cast("double") if isinstance(value, (str, Column)) else F.lit(float(value))


def _period_labels(labels: Sequence[str] | None, periods: int) -> list[str]:
    if labels is None:
        return [f"Period {t}" for t in range(1, periods + 1)]
    texts = [t.strip() if isinstance(t, str) else "" for t in labels]
    if len(texts) != periods:
        raise ValueError(f"labels must contain exactly {periods} forecast-period labels")
    if any(not t for t in texts):
        raise ValueError("labels must be non-empty strings")
    return texts


def _compound(base: Column, rates: Column) -> Column:
    """Array of values after each period."""
    start = F.struct(base.alias("last"), F.array().cast("array<double>").alias("path"))

    def step(state: Column, rate: Column) -> Column:
        value = state["last"] * (F.lit(1.0) + rate)
        return F.struct(value.alias("last"), F.concat(state["path"], F.array(value)).alias("path"))

    return F.aggregate(rates, start, step, lambda state: state["path"])


def forecast_growth(
    df: DataFrame,
    keys: Sequence[str],
    base_value: Column | str,
    scenarios: Mapping[str, Sequence[float]],
    periods: int,
    labels: Sequence[str] | None = None,
    unit: str = "amount",
    precision: int = 6,
) -> ForecastResult:
    """Compound each scenario from a positive base; one rate repeats, or one rate per period."""
    check_precision(precision)
    if isinstance(periods, bool) or not isinstance(periods, int) or periods <= 0:
        raise ValueError("periods must be a positive integer")
    names = _period_labels(labels, periods)
    if not unit.strip():
        raise ValueError("unit must be a non-empty string")
    if not scenarios:
        raise ValueError("scenarios must not be empty")
    plans = []
    for raw, rates in scenarios.items():
        name = raw.strip()
        if not name:
            raise ValueError("scenario name must be a non-empty string")
        if len(rates) not in (1, periods):
            raise ValueError(f"growth_rates must contain one rate or exactly {periods} rates")
        if any(isinstance(g, bool) or not math.isfinite(g) or g <= -1 for g in rates):
            raise ValueError("growth rates must be finite and greater than -1")
        mode = "constant" if len(rates) == 1 else "period_specific"
        full = list(rates) * periods if len(rates) == 1 else list(rates)
        plans.append((name, mode, [float(g) for g in full]))
    if len({p[0] for p in plans}) != len(plans):
        raise ValueError("scenario names must be unique")

    base = as_column(base_value).cast("double")
    usable = is_finite(base) & (base > 0)
    rejected = df.where(~F.coalesce(usable, F.lit(False))).select(
        *keys, F.lit("base_value must be greater than zero").alias("reason")
    )
    plan_rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(mode).alias("rate_mode"),
                F.array(*[F.lit(g) for g in full]).alias("rates"),
            )
            for name, mode, full in plans
        ]
    )
    grown = (
        df.where(usable)
        .select(*keys, base.alias("_base"), F.explode(plan_rows).alias("_plan"))
        .select(*keys, "_base", "_plan.*", _compound(F.col("_base"), F.col("_plan.rates")).alias("_path"))
    )
    row = F.arrays_zip(
        F.sequence(F.lit(1), F.lit(periods)).alias("period"),
        F.array(*[F.lit(t) for t in names]).alias("label"),
        F.col("rates").alias("rate"),
        F.col("_path").alias("path"),
    )
    schedule = grown.select(*keys, "scenario", F.explode(row).alias("_row")).select(
        *keys,
        "scenario",
        F.col("_row.period").alias("period"),
        F.col("_row.label").alias("label"),
        round_half_even("_row.rate", precision).alias("growth_rate"),
        round_half_even("_row.path", precision).alias("value"),
    )
    ending = F.element_at("_path", -1)
    summary = grown.select(
        *keys,
        "scenario",
        "rate_mode",
        F.lit(periods).alias("periods"),
        F.lit(unit.strip()).alias("unit"),
        round_half_even("_base", precision).alias("base_value"),
        round_half_even(ending, precision).alias("ending_value"),
        round_half_even(ending / F.col("_base") - 1.0, precision).alias("total_growth"),
        round_half_even(F.pow(ending / F.col("_base"), F.lit(1.0 / periods)) - 1.0, precision).alias("cagr"),
    )
    return ForecastResult(schedule, summary, rejected)


def discount_factor(discount_rate: Column, period: Column, mid_year: bool) -> Column:
    growth = F.lit(1.0) + discount_rate
    divisor = F.pow(growth, period.cast("double"))
    return F.lit(1.0) / (divisor / F.sqrt(growth) if mid_year else divisor)


def discounted_cash_flow(
    df: DataFrame,
    keys: Sequence[str],
    cash_flows: Column | str,
    discount_rate: float | Column | str,
    terminal: PerpetuityGrowth | ExitMultiple,
    net_debt: float | Column | str = 0.0,
    shares_outstanding: Column | str | None = None,
    mid_year: bool = False,
    labels: Sequence[str] | None = None,
    unit: str = "amount",
    precision: int = 6,
) -> DcfResult:
    """Value an ARRAY of forecast cash flows plus a terminal value; rows that break a rule are rejected."""
    check_precision(precision)
    if not unit.strip():
        raise ValueError("unit must be a non-empty string")
    flows = as_column(cash_flows).cast("array<double>")
    shares = None if shares_outstanding is None else as_column(shares_outstanding).cast("double")
    staged = df.select(
        *keys,
        flows.alias("_flows"),
        _number(discount_rate).alias("_rate"),
        _number(net_debt).alias("_debt"),
        (F.lit(None).cast("double") if shares is None else shares).alias("_shares"),
        *(
            [_number(terminal.growth_rate).alias("_growth")]
            if isinstance(terminal, PerpetuityGrowth)
            else [
                _number(terminal.multiple).alias("_multiple"),
                (F.lit(None).cast("double") if terminal.metric_value is None else _number(terminal.metric_value)).alias(
                    "_metric"
                ),
            ]
        ),
    )
    c = F.col
    reason = (
        F.when(c("_flows").isNull() | (F.size("_flows") == 0), "cash_flows must be a non-empty array")
        .when(~F.forall("_flows", is_finite), "cash_flows must be finite")
        .when(~is_finite("_rate") | (c("_rate") <= -1), "discount_rate must be greater than -1")
        .when(~is_finite("_debt"), "net_debt must be finite")
    )
    if shares is not None:
        reason = reason.when(c("_shares") <= 0, "shares_outstanding must be greater than zero")
    if labels is not None:
        names = _period_labels(labels, len(labels))
        reason = reason.when(F.size("_flows") != len(names), f"labels must contain exactly {len(names)} periods")
    if isinstance(terminal, PerpetuityGrowth):
        reason = reason.when(
            ~is_finite("_growth") | (c("_growth") <= -1), "terminal.growth_rate must be greater than -1"
        ).when(c("_growth") >= c("_rate"), "terminal.growth_rate must be less than discount_rate")
    else:
        reason = reason.when(
            ~is_finite("_multiple") | (c("_multiple") <= 0), "terminal.multiple must be greater than zero"
        )
    checked = staged.withColumn("reason", reason)
    rejected = checked.where("reason is not null").select(*keys, "reason")

    periods = F.sequence(F.lit(1), F.size("_flows"))
    factors = F.transform(periods, lambda t: discount_factor(c("_rate"), t, mid_year))
    valued = checked.where("reason is null").withColumn("_factors", factors)
    valued = valued.withColumn("_present", F.zip_with("_flows", "_factors", lambda cf, f: cf * f))
    last = F.element_at("_flows", -1)
    if isinstance(terminal, PerpetuityGrowth):
        terminal_flow = last * (F.lit(1.0) + c("_growth"))
        terminal_value = terminal_flow / (c("_rate") - c("_growth"))
        method, formula = "perpetuity_growth", PERPETUITY_FORMULA
        inputs = [
            round_half_even("_growth", precision).alias("terminal_growth_rate"),
            round_half_even(terminal_flow, precision).alias("terminal_cash_flow"),
        ]
    else:
        metric = F.coalesce(c("_metric"), last)
        terminal_value = metric * c("_multiple")
        method, formula = "exit_multiple", EXIT_FORMULA
        inputs = [
            round_half_even("_multiple", precision).alias("terminal_multiple"),
            round_half_even(metric, precision).alias("terminal_metric_value"),
            F.when(c("_metric").isNotNull(), "terminal.metric_value")
            .otherwise("last forecast cash flow")
            .alias("terminal_metric_source"),
        ]
    valued = valued.withColumn("_tv", terminal_value)
    final_factor = F.element_at("_factors", -1)
    forecast_pv = F.aggregate("_present", F.lit(0.0), lambda total, v: total + v)
    terminal_pv = c("_tv") * final_factor
    enterprise = forecast_pv + terminal_pv
    equity = enterprise - c("_debt")
    shift = 0.5 if mid_year else 0.0
    summary = valued.select(
        *keys,
        F.size("_flows").alias("periods"),
        round_half_even("_rate", precision).alias("discount_rate"),
        F.lit(mid_year).alias("mid_year"),
        F.lit(method).alias("terminal_method"),
        *inputs,
        F.lit(formula).alias("terminal_formula"),
        (F.size("_flows") - F.lit(shift)).alias("terminal_discount_period"),
        round_half_even(final_factor, precision).alias("terminal_discount_factor"),
        round_half_even("_tv", precision).alias("terminal_value"),
        round_half_even(forecast_pv, precision).alias("pv_forecast_cash_flows"),
        round_half_even(terminal_pv, precision).alias("pv_terminal_value"),
        round_half_even(enterprise, precision).alias("enterprise_value"),
        round_half_even("_debt", precision).alias("net_debt"),
        round_half_even(equity, precision).alias("equity_value"),
        round_half_even("_shares", precision).alias("shares_outstanding"),
        round_half_even(F.try_divide(equity, c("_shares")), precision).alias("per_share_value"),
        F.lit(unit.strip()).alias("unit"),
        F.when(c("_shares").isNotNull(), f"{unit.strip()}_per_share").alias("per_share_unit"),
    )
    label_column = (
        F.transform(periods, lambda t: F.concat(F.lit("Period "), t.cast("string")))
        if labels is None
        else F.array(*[F.lit(t) for t in names])
    )
    row = F.arrays_zip(
        periods.alias("period"),
        label_column.alias("label"),
        c("_flows").alias("flow"),
        c("_factors").alias("factor"),
        c("_present").alias("present"),
    )
    schedule = valued.select(*keys, F.explode(row).alias("_row")).select(
        *keys,
        c("_row.period").alias("period"),
        c("_row.label").alias("label"),
        round_half_even("_row.flow", precision).alias("cash_flow"),
        (c("_row.period") - F.lit(shift)).alias("discount_period"),
        round_half_even("_row.factor", precision).alias("discount_factor"),
        round_half_even("_row.present", precision).alias("present_value"),
    )
    return DcfResult(summary, schedule, rejected)
