"""Issuer screen: five metrics, weighted rank, candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.functions.numeric import one_decimal_text, round_half_even
from tallyscope.operators.metrics import add_metrics
from tallyscope.operators.ordering import ordinal
from tallyscope.operators.ranking import Criterion, RankResult, rank_entities
from tallyscope.session import settle

SCREEN_METRICS = ("revenue_growth", "net_margin", "free_cash_flow", "free_cash_flow_margin", "price_to_sales")
# Screen weights.
SCREEN_CRITERIA = (
    Criterion("revenue_growth", "higher", 0.35),
    Criterion("net_margin", "higher", 0.25),
    Criterion("free_cash_flow_margin", "higher", 0.15),
    Criterion("price_to_sales", "lower", 0.25),
)
# Gap texts in report order.
_GAPS = {
    "revenue_growth": "prior comparable revenue",
    "net_margin": "same-period net income",
    "free_cash_flow_margin": "same-period cash flow and capital expenditure",
    "price_to_sales": "current market capitalization",
}
# Factor of a unit scale to millions.
_MILLIONS = {"units": 1e-6, "thousands": 1e-3, "millions": 1.0, "billions": 1e3}
# Candidate texts.
_WHY_NOW = (
    "Latest comparable SEC fiscal-year evidence ends ",
    "; market fields use separately timestamped yfinance evidence when available.",
)
_FIRST_REJECTION = (
    "A deterministic screen can surface accounting or valuation outliers without "
    "establishing estimate durability, business quality, or a true market mispricing."
)
_INVESTABLE_IF = (
    "Deeper filing, earnings, and valuation work confirms the metric signal and "
    "identifies a source-backed variant view."
)
_KILL_IF = (
    "Restated periods, weak cash conversion, stale market data, or follow-up evidence "
    "invalidate the apparent cross-issuer advantage."
)
_NEXT_WORKFLOW = "company_tearsheet_and_earnings_diligence"


def screen_metrics(facts: DataFrame, precision: int = 6) -> DataFrame:
    return add_metrics(facts, SCREEN_METRICS, precision)


def screen_rank(
    screened: DataFrame, entity: str = "entity_id", top_n: int | None = None, settled: bool = False
) -> RankResult:
    return rank_entities(screened, entity, SCREEN_CRITERIA, "worst", top_n=top_n, settled=settled)


def with_screen_rank(ranked: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Append the 1-based ``screen_rank`` by composite (descending) then id, without a global window."""
    return ordinal(ranked, [-F.col("composite_score"), F.col(entity)], "screen_rank")


def available_metrics() -> Column:
    total = F.lit(0)
    for name in SCREEN_METRICS:
        total = total + F.col(name).isNotNull().cast("int")
    return total


def evidence_gaps(failed_providers: Column | None = None) -> Column:
    """Messages for missing metrics, then one per failed provider."""
    messages = [
        F.when(F.col(m).isNull(), f"Missing {text}; {m.replace('_', ' ')} unavailable") for m, text in _GAPS.items()
    ]
    gaps = F.filter(F.array(*messages), lambda g: g.isNotNull())
    if failed_providers is None:
        return gaps
    failed = F.coalesce(failed_providers, F.array().cast("array<string>"))
    return F.concat(gaps, F.transform(failed, lambda p: F.concat(p, F.lit(" provider unavailable for this issuer"))))


def confidence(has_market: Column, available: Column) -> Column:
    return F.when(has_market & (available >= 4), "high").when(available >= 2, "medium").otherwise("low")


def data_quality(gaps: Column, available: Column) -> Column:
    return F.when(F.size(gaps) == 0, "complete").when(available >= 2, "partial").otherwise("limited")


def bucket(has_market: Column, rank: Column, count: Column) -> Column:
    gated = F.greatest(F.lit(2), F.ceil(count / F.lit(2.0)))
    return (
        F.when(~has_market, "exposure_unproven")
        .when(rank == 1, "advance")
        .when(rank <= gated, "valuation_gated")
        .otherwise("deprioritized")
    )


def priority_score(composite: Column) -> Column:
    whole = F.coalesce(round_half_even(composite, 0), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), whole.cast("int")))


def percent_text(value: Column) -> Column:
    return F.coalesce(F.concat(one_decimal_text(value * 100.0), F.lit("%")), F.lit("unavailable"))


def multiple_text(value: Column) -> Column:
    return F.coalesce(F.concat(one_decimal_text(value), F.lit("x")), F.lit("unavailable"))


def variant_wedge(rank: Column, count: Column) -> Column:
    growth = percent_text(F.col("revenue_growth"))
    margin = percent_text(F.col("net_margin"))
    valuation = multiple_text(F.col("price_to_sales"))
    return F.concat(
        F.lit("Rule screen rank "),
        rank.cast("string"),
        F.lit("/"),
        count.cast("string"),
        F.lit(": revenue growth "),
        growth,
        F.lit(", net margin "),
        margin,
        F.lit(", price/sales "),
        valuation,
        F.lit("."),
    )


def currency_millions(observation: Column) -> Column:
    factor = F.lit(None).cast("double")
    for scale, by in _MILLIONS.items():
        factor = F.when(observation["unit"]["scale"] == scale, by).otherwise(factor)
    return observation["value"] * factor


def _financial(metric: str, label: str, value: Column, unit: Column, period: Column, sources: Column) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        F.lit(label).alias("label"),
        value.cast("double").alias("value"),
        unit.alias("unit"),
        period.cast("string").alias("period"),
        sources.alias("source_ids"),
    )


def candidate_financials() -> Column:
    """Financial rows of a candidate; a metric appears only when all its observations exist."""

    def obs(name: str) -> Column:
        return F.col(f"{name}_observation")

    revenue = obs("revenue")
    period = revenue["period"]["end"]
    rows = [
        _financial(
            "revenue",
            "Revenue",
            currency_millions(revenue),
            F.concat(revenue["unit"]["symbol"], F.lit(" millions")),
            period,
            revenue["evidence_ids"],
        )
    ]
    for metric, label, unit, names in (
        ("revenue_growth", "Revenue growth", "ratio", ("revenue", "prior_revenue")),
        ("net_margin", "Net margin", "ratio", ("revenue", "net_income")),
        (
            "free_cash_flow_margin",
            "Free cash flow margin",
            "ratio",
            ("revenue", "operating_cash_flow", "capital_expenditures"),
        ),
        ("price_to_sales", "Price / sales", "x", ("revenue", "market_cap")),
    ):
        usable = F.col(metric).isNotNull()
        for name in names:
            usable = usable & obs(name).isNotNull()
        cited = F.array_distinct(F.concat(*[obs(n)["evidence_ids"] for n in names]))
        rows.append(F.when(usable, _financial(metric, label, F.col(metric), F.lit(unit), period, cited)))
    price = obs("share_price")
    rows.append(
        F.when(
            price.isNotNull(),
            _financial(
                "share_price",
                "Share price",
                price["value"],
                price["unit"]["symbol"],
                price["period"]["end"],
                price["evidence_ids"],
            ),
        )
    )
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def candidate_columns(
    has_market: Column, rank: Column, count: Column, failed_providers: Column | None = None
) -> dict[str, Column]:
    """The derived candidate fields that need only metrics, composite score and rank."""
    gaps = evidence_gaps(failed_providers)
    available = available_metrics()
    return {
        "bucket": bucket(has_market, rank, count),
        "priority_score": priority_score(F.col("composite_score")),
        "variant_wedge": variant_wedge(rank, count),
        "confidence": confidence(has_market, available),
        "data_quality": data_quality(gaps, available),
        "evidence_gaps": gaps,
    }


def build_candidates(
    analyses: DataFrame, ranked: DataFrame, limit: int | None = None, entity: str = "entity_id"
) -> DataFrame:
    """Candidate rows.

    ``analyses``: per issuer the five metrics, ``ticker``, ``company``, ``has_market``,
    ``failed_providers``, ``identity_evidence_id`` and the ``<name>_observation`` structs.
    ``ranked``: the score table. With ``limit`` only the best rows become candidates, and the
    shortlist is then small enough to number directly.
    """
    scores = settle(ranked.select(entity, "composite_score"))
    total = scores.agg(F.count(F.lit(1)).alias("n")).scalar()
    if limit is not None:
        scores = scores.orderBy(F.col("composite_score").desc(), F.col(entity)).limit(limit)
    numbered = with_screen_rank(scores, entity)
    joined = analyses.join(numbered, entity).withColumn("screened_count", total)
    fields = candidate_columns(
        F.col("has_market"), F.col("screen_rank"), F.col("screened_count"), F.col("failed_providers")
    )
    period_end = F.col("revenue_observation.period.end").cast("string")
    sources = F.array_distinct(
        F.concat(
            F.array(F.col("identity_evidence_id")),
            *[
                F.coalesce(F.col(f"{n}_observation.evidence_ids"), F.array().cast("array<string>"))
                for n in (
                    "revenue",
                    "prior_revenue",
                    "net_income",
                    "operating_cash_flow",
                    "capital_expenditures",
                    "market_cap",
                    "share_price",
                )
            ],
        )
    )
    return joined.select(
        F.col(entity).alias("candidate_id"),
        "ticker",
        "company",
        fields["bucket"].alias("bucket"),
        fields["priority_score"].alias("priority_score"),
        fields["variant_wedge"].alias("variant_wedge"),
        F.concat(F.lit(_WHY_NOW[0]), period_end, F.lit(_WHY_NOW[1])).alias("why_now"),
        F.lit(_FIRST_REJECTION).alias("first_rejection"),
        F.lit(_INVESTABLE_IF).alias("investable_if"),
        F.lit(_KILL_IF).alias("kill_if"),
        F.lit(_NEXT_WORKFLOW).alias("next_workflow"),
        sources.alias("evidence_ids"),
        candidate_financials().alias("financials"),
        fields["confidence"].alias("confidence"),
        fields["data_quality"].alias("data_quality"),
        period_end.alias("as_of"),
        F.lit("live").alias("source_mode"),
        fields["evidence_gaps"].alias("evidence_gaps"),
        "composite_score",
        "screen_rank",
    )
