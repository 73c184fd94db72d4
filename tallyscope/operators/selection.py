"""Pick the comparable observations of each issuer for the screen."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

SAME_PERIOD = ("net_income", "operating_cash_flow", "capital_expenditures")
LATEST_MARKET = ("market_cap", "share_price")
SELECTED_NAMES = ("revenue", "prior_revenue", *SAME_PERIOD, *LATEST_MARKET)
# Fixed value: failure text for an issuer without usable revenue.
NO_COMPARABLE = "no comparable annual revenue"


class Selection(NamedTuple):
    """``selected``: one row per issuer, a struct per name; ``failures``: issuers without revenue."""

    selected: DataFrame
    failures: DataFrame


def _packed() -> Column:
    return F.struct("observation_id", "value", "unit", "period", "evidence_ids")


def canonical_key() -> Column:
    """Sort key of observations of one entity and name."""
    return F.struct(
        F.col("period.end").alias("end"),
        F.coalesce(F.col("period.start"), F.lit("0001-01-01").cast("date")).alias("start"),
        F.col("period.kind").alias("kind"),
        F.coalesce(F.col("period.fiscal_year"), F.lit(-1)).alias("year"),
        F.coalesce(F.col("period.fiscal_period"), F.lit("")).alias("fiscal_period"),
        F.col("unit.kind").alias("unit_kind"),
        F.col("unit.symbol").alias("symbol"),
        F.col("unit.scale").alias("scale"),
        F.col("observation_id"),
    )


def comparable_revenue(observations: DataFrame) -> DataFrame:
    """Current and prior fiscal-year revenue in the issuer's best currency and scale.

    Reduces to one row per period end before anything is ordered, so a heavily restated issuer is
    combined on the map side. The best group has the latest end, then the most rows, then the
    earliest first observation.
    """
    annual = observations.where(
        (F.col("name") == "revenue")
        & (F.col("period.kind") == "duration")
        & (F.col("period.fiscal_period") == "FY")
        & (F.col("unit.kind") == "currency")
    )
    group = ["entity_id", "symbol", "scale"]
    per_end = annual.groupBy(
        "entity_id",
        F.col("unit.symbol").alias("symbol"),
        F.col("unit.scale").alias("scale"),
        F.col("period.end").alias("end"),
    ).agg(
        F.max_by(_packed(), "observation_id").alias("_packed"),
        F.count(F.lit(1)).alias("_n"),
        F.min(canonical_key()).alias("_first"),
    )
    ranked = per_end.groupBy(*group).agg(
        F.max("end").alias("_latest"), F.sum("_n").alias("_rows"), F.min("_first").alias("_first")
    )
    best = ranked.groupBy("entity_id").agg(
        F.min_by(F.struct("symbol", "scale"), F.struct(-F.unix_date("_latest"), -F.col("_rows"), "_first")).alias("_g")
    ).select("entity_id", "_g.*")
    newest = Window.partitionBy(*group).orderBy(F.col("end").desc())
    two = per_end.withColumn("_position", F.row_number().over(newest)).where("_position <= 2")
    return (
        two.join(best, group)
        .groupBy("entity_id")
        .agg(
            F.max(F.when(F.col("_position") == 1, F.col("_packed"))).alias("revenue"),
            F.max(F.when(F.col("_position") == 2, F.col("_packed"))).alias("prior_revenue"),
        )
    )


def select_observations(observations: DataFrame) -> Selection:
    """Comparable revenue plus same-period facts and the latest market values in its currency."""
    revenue = comparable_revenue(observations)
    others = observations.where(F.col("name").isin(*SAME_PERIOD, *LATEST_MARKET))
    current = F.col("revenue")
    same = (
        F.col("name").isin(*SAME_PERIOD)
        & F.col("period").eqNullSafe(current["period"])
        & F.col("unit").eqNullSafe(current["unit"])
    )
    latest = (
        F.col("name").isin(*LATEST_MARKET)
        & (F.col("unit.symbol") == current["unit"]["symbol"])
        & (F.col("unit.scale") == current["unit"]["scale"])
    )
    matched = (
        others.join(revenue.select("entity_id", "revenue"), "entity_id")
        .where(same | latest)
        .groupBy("entity_id")
        .agg(
            *[
                F.max_by(F.when(F.col("name") == n, _packed()), F.when(F.col("name") == n, canonical_key())).alias(n)
                for n in (*SAME_PERIOD, *LATEST_MARKET)
            ]
        )
    )
    selected = revenue.join(matched, "entity_id", "left").select("entity_id", *SELECTED_NAMES)
    failures = (
        observations.select("entity_id")
        .distinct()
        .join(revenue.select("entity_id"), "entity_id", "left_anti")
        .select("entity_id", F.lit(NO_COMPARABLE).alias("error"))
    )
    return Selection(selected, failures)


def selected_values(selected: DataFrame) -> DataFrame:
    """Flatten to one double per name and keep the structs as ``<name>_observation``."""
    return selected.select(
        "entity_id",
        *[F.col(f"{n}.value").alias(n) for n in SELECTED_NAMES],
        *[F.col(n).alias(f"{n}_observation") for n in SELECTED_NAMES],
    )


def ordered_sources(selected: DataFrame) -> Column:
    """Distinct evidence ids in first-seen order over the selected observations."""
    lists = [F.coalesce(F.col(f"{n}.evidence_ids"), F.array().cast("array<string>")) for n in SELECTED_NAMES]
    return F.array_distinct(F.concat(*lists))
