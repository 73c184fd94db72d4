"""Weighted, tie-aware percentile ranking of any number of entities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyscope.functions.numeric import check_precision, round_half_even
from tallyscope.operators.ordering import join_null_safe, value_ranks
from tallyscope.operators.quality import Violation, raise_on
from tallyscope.session import settle

MISSING_POLICIES = ("exclude", "neutral", "worst")
DIRECTIONS = ("higher", "lower")


@dataclass(frozen=True)
class Criterion:
    metric: str
    direction: str
    weight: float


class RankResult(NamedTuple):
    """``ranked``: one scored row per eligible entity; ``excluded``: rows with missing metrics; ``rejected``: rows that
    cannot be ranked, with a reason."""

    ranked: DataFrame
    excluded: DataFrame
    rejected: DataFrame


def check_criteria(criteria: Sequence[Criterion]) -> tuple[Criterion, ...]:
    items = tuple(criteria)
    if not items:
        raise ValueError("criteria must not be empty")
    names = [c.metric for c in items]
    if any(not isinstance(n, str) or not n.strip() for n in names):
        raise ValueError("criterion metric must be a non-empty string")
    if len(set(names)) != len(names):
        raise ValueError("criterion metrics must be unique")
    for c in items:
        if c.direction not in DIRECTIONS:
            raise ValueError("criterion direction must be one of: higher, lower")
        if isinstance(c.weight, bool) or not isinstance(c.weight, (int, float)) or not math.isfinite(c.weight):
            raise ValueError("criterion weight must be a finite number")
        if c.weight < 0:
            raise ValueError("criterion weight must be non-negative")
    if normalized_total(items) <= 0:
        raise ValueError("criteria weights must sum to more than zero")
    return items


def normalized_total(criteria: Sequence[Criterion]) -> float:
    return math.fsum(c.weight for c in criteria)


def normalized_weights(criteria: Sequence[Criterion]) -> dict[str, float]:
    total = normalized_total(criteria)
    return {c.metric: c.weight / total for c in criteria}


def check_rank_input(df: DataFrame, entity: str, criteria: Sequence[Criterion], by: Sequence[str] = ()) -> None:
    """Raise when an entity id is blank or repeated in its group, or a metric is not finite."""
    blank = df.where(F.col(entity).isNull() | (F.trim(F.col(entity).cast("string")) == ""))
    repeated = df.groupBy(*by, entity).count().where("count > 1")
    odd = None
    for c in criteria:
        value = F.col(c.metric).cast("double")
        bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        odd = bad if odd is None else odd | bad
    raise_on(
        Violation("row id must be a non-empty string", blank),
        Violation("duplicate row id", repeated),
        Violation("ranking metrics must be finite", df.where(odd)),
    )


def rank_entities(
    df: DataFrame,
    entity: str,
    criteria: Sequence[Criterion],
    missing_policy: str,
    by: Sequence[str] = (),
    top_n: int | None = None,
    precision: int = 6,
    settled: bool = False,
) -> RankResult:
    """Score entities by percentile per criterion and combine the scores by normalized weight.

    ``ranked`` has the group and entity columns, ``<metric>``, ``<metric>_rank`` and
    ``<metric>_score`` per criterion, ``composite_score``, ``missing_metrics``. Order it with
    :func:`rank_order`; the composite is rounded before it is compared. Rows with a blank id, an id that repeats in its
    group, or a metric that is not finite are rejected and neither ranked nor counted. A null group is a group.

    The narrow metric table (one row per entity) is read several times, so it is written out
    first unless ``settled`` says the input is already cheap to reread.
    """
    check_precision(precision)
    items = check_criteria(criteria)
    if missing_policy not in MISSING_POLICIES:
        raise ValueError("missing_policy must be one of: exclude, neutral, worst")
    if top_n is not None and (isinstance(top_n, bool) or not isinstance(top_n, int) or top_n <= 0):
        raise ValueError("top_n must be a positive integer")

    keys = [*by, entity]
    values = df.select(*keys, *[F.col(c.metric).cast("double").alias(c.metric) for c in items])
    if not settled:
        values = settle(values)
    blank = F.col(entity).isNull() | (F.trim(F.col(entity).cast("string")) == "")
    odd = F.lit(False)
    for c in items:
        odd = odd | F.coalesce(F.isnan(c.metric) | (F.abs(c.metric) == F.lit(float("inf"))), F.lit(False))
    repeated = values.groupBy(*keys).count().where("count > 1").select(*keys, F.lit(True).alias("_repeated"))
    problem = (
        F.when(blank, "row id must be a non-empty string")
        .when(F.col("_repeated"), "duplicate row id")
        .when(odd, "ranking metrics must be finite")
    )
    checked = join_null_safe(values, repeated, keys, "left").withColumn("reason", problem).drop("_repeated")
    rejected = checked.where("reason is not null").select(*keys, "reason")
    values = checked.where("reason is null").drop("reason")
    absent = F.filter(
        F.array(*[F.when(F.col(c.metric).isNull(), F.lit(c.metric)) for c in items]), lambda m: m.isNotNull()
    )
    values = values.withColumn("missing_metrics", absent)
    excluded = values.where(F.size("missing_metrics") > 0) if missing_policy == "exclude" else values.where("false")
    excluded = excluded.select(
        *keys, F.lit("missing one or more ranking metrics").alias("reason"), "missing_metrics"
    )
    eligible = values.where(F.size("missing_metrics") == 0) if missing_policy == "exclude" else values

    # One narrow row per entity and present metric; lower-is-better compares as is, higher negated.
    cells = eligible.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c.metric).alias("_metric"),
                        (-F.col(c.metric) if c.direction == "higher" else F.col(c.metric)).alias("_value"),
                    )
                    for c in items
                ]
            )
        ).alias("_cell"),
    ).select(*keys, "_cell.*").where(F.col("_value").isNotNull())
    ranks = value_ranks(cells, by, "_metric", "_value")
    # Every cell has its rank. An outer join says that only the ranks may be broadcast: cells sent to the few tasks that
    # hold the distinct values would all be aggregated there.
    located = join_null_safe(cells, ranks, [*by, "_metric", "_value"], "left")
    n, rank = F.col("population"), F.col("average_rank")
    score = F.when(n == 1, F.lit(100.0)).otherwise(F.try_divide(F.lit(100.0) * (n - rank), n - F.lit(1.0)))
    # Plain doubles, so that the aggregate keeps them in a hash map; a struct would have each task sort its rows.
    wide = located.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_metric") == c.metric, part)).alias(f"_{name}_{c.metric}")
            for c in items
            for name, part in (("rank", rank), ("score", score))
        ]
    )
    fill = F.lit(0.0 if missing_policy == "worst" else 50.0)
    scored = join_null_safe(eligible, wide, keys, "left")
    weights = normalized_weights(items)
    composite: Column = F.lit(0.0)
    columns: list[Column] = []
    for c in items:
        raw = F.coalesce(F.col(f"_score_{c.metric}"), fill)
        composite = composite + raw * F.lit(weights[c.metric])
        columns += [
            F.col(c.metric),
            round_half_even(F.col(f"_rank_{c.metric}"), precision).alias(f"{c.metric}_rank"),
            round_half_even(raw, precision).alias(f"{c.metric}_score"),
        ]
    ranked = scored.select(
        *keys, *columns, round_half_even(composite, precision).alias("composite_score"), "missing_metrics"
    )
    if top_n is not None:
        ranked = keep_top(ranked, entity, top_n, by)
    return RankResult(ranked, excluded, rejected)


def rank_order(entity: str) -> list[Column]:
    return [F.col("composite_score").desc(), F.col(entity).asc()]


def keep_top(ranked: DataFrame, entity: str, top_n: int, by: Sequence[str] = ()) -> DataFrame:
    """First rows by composite then id; per group the limit is pushed below the shuffle by Spark."""
    if not by:
        return ranked.orderBy(*rank_order(entity)).limit(top_n)
    window = Window.partitionBy(*by).orderBy(*rank_order(entity))
    return ranked.withColumn("_position", F.row_number().over(window)).where(F.col("_position") <= top_n).drop("_position")


def rank_counts(df: DataFrame, result: RankResult, by: Sequence[str] = ()) -> DataFrame:
    """input_count, eligible_count, returned_count (one row, or one per group)."""
    tagged = (
        df.select(*by, F.lit(1).alias("i"), F.lit(0).alias("x"), F.lit(0).alias("r"))
        .unionByName(result.rejected.select(*by, F.lit(0).alias("i"), F.lit(1).alias("x"), F.lit(0).alias("r")))
        .unionByName(result.excluded.select(*by, F.lit(0).alias("i"), F.lit(1).alias("x"), F.lit(0).alias("r")))
        .unionByName(result.ranked.select(*by, F.lit(0).alias("i"), F.lit(0).alias("x"), F.lit(1).alias("r")))
    )
    return tagged.groupBy(*by).agg(
        F.sum("i").alias("input_count"),
        (F.sum("i") - F.sum("x")).alias("eligible_count"),
        F.sum("r").alias("returned_count"),
    )
