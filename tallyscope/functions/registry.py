"""The formulas as SQL functions, and a hook for a user's own per-entity analyzer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from tallyscope.functions.numeric import round_half_even_sql
from tallyscope.operators.metrics import METRICS, MetricSpec

PREFIX = "fin_"
_ARITHMETIC = {
    "difference": ("current_value double, prior_value double", "current_value - prior_value"),
    "ratio": ("numerator double, denominator double", "try_divide(numerator, denominator)"),
    "percent_change": (
        "current_value double, prior_value double",
        "try_divide(current_value - prior_value, prior_value)",
    ),
    "basis_point_change": (
        "current_value double, prior_value double",
        "(current_value - prior_value) * 10000.0D",
    ),
    "cagr": (
        "start_value double, end_value double, periods double",
        "case when start_value > 0 and end_value > 0 and periods > 0 "
        "then pow(end_value / start_value, 1.0D / periods) - 1.0D end",
    ),
    "round_half_even": ("x double", round_half_even_sql("x", 6)),
}


def _metric_body(spec: MetricSpec) -> str:
    p = spec.parts
    return {
        "difference": lambda: f"{p[0]} - {p[1]}",
        "value": lambda: f"{p[0]} + {p[1]} + coalesce({p[2]}, 0.0D) + coalesce({p[3]}, 0.0D) - {p[4]}",
        "fact_ratio": lambda: f"try_divide({p[0]}, {p[1]})",
        "ratio": lambda: f"try_divide({p[0]}, {p[1]})",
        "growth": lambda: f"try_divide({p[0]} - {p[1]}, {p[1]})",
        "slope": lambda: f"try_divide({p[0]} - {p[1]}, {p[2]} - {p[3]})",
        "days": lambda: f"try_divide({p[0]}, {p[1]}) * coalesce({p[2]}, 365.0D)",
        "cycle": lambda: f"{p[0]} + {p[1]} - {p[2]}",
        "total": lambda: f"{p[0]} + {p[1]}",
    }[spec.rule]()


def register_functions(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Create temporary SQL functions for the arithmetic and metric formulas.

    They are SQL bodies that Catalyst inlines, so a query that calls them stays in generated code.
    Metric functions take their formula inputs in order, e.g. ``fin_gross_margin(gross_profit, revenue)``.
    """
    created = []
    for name, (arguments, body) in _ARITHMETIC.items():
        created.append((name, arguments, body))
    for spec in METRICS:
        created.append((spec.name, ", ".join(f"{p} double" for p in spec.parts), _metric_body(spec)))
    for name, arguments, body in created:
        spark.sql(f"create or replace temporary function {prefix}{name}({arguments}) returns double return {body}")
    return [prefix + name for name, _, _ in created]


def per_entity(df: DataFrame, keys: Sequence[str], analyze: Callable, schema) -> DataFrame:
    """Run a user's function on the pandas rows of each entity.

    The rows of one entity are in memory together, as the user's function requires; reduce them
    to the selected observations first.
    """
    return df.groupBy(*keys).applyInPandas(analyze, schema)


def per_entity_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], analyze: Callable, schema) -> DataFrame:
    """Run a user's function on the rows of each entity in order, a frame at a time.

    ``analyze(key, frames)`` gets the key values as a tuple (nulls as None) and an iterator of frames, and yields frames. No frame
    is a whole entity unless it fits one Arrow batch, so an entity may be larger than memory; frames that the function
    does not take are skipped.
    """
    names = list(keys)

    def run(batches):
        def parts():
            for batch in batches:
                number = batch.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
                cuts = [0, *[i for i in range(1, len(number)) if number[i] != number[i - 1]], len(number)]
                for begin, end in zip(cuts, cuts[1:]):
                    part = batch.iloc[begin:end]
                    first = part[names].astype(object).iloc[0]
                    yield tuple(first.where(first.notna(), None)), part.reset_index(drop=True)

        for key, own in groupby((p for p in parts() if len(p[1])), key=lambda p: p[0]):
            yield from analyze(key, (frame for _, frame in own))

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, schema)
