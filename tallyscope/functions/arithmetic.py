"""The ten named arithmetic operations as Column expressions.

Scalar operations take two or three columns of a row, array operations take ARRAY<DOUBLE> columns,
and the ``grouped_*`` functions are aggregates with map-side partial aggregation. A result that the
operation does not define (zero denominator, empty input, negative weight) is null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.functions.numeric import (
    array_total,
    as_column,
    check_precision,
    exact_sum,
    finite_or_null,
    is_finite,
    null_double,
    once,
    round_half_even,
)

# Operation name, result unit, formula text.
OPERATIONS: dict[str, tuple[str, str]] = {
    "sum": ("number", "sum(values)"),
    "difference": ("number", "current - prior"),
    "product": ("number", "product(values)"),
    "ratio": ("ratio", "numerator / denominator"),
    "percent_change": ("ratio", "(current - prior) / prior"),
    "basis_point_change": ("basis_points", "(current - prior) * 10000"),
    "cagr": ("ratio", "(end / start) ** (1 / periods) - 1"),
    "mean": ("number", "sum(values) / count(values)"),
    "median": ("number", "median(values)"),
    "weighted_average": ("number", "sum(value * weight) / sum(weights)"),
}


def difference(current: Column | str, prior: Column | str) -> Column:
    return finite_or_null(as_column(current) - as_column(prior))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    return finite_or_null(F.try_divide(as_column(numerator), as_column(denominator)))


def percent_change(current: Column | str, prior: Column | str) -> Column:
    base = as_column(prior)
    return finite_or_null(F.try_divide(as_column(current) - base, base))


def basis_point_change(current: Column | str, prior: Column | str) -> Column:
    return finite_or_null((as_column(current) - as_column(prior)) * 10000.0)


def cagr(start: Column | str, end: Column | str, periods: Column | str) -> Column:
    first, last, n = as_column(start), as_column(end), as_column(periods)
    defined = (first > 0) & (last > 0) & (n > 0)
    return finite_or_null(F.when(defined, F.pow(last / first, F.lit(1.0) / n) - 1.0))


def _usable(values: Column) -> Column:
    return (F.size(values) > 0) & F.forall(values, is_finite)


def array_sum(values: Column | str) -> Column:
    xs = as_column(values).cast("array<double>")
    return F.when(_usable(xs), array_total(xs))


def array_product(values: Column | str) -> Column:
    xs = as_column(values).cast("array<double>")
    return F.when(_usable(xs), F.aggregate(xs, F.lit(1.0), lambda total, v: total * v, finite_or_null))


def array_mean(values: Column | str) -> Column:
    xs = as_column(values).cast("array<double>")
    return F.try_divide(array_sum(xs), F.size(xs).cast("double"))


def array_median(values: Column | str) -> Column:
    xs = as_column(values).cast("array<double>")
    n = F.size(xs)

    def middle(ordered: Column) -> Column:
        low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
        return (low + F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2.0

    return F.when(_usable(xs), once(F.array_sort(xs), middle))


def array_weighted_average(values: Column | str, weights: Column | str) -> Column:
    xs = as_column(values).cast("array<double>")
    ws = as_column(weights).cast("array<double>")
    ok = _usable(xs) & (F.size(xs) == F.size(ws)) & F.forall(ws, lambda w: is_finite(w) & (w >= 0))
    weighted = array_total(F.zip_with(xs, ws, lambda x, w: x * w))
    return once(F.when(ok, F.try_divide(weighted, array_total(ws))), finite_or_null)


def grouped_sum(value: Column | str) -> Column:
    return exact_sum(value)


def grouped_mean(value: Column | str) -> Column:
    x = as_column(value)
    return F.try_divide(exact_sum(x), F.count(x).cast("double"))


def grouped_product(value: Column | str) -> Column:
    return F.product(as_column(value))


def grouped_median(value: Column | str) -> Column:
    """One aggregate that counts the distinct values of a group in memory; ``ordering.medians`` has no such bound."""
    return F.median(as_column(value))


def grouped_weighted_average(value: Column | str, weight: Column | str) -> Column:
    x, w = as_column(value), as_column(weight)
    return F.when(F.min(w) >= 0, F.try_divide(exact_sum(x * w), exact_sum(w)))


@dataclass(frozen=True)
class Operation:
    """One named calculation; ``inputs`` maps argument names to columns of the row."""

    id: str
    operation: str
    inputs: Mapping[str, Column | str] = field(default_factory=dict)


_ARGUMENTS: dict[str, tuple[str, ...]] = {
    "sum": ("values",),
    "product": ("values",),
    "mean": ("values",),
    "median": ("values",),
    "weighted_average": ("values", "weights"),
    "difference": ("current", "prior"),
    "percent_change": ("current", "prior"),
    "basis_point_change": ("current", "prior"),
    "ratio": ("numerator", "denominator"),
    "cagr": ("start", "end", "periods"),
}
_EVALUATE = {
    "sum": array_sum,
    "product": array_product,
    "mean": array_mean,
    "median": array_median,
    "weighted_average": array_weighted_average,
    "difference": difference,
    "percent_change": percent_change,
    "basis_point_change": basis_point_change,
    "ratio": ratio,
    "cagr": cagr,
}


def _undefined_reason(operation: str, arguments: Sequence[Column]) -> Column:
    absent = F.lit(False)
    for argument in arguments:
        absent = absent | argument.isNull()
    reason = F.when(absent, "missing input")
    if operation in ("ratio", "percent_change"):
        return reason.when(arguments[-1] == 0, "denominator must not be zero")
    if operation == "cagr":
        start, end, periods = arguments
        return reason.when(
            (start <= 0) | (end <= 0), "CAGR requires positive start and end values"
        ).when(periods <= 0, "periods must be greater than zero")
    if operation in ("sum", "product", "mean", "median", "weighted_average"):
        reason = reason.when(F.size(arguments[0]) == 0, "values must not be empty")
    if operation == "weighted_average":
        values, weights = arguments
        return (
            reason.when(F.size(values) != F.size(weights), "values and weights must have equal length")
            .when(F.exists(weights, lambda w: w < 0), "weights must be non-negative")
            .when(array_total(weights.cast("array<double>")) == 0, "weights must sum to more than zero")
        )
    return reason


def calculate(df: DataFrame, keys: Sequence[str], operations: Sequence[Operation], precision: int = 6) -> DataFrame:
    """Long result: one row per input row and operation, with unit, formula and reason."""
    check_precision(precision)
    if not operations:
        raise ValueError("operations must not be empty")
    ids = [op.id.strip() for op in operations]
    if any(not op_id for op_id in ids):
        raise ValueError("operation ids must not be empty")
    if len(set(ids)) != len(ids):
        raise ValueError("operation ids must be unique")
    results = []
    for op_id, op in zip(ids, operations):
        if op.operation not in OPERATIONS:
            raise ValueError(f"unsupported operation: {op.operation}")
        needed = _ARGUMENTS[op.operation]
        if set(op.inputs) != set(needed):
            raise ValueError(f"{op_id}: {op.operation} takes {', '.join(needed)}")
        arguments = [as_column(op.inputs[name]) for name in needed]
        value = _EVALUATE[op.operation](*arguments)
        reason = _undefined_reason(op.operation, arguments)
        unit, formula = OPERATIONS[op.operation]
        results.append(
            F.struct(
                F.lit(op_id).alias("id"),
                F.lit(op.operation).alias("operation"),
                F.when(reason.isNull(), round_half_even(value, precision)).otherwise(null_double()).alias("value"),
                F.lit(unit).alias("unit"),
                F.lit(formula).alias("formula"),
                F.coalesce(reason, F.when(value.isNull(), "result is not finite")).alias("reason"),
            )
        )
    return df.select(*keys, F.explode(F.array(*results)).alias("_result")).select(*keys, "_result.*")
