"""Number checks and decimal half-even rounding as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MAX_PRECISION = 12
_EXACT = "decimal(38,18)"


def check_precision(precision: int) -> int:
    if isinstance(precision, bool) or not isinstance(precision, int) or not 0 <= precision <= MAX_PRECISION:
        raise ValueError(f"precision must be an integer between 0 and {MAX_PRECISION}")
    return precision


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def null_double() -> Column:
    return F.lit(None).cast("double")


def is_finite(value: Column | str) -> Column:
    """True for a non-null double that is neither NaN nor infinite."""
    x = as_column(value)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(value: Column | str) -> Column:
    x = as_column(value)
    return F.when(is_finite(x), x)


def round_half_even_sql(expression: str, precision: int = 6) -> str:
    """SQL text of :func:`round_half_even` for a DOUBLE expression."""
    rounded = f"cast(bround(try_cast({expression} as {_EXACT}), {precision}) as double)"
    return f"coalesce({rounded}, bround({expression}, {precision})) + 0.0D"


def round_half_even(value: Column | str, precision: int = 6) -> Column:
    """Round the decimal text of a double half to even; minus zero becomes zero.

    Casting a double to DECIMAL goes through its shortest text, so 2.345 rounds to 2.34 and not
    to whatever its binary expansion suggests. Values too wide for 20 integer digits have no
    fractional digits left to round and fall back to rounding the double.
    """
    check_precision(precision)
    if isinstance(value, str):
        return F.expr(round_half_even_sql(f"cast({value} as double)", precision))
    x = value.cast("double")
    rounded = F.bround(x.try_cast(_EXACT), precision).cast("double")
    return F.coalesce(rounded, F.bround(x, precision)) + 0.0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: Spark computes an array expression again wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_finite_sql(expression: str) -> str:
    return f"({expression} is not null and not isnan({expression}) and abs({expression}) < double('infinity'))"


#: Doubles that are decimals of at most six places are counted in millionths, as two long parts.
_PLACES, _MILLION, _LOW_BITS = 1e9, 1e6, 26
#: Other doubles by size: least, bound, and the decimal that keeps all digits of their text and has room for sums. Doubles
#: from 2**53 on are whole numbers.
_BANDS = ((1e-9, 1e8, "decimal(38,18)"), (1e8, 1e16, "decimal(38,9)"), (1e16, 1e33, "decimal(38,0)"))


def exact_sum(value: Column | str) -> Column:
    """Grouped sum of the decimal texts of doubles; does not depend on their order. Null where nothing is added.

    A double that is the nearest one to a number of millionths is added as that whole number, in generated code; its
    text has at most 15 digits, so no other short decimal is meant. Any other double is added as a decimal of its
    band. Only values under 1e-9 and from 1e33 on, and sums that no decimal holds, are added as doubles.
    """
    x = as_column(value).cast("double")
    size = F.abs(x)
    units = F.rint(x * _MILLION)
    short = F.coalesce((size < _PLACES) & (units / _MILLION == x), F.lit(False))
    whole = F.when(short, units.cast("bigint"))
    high, low = F.try_sum(F.shiftright(whole, _LOW_BITS)), F.try_sum(whole.bitwiseAND((1 << _LOW_BITS) - 1))
    inside = [~short & (size >= least) & (size < bound) for least, bound, _ in _BANDS]
    sums = [F.try_sum(F.when(where, x.try_cast(kind))) for where, (_, _, kind) in zip(inside, _BANDS)]
    other = F.sum(F.when(~(short | inside[0] | inside[1] | inside[2]), x))
    overflow = (F.count(whole) > 0) & (high.isNull() | low.isNull())
    for where, total in zip(inside, sums):
        overflow = overflow | ((F.count_if(where) > 0) & total.isNull())
    counted = (high.cast("decimal(19,0)") * F.lit(1 << _LOW_BITS).cast("decimal(8,0)") + low.cast("decimal(19,0)")).cast(
        "decimal(32,0)"
    ) * F.lit("0.000001").cast("decimal(7,6)")
    exact = _added(F.coalesce(counted, F.lit(0).cast("decimal(38,6)")), *[F.coalesce(s, F.lit(0).cast(b[2])) for s, b in zip(sums, _BANDS)])
    total = F.when(overflow, F.sum(x)).otherwise(exact + F.coalesce(other, F.lit(0.0)))
    return F.when(F.count(x) > 0, finite_or_null(total))


def _added(millionths: Column, small: Column, middle: Column, large: Column) -> Column:
    """Exact sums of the bands as one double: one decimal where it has room for all of them."""
    near = F.try_add(millionths.try_cast("decimal(24,6)"), small.try_cast("decimal(36,18)"))
    far = F.try_add(middle.try_cast("decimal(27,9)"), large.try_cast("decimal(18,0)"))
    joined = F.try_add(near.cast("decimal(37,18)"), far.try_cast("decimal(28,9)"))
    parts = [part.cast("double") for part in (large, middle, millionths, small)]
    return F.coalesce(joined.cast("double"), parts[0] + parts[1] + parts[2] + parts[3])


def array_total(values: Column) -> Column:
    """Sum of the decimal texts of the doubles in an array, as :func:`exact_sum`; an array needs no short way."""
    kinds = ("decimal(38,18)", "decimal(38,0)")

    def band(v: Column) -> list[Column]:
        size = F.abs(v)
        small, large = (size >= 1e-9) & (size < 1e16), (size >= 1e16) & (size < 1e33)
        own = [F.when(where, v.try_cast(kind)) for where, kind in zip((small, large), kinds)]
        return [*own, F.when(~(small | large), v)]

    start = F.struct(
        *[F.lit(0).cast(kind).alias(name) for kind, name in zip(kinds, ("small", "large"))], F.lit(0.0).alias("other"), F.lit(0.0).alias("plain")
    )

    def add(sofar: Column, v: Column) -> Column:
        small, large, other = band(v)
        return F.struct(
            F.try_add(sofar["small"], F.coalesce(small, F.lit(0).cast(kinds[0]))).try_cast(kinds[0]).alias("small"),
            F.try_add(sofar["large"], F.coalesce(large, F.lit(0).cast(kinds[1]))).try_cast(kinds[1]).alias("large"),
            (sofar["other"] + F.coalesce(other, F.lit(0.0))).alias("other"),
            (sofar["plain"] + v).alias("plain"),
        )

    def finished(total: Column) -> Column:
        exact = F.try_add(total["small"].try_cast("decimal(37,18)"), total["large"].try_cast("decimal(19,0)"))
        apart = total["small"].cast("double") + total["large"].cast("double")
        return F.coalesce(F.coalesce(exact.cast("double"), apart) + total["other"], total["plain"])

    return once(F.aggregate(values, start, add, finished), finite_or_null)


_FRACTION_BITS = 59


def one_decimal_text(value: Column | str) -> Column:
    """Text with one decimal, rounding the exact binary value (ties to even).

    ``format_string`` rounds the decimal text half up, which differs for values such as 65.35.
    The fraction is scaled to a 59-bit integer, where the rounding digit can be compared exactly.
    """
    x = as_column(value).cast("double")
    size = F.abs(x)
    whole = F.floor(size).cast("bigint")
    scaled = ((size - whole.cast("double")) * float(2**_FRACTION_BITS)).cast("bigint") * 10
    digit = F.shiftright(scaled, _FRACTION_BITS)
    rest = scaled - F.shiftleft(digit, _FRACTION_BITS)
    half = F.lit(2 ** (_FRACTION_BITS - 1))
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    tenths = whole * 10 + digit + up.cast("bigint")
    text = F.concat(
        F.when(x < 0, "-").otherwise(""),
        ((tenths - tenths % 10) / 10).cast("bigint").cast("string"),
        F.lit("."),
        (tenths % 10).cast("string"),
    )
    return F.when(size < 1e15, text).when(size >= 1e15, F.format_string("%.1f", x))
