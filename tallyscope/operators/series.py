"""Looking one row back in very long series.

A window over a whole series runs in one task, so one series with a third of all rows would be the
slowest task of the job. Rows are therefore windowed per (series, block), a block being a fixed
span of the order column; the last row of each block is carried to the next block through a table
with one row per block. Keys and order are unique together, which bounds the rows of a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

DAYS_PER_BLOCK = 512
SECONDS_PER_BLOCK = 86_400
STEPS_PER_BLOCK = 65_536


def block_of(df: DataFrame, order: str) -> Column:
    """Fixed-span block of an order column: 512 days, one day of timestamps, or 65,536 steps."""
    kind = df.schema[order].dataType
    column = F.col(order)
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(column) / DAYS_PER_BLOCK)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_seconds(column.cast("timestamp")) / SECONDS_PER_BLOCK)
    if isinstance(kind, T.IntegralType):
        return F.floor(column / STEPS_PER_BLOCK)
    raise ValueError(f"order column {order!r} must be a date, timestamp or integer")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    block: Column | None = None,
    prefix: str = "previous_",
) -> DataFrame:
    """Append ``<prefix><column>`` from the preceding row of the same key; null on a key's first row.

    The block of each row stays in the result as ``_block`` for operators that continue per block.
    """
    placed = df.withColumn("_block", block_of(df, order[0]) if block is None else block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    carried_columns = F.struct(*[F.col(c) for c in columns])
    local = placed.withColumn("_back", F.lag(carried_columns).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    ends = placed.groupBy(*keys, "_block").agg(
        F.max_by(carried_columns, F.struct(*[F.col(c) for c in order])).alias("_end")
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    handed = ends.select(*keys, "_block", F.lag("_end").over(across).alias("_handed"))
    joined = local.join(handed, [*keys, "_block"], "left")
    back = F.coalesce("_back", F.when(F.col("_first"), F.col("_handed")))
    return joined.select(*df.columns, "_block", *[back[c].alias(prefix + c) for c in columns])
