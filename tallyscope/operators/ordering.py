"""Positions in an order that no single task could hold.

A window without a partition key, or over one hot group, would run in one task. Both operators here range-partition the
rows by group and order, so a group of any size spreads over as many partitions as it fills, number the rows inside
each partition, and add the totals of the partitions before it. Spark picks the number of partitions from the data
and the session; results are exact wherever the bounds fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyscope.session import settle


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys of which null equals null; the keys of the left side are kept."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_right_{k}")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def _preceding(blocks: DataFrame, keys: Sequence[str], measure: str, out: str) -> DataFrame:
    """Exclusive prefix sum and total over the blocks of each key: one row per block and key."""
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(out, F.coalesce(F.sum(measure).over(before), F.lit(0))).withColumn(
        "_total", F.sum(measure).over(Window.partitionBy(*keys))
    )


def _value_spans(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``_first`` and ``_last`` position of every distinct value in its group, ascending, and the group's ``_total``.

    Rows are counted per distinct value first, so a value shared by a large part of the table is one row afterwards.
    """
    counted = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = settle(counted.repartitionByRange(*group, value).withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("_through", F.sum("_n").over(inside))
    totals = placed.groupBy(*group, "_block").agg(F.sum("_n").alias("_block_n"))
    offsets = _preceding(totals, group, "_block_n", "_before").drop("_block_n")
    last = F.col("_before") + F.col("_through")
    return join_null_safe(running, offsets, [*group, "_block"]).select(
        *group, value, (last - F.col("_n") + 1).alias("_first"), last.alias("_last"), "_total"
    )


def value_ranks(rows: DataFrame, keys: Sequence[str], criterion: str, value: str) -> DataFrame:
    """Tie-aware average rank of every distinct value, ascending, per ``keys`` and ``criterion``.

    Returns keys, criterion, value, ``average_rank`` and ``population``. A null key is a group of its own.
    """
    group = [*keys, criterion]
    return _value_spans(rows, group, value).select(
        *group,
        value,
        ((F.col("_first") + F.col("_last")) / F.lit(2.0)).alias("average_rank"),
        F.col("_total").alias("population"),
    )


def medians(rows: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median of the non-null values of every group, with the number of values (``population``).

    The positions of all distinct values come from their ranges; only the one or two that cover the middle go on. No task
    and no aggregation buffer holds the values of a group.
    """
    spans = _value_spans(rows.where(F.col(value).isNotNull()), keys, value)
    lower, upper = (F.floor((F.col("_total") + k) / 2) for k in (1, 2))
    middle = spans.where(lower.between(F.col("_first"), F.col("_last")) | upper.between(F.col("_first"), F.col("_last")))
    both = (F.min(value) + F.max(value)) / F.lit(2.0)
    return middle.groupBy(*keys).agg(both.alias(out), F.max("_total").alias("population"))


def ordinal(df: DataFrame, order: Sequence[Column], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Append the 1-based position under ``order`` (ascending columns that form a unique key).

    The rows are sorted once into written partitions. A row's number inside its partition is part of its row id, so no
    further shuffle of the rows is needed.
    """
    names = [f"_order{i}" for i in range(len(order))]
    ordered = df.select(*df.columns, *[c.alias(name) for c, name in zip(order, names, strict=True)])
    sorting = [*keys, *names]
    row_id = F.monotonically_increasing_id()
    placed = settle(
        ordered.repartitionByRange(*sorting)
        .sortWithinPartitions(*sorting)
        .drop(*names)
        .withColumn("_row", row_id)
        .withColumn("_block", F.shiftright("_row", 33))
    )
    totals = placed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_block_n"), F.min("_row").alias("_first"))
    offsets = _preceding(totals, list(keys) or [F.lit(0)], "_block_n", "_before")
    numbered = join_null_safe(placed, offsets.select(*keys, "_block", "_before", "_first"), [*keys, "_block"])
    return numbered.withColumn(out, F.col("_before") + F.col("_row") - F.col("_first") + 1).select(*df.columns, out)
