"""Digest of a table in an order, as a hash tree over positions.

Rows are numbered by their order (range partitions, no task holds the table), and ``FAN`` neighbours at a time are hashed
to one until a single digest is left. The tree follows from the positions alone, so it does not depend on how the rows lie
in partitions, and exchanging two rows changes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.operators.ordering import ordinal

FAN = 256


def ordered_digest(df: DataFrame, row_hash: Column, order: Sequence[Column], out: str = "digest") -> DataFrame:
    """One row: SHA-256 of the table's rows in order; of the empty text for an empty table.

    ``row_hash`` is the hex digest of a row. Rows that ``order`` does not tell apart stand by their digest.
    """
    names = [f"_by{i}" for i in range(len(order))]
    hashed = df.select(*[c.alias(name) for c, name in zip(order, names, strict=True)], row_hash.alias("_hash"))
    sorting = [F.col(name) for name in [*names, "_hash"]]
    placed = ordinal(hashed, sorting, "_at").select((F.col("_at") - 1).alias("_at"), "_hash")
    count = placed.count()
    while True:
        group = F.floor(F.col("_at") / FAN)
        members = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_hash"))), lambda m: m["_hash"])
        placed = placed.groupBy(group.alias("_at")).agg(F.sha2(F.concat_ws("", members), 256).alias("_hash"))
        count = -(-count // FAN)
        if count <= 1:
            return placed.agg(F.coalesce(F.max("_hash"), F.sha2(F.lit(""), 256)).alias(out))
