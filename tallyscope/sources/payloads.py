"""Fetched provider payloads: newest per request, freshness and integrity."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tallyscope.functions.text import is_digest, request_hash


class Payloads(NamedTuple):
    """``latest``: newest good payload per request with ``fresh``; ``rejected``: rows with a reason."""

    latest: DataFrame
    rejected: DataFrame


def stamp_payloads(rows: DataFrame) -> DataFrame:
    """Add the request and content digests to rows of provider, operation, identity, parameters, payload."""
    return rows.select(
        "*",
        request_hash("provider", "operation", "identity", "parameters").alias("request_hash"),
        F.sha2("payload", 256).alias("content_hash"),
    )


def latest_payloads(payloads: DataFrame, now: datetime, max_age: timedelta) -> Payloads:
    """Newest payload per request; a stored digest that does not match its content is rejected."""
    if max_age < timedelta(0):
        raise ValueError("max_age must not be negative")
    c = F.col
    reason = (
        F.when(c("request_hash") != request_hash("provider", "operation", "identity", "parameters"), "request hash mismatch")
        .when(~is_digest("content_hash"), "content hash is invalid")
        .when(F.sha2("payload", 256) != c("content_hash"), "content hash mismatch")
    )
    checked = payloads.withColumn("reason", reason)
    kept = [n for n in payloads.columns if n != "request_hash"]
    newest = (
        checked.where("reason is null")
        .groupBy("request_hash")
        .agg(F.max_by(F.struct(*kept), F.struct("fetched_at", "content_hash")).alias("_row"))
        .select("request_hash", "_row.*")
    )
    age = F.lit(now).cast("timestamp") - c("fetched_at")
    limit = F.make_dt_interval(secs=F.lit(max_age.total_seconds()).cast("decimal(18,6)"))
    return Payloads(newest.withColumn("fresh", age <= limit), checked.where("reason is not null"))
