"""Observation, evidence and issue tables: building, bounding and integrity checks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyscope.functions.text import canonical_json, evidence_id, is_digest, observation_id
from tallyscope.operators.quality import Violation, raise_on

OBSERVATION_COLUMNS = (
    "observation_id",
    "entity_id",
    "ticker",
    "name",
    "value",
    "value_text",
    "unit",
    "period",
    "evidence_ids",
    "metadata",
)
EVIDENCE_COLUMNS = (
    "evidence_id",
    "provider",
    "source_kind",
    "source_locator",
    "source_url",
    "observed_at",
    "retrieved_at",
    "content_hash",
)
ISSUE_COLUMNS = ("entity_id", "code", "provider_path", "message", "ord")
# The row that stands for omitted issues.
TRUNCATED_CODE = "issues_truncated"
TRUNCATED_PATH = "$"
TRUNCATED_TEXT = " additional normalization issue(s) omitted"


class Batch(NamedTuple):
    observations: DataFrame
    evidence: DataFrame
    issues: DataFrame


def with_identity(
    rows: DataFrame,
    provider: str,
    source_kind: str,
    locator: dict[str, Column],
    content: dict[str, Column],
    content_hash: Column | None = None,
) -> DataFrame:
    """Append content_hash, source_locator, evidence_id, observation_id.

    ``content`` extends the locator for the content hash; the first 16 hex digits of that hash go
    into the locator, so an evidence id changes whenever any hashed field does. When the caller
    knows the hash of the whole source page it is kept and the locator has no fingerprint.
    """
    if content_hash is None:
        hashed = rows.withColumn("content_hash", F.sha2(canonical_json({**locator, **content}), 256))
        locator = {**locator, "content_fingerprint": F.substring("content_hash", 1, 16)}
    else:
        hashed = rows.withColumn("content_hash", content_hash)
    located = hashed.withColumn("source_locator", canonical_json(locator)).select(
        "*", F.lit(provider).alias("provider"), F.lit(source_kind).alias("source_kind")
    )
    cited = located.withColumn(
        "evidence_id", evidence_id(F.col("provider"), F.col("source_kind"), F.col("source_locator"))
    )
    return cited.select(
        "*",
        observation_id(
            F.col("provider"), F.col("entity_id"), F.col("name"), F.col("period"), F.col("evidence_id")
        ).alias("observation_id"),
        F.array("evidence_id").alias("evidence_ids"),
    )


def observations_of(records: DataFrame) -> DataFrame:
    return records.select(*OBSERVATION_COLUMNS)


def evidence_of(records: DataFrame) -> DataFrame:
    return records.select(*EVIDENCE_COLUMNS)


def bounded_issues(issues: DataFrame, maximum: int | None = None, by: str = "entity_id") -> DataFrame:
    """All issues, or if a maximum is asked for, at most ``maximum`` issues per batch key: the first ones plus one row counting the rest.

    Spark keeps only the first rows of each key below the shuffle, so a key with millions of bad
    records never becomes one task. Totals come from a partial aggregate.
    """
    if maximum is None:
        return issues
    if maximum < 1:
        raise ValueError("maximum must be positive")
    in_order = Window.partitionBy(by).orderBy("ord", "provider_path", "code", "message")
    first = issues.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= maximum)
    totals = issues.groupBy(by).agg(F.count(F.lit(1)).alias("_all"))
    over = totals.where(F.col("_all") > maximum)
    kept = (
        first.join(over, by, "left")
        .where(F.col("_all").isNull() | (F.col("_n") < maximum))
        .select(*issues.columns)
    )
    summary = {
        "code": F.lit(TRUNCATED_CODE),
        "provider_path": F.lit(TRUNCATED_PATH),
        "message": F.concat((F.col("_all") - (maximum - 1)).cast("string"), F.lit(TRUNCATED_TEXT)),
        "ord": F.lit(maximum).cast(issues.schema["ord"].dataType),
    }
    closing = over.select(
        *[summary[c].alias(c) if c in summary else F.col(c) for c in issues.columns]
    )
    return kept.unionByName(closing)


def observation_problem() -> Column:
    """First rule an observation row breaks, or null."""
    c = F.col

    def bad_id(value: Column) -> Column:
        return value.isNull() | (value == "") | (F.trim(value) != value) | (F.length(value) > 200)

    name = F.trim("name")
    ids = c("evidence_ids")
    return (
        F.when(bad_id(c("observation_id")) | bad_id(c("entity_id")), "identifier must be non-empty, unpadded, at most 200 characters")
        .when(name.isNull() | (name == "") | (F.length(name) > 100), "observation name must contain between 1 and 100 characters")
        .when(c("value").isNull() | F.isnan("value") | (F.abs(c("value")) == float("inf")), "observation value must be finite")
        .when((F.size(ids) < 1) | (F.size(ids) > 100), "observations require between 1 and 100 evidence IDs")
        .when(F.size(ids) != F.size(F.array_distinct(ids)), "observation evidence IDs must be unique")
        .when(F.length(F.trim("ticker")) > 32, "ticker must contain between 1 and 32 characters")
        .when(~c("unit.scale").isin("units", "thousands", "millions", "billions"), "unsupported financial unit scale")
        .when((c("period.kind") == "instant") & c("period.start").isNotNull(), "instant periods must not have a start date")
        .when((c("period.kind") == "duration") & c("period.start").isNull(), "duration periods require a start date")
        .when(c("period.start") > c("period.end"), "period start must not be after period end")
    )


def evidence_problem() -> Column:
    kind, url = F.trim("source_kind"), F.trim("source_url")
    return (
        F.when(F.coalesce(kind == "", F.lit(True)) | (F.length(kind) > 80), "source_kind must contain between 1 and 80 characters")
        .when(F.coalesce(url == "", F.lit(True)) | (F.length(url) > 2000), "source_url must contain between 1 and 2000 characters")
        .when(~is_digest("content_hash"), "content_hash must be a SHA-256 digest")
    )


def unresolved_citations(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations of evidence that is not in the table: one row per observation and id."""
    cited = observations.select("observation_id", F.explode("evidence_ids").alias("evidence_id"))
    return cited.join(evidence.select("evidence_id"), "evidence_id", "left_anti")


def repeated_ids(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def check_batch(batch: Batch) -> None:
    """Raise when ids repeat, citations dangle, or a record breaks a row rule."""
    raise_on(
        Violation("observation IDs must be unique within a batch", repeated_ids(batch.observations, "observation_id")),
        Violation("evidence IDs must be unique within a batch", repeated_ids(batch.evidence, "evidence_id")),
        Violation("observations reference evidence absent from the batch", unresolved_citations(batch.observations, batch.evidence)),
        Violation("invalid observation", batch.observations.withColumn("problem", observation_problem()).where("problem is not null").select("observation_id", "problem")),
        Violation("invalid evidence", batch.evidence.withColumn("problem", evidence_problem()).where("problem is not null").select("evidence_id", "problem")),
    )


def combine(*batches: Batch) -> Batch:
    first, *rest = batches
    for other in rest:
        first = Batch(*[a.unionByName(b) for a, b in zip(first, other)])
    return first
