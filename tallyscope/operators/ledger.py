"""Append-only ledger of observations, evidence and issues on Parquet."""

from __future__ import annotations

import os
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.operators.packets import ledger_order
from tallyscope.operators.quality import DataViolation, Violation, raise_on
from tallyscope.operators.records import Batch, check_batch

SCHEMA_VERSION = 1
ISSUE_KEY = ("entity_id", "code", "provider_path", "message")


class LedgerCollision(DataViolation):
    """A stable id came back with different content; nothing was added."""


class Ingest(NamedTuple):
    """New rows of a batch, and the ids whose content collides."""

    observations: DataFrame
    evidence: DataFrame
    issues: DataFrame
    collisions: DataFrame


def fingerprint(df: DataFrame) -> Column:
    """Digest of a whole row, columns in name order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def distinct_by_id(df: DataFrame, column: str) -> DataFrame:
    """One row per id. Rows of one id are equal or the batch is refused, so any of them will do."""
    kept = [c for c in df.columns if c != column]
    return df.groupBy(column).agg(F.any_value(F.struct(*kept)).alias("_row")).select(column, "_row.*")


def new_rows(existing: DataFrame, incoming: DataFrame, column: str) -> DataFrame:
    return distinct_by_id(incoming, column).join(existing.select(column), column, "left_anti").select(*incoming.columns)


def colliding_ids(existing: DataFrame, incoming: DataFrame, column: str) -> DataFrame:
    """Ids that have more than one content across the ledger and the batch: one aggregate, no join."""
    both = existing.select(column, fingerprint(existing).alias("_print")).unionByName(
        incoming.select(column, fingerprint(incoming).alias("_print"))
    )
    return both.groupBy(column).agg(F.min("_print").alias("_low"), F.max("_print").alias("_high")).where(
        "_low <> _high"
    ).select(column)


def plan_ingest(ledger: Batch, batch: Batch) -> Ingest:
    """Idempotent union: equal ids are no-ops, unequal ids are collisions (evidence, then observations)."""
    collisions = colliding_ids(ledger.evidence, batch.evidence, "evidence_id").select(
        F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id")
    ).unionByName(
        colliding_ids(ledger.observations, batch.observations, "observation_id").select(
            F.lit("observation").alias("kind"), F.col("observation_id").alias("id")
        )
    )
    known = ledger.issues.select(*[F.col(k).alias(f"_known_{k}") for k in ISSUE_KEY])
    same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in ISSUE_KEY]
    issues = batch.issues.dropDuplicates([*ISSUE_KEY]).join(known, reduce(lambda a, b: a & b, same), "left_anti")
    return Ingest(
        new_rows(ledger.observations, batch.observations, "observation_id"),
        new_rows(ledger.evidence, batch.evidence, "evidence_id"),
        issues.select(*batch.issues.columns),
        collisions,
    )


def merge(ledger: Batch, batch: Batch) -> Batch:
    """In-memory form of :func:`ingest`: raise on a collision, else the union."""
    check_batch(batch)
    step = plan_ingest(ledger, batch)
    _refuse(step.collisions)
    return Batch(
        ledger.observations.unionByName(step.observations),
        ledger.evidence.unionByName(step.evidence),
        ledger.issues.unionByName(step.issues),
    )


def _refuse(collisions: DataFrame) -> None:
    found = collisions.orderBy("kind", "id").take(5)
    if found:
        listed = ", ".join(f"{r['kind']} {r['id']}" for r in found)
        raise LedgerCollision(f"ID collision: {listed}")


def _tables(path: str) -> dict[str, str]:
    return {name: os.path.join(path, name) for name in ("observations", "evidence", "issues")}


def create_ledger(batch: Batch, path: str) -> None:
    """Write a new ledger; observations are partitioned by name, the column every lookup filters on.

    Rows are clustered by name first, so a write does not open one file per name in every task;
    the entity hash splits a name that holds a large part of the table.
    """
    check_batch(batch)
    _write(batch, path, "errorifexists")


def _write(batch: Batch, path: str, mode: str) -> None:
    where = _tables(path)
    version = F.lit(SCHEMA_VERSION).alias("schema_version")
    spread = F.pmod(F.xxhash64("entity_id"), F.lit(64))
    batch.evidence.select("*", version).write.mode(mode).parquet(where["evidence"])
    batch.observations.select("*", version).repartition(F.col("name"), spread).write.partitionBy("name").mode(
        mode
    ).parquet(where["observations"])
    batch.issues.select("*", version).write.mode(mode).parquet(where["issues"])


def read_ledger(spark: SparkSession, path: str) -> Batch:
    """Reload a ledger; another schema version is refused."""
    tables = {name: spark.read.parquet(folder) for name, folder in _tables(path).items()}
    raise_on(
        *[
            Violation("unsupported observation ledger schema_version", df.where(F.col("schema_version") != SCHEMA_VERSION).select("schema_version"))
            for df in tables.values()
        ]
    )
    return Batch(*[tables[n].drop("schema_version") for n in ("observations", "evidence", "issues")])


def ingest(spark: SparkSession, path: str, batch: Batch) -> None:
    """Append a batch to a stored ledger after checking it; a second identical call adds nothing.

    A single writer is assumed: there is no table format here that could arbitrate two.
    """
    check_batch(batch)
    step = plan_ingest(read_ledger(spark, path), batch)
    _refuse(step.collisions)
    _write(Batch(step.observations, step.evidence, step.issues), path, "append")


def select_observations(
    observations: DataFrame, entity_id: str | None = None, name: str | None = None, period: Column | None = None
) -> DataFrame:
    """Exact entity/name series, or one exact period, in canonical order."""
    chosen = observations
    if name is not None:
        chosen = chosen.where(F.col("name") == name)
    if entity_id is not None:
        chosen = chosen.where(F.col("entity_id") == entity_id)
    if period is not None:
        chosen = chosen.where(F.col("period").eqNullSafe(period))
    return chosen.orderBy(*ledger_order())


def resolve_evidence(requested: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved rows in requested order, problems) for (request_id, pos, evidence_id) rows.

    A request with an unknown or repeated id is listed in problems.
    """
    known = evidence.withColumn("_known", F.lit(True))
    joined = requested.join(known, "evidence_id", "left")
    unknown = joined.where("_known is null").select("request_id", "evidence_id", F.lit("unknown evidence ID").alias("problem"))
    repeated = (
        requested.groupBy("request_id", "evidence_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("request_id", "evidence_id", F.lit("duplicate evidence ID").alias("problem"))
    )
    return joined.where("_known is not null").drop("_known"), unknown.unionByName(repeated)
