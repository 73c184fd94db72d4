"""Dataset-level gates: each check is a DataFrame of offending rows; the checks of a gate are one small job."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.functions.text import is_digest


class DataViolation(ValueError):
    """A whole-dataset rule does not hold; nothing was written."""


class Violation(NamedTuple):
    message: str
    rows: DataFrame


def raise_on(*violations: Violation, samples: int = 5) -> None:
    """Raise for the first check that has offending rows, quoting a few of them. All checks run as one job."""
    parts = [
        v.rows.limit(samples).select(F.lit(k).alias("check"), F.to_json(F.struct("*")).alias("row")) for k, v in enumerate(violations)
    ]
    found = reduce(DataFrame.unionByName, parts).collect() if parts else []
    for k, violation in enumerate(violations):
        quoted = ", ".join(row["row"] for row in found if row["check"] == k)
        if quoted:
            raise DataViolation(f"{violation.message}: {quoted}")


def require_count(df: DataFrame, label: str, minimum: int, maximum: int) -> int:
    """Row count between bounds; counting stops one past the maximum."""
    count = df.limit(maximum + 1).count()
    if not minimum <= count <= maximum:
        found = f"more than {maximum}" if count > maximum else str(count)
        raise DataViolation(f"{label} must contain between {minimum} and {maximum} rows, found {found}")
    return count


def digest_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which one of the digest columns is not 64 lower-case hex digits."""
    bad: Column = F.lit(False)
    for name in columns:
        bad = bad | ~is_digest(name)
    return df.where(bad)


CANDIDATE_TEXT = (
    "candidate_id",
    "ticker",
    "company",
    "variant_wedge",
    "why_now",
    "first_rejection",
    "investable_if",
    "kill_if",
    "next_workflow",
)
# The labels a candidate row may carry.
BUCKETS = ("advance", "valuation_gated", "exposure_unproven", "deprioritized")
CONFIDENCES = ("not_assessed", "low", "medium", "high")
DATA_QUALITIES = ("not_assessed", "limited", "partial", "complete")
SOURCE_MODES = ("unspecified", "synthetic", "live", "mixed")


def candidate_problem(df: DataFrame) -> Column:
    """First rule a candidate row breaks, or null. Only rules whose columns exist are checked."""
    present = set(df.columns)
    problem = F.lit(None).cast("string")

    def also(condition: Column, message: str) -> None:
        nonlocal problem
        problem = F.coalesce(problem, F.when(condition, message))

    def blank(text: Column) -> Column:
        return text.isNull() | (F.trim(text) == "")

    for name in CANDIDATE_TEXT:
        if name in present:
            also(blank(F.col(name)), f"candidate {name} must not be empty")
    for name, allowed in (
        ("bucket", BUCKETS),
        ("confidence", CONFIDENCES),
        ("data_quality", DATA_QUALITIES),
        ("source_mode", SOURCE_MODES),
    ):
        if name in present:
            also(F.col(name).isNull() | ~F.col(name).isin(*allowed), f"unknown candidate {name}")
    if "priority_score" in present:
        score = F.col("priority_score")
        also(score.isNull() | ~score.between(0, 100), "priority_score must be between 0 and 100")
    if "as_of" in present:
        also(blank(F.col("as_of").cast("string")), "candidate as_of must not be empty")
    if "evidence_ids" in present:
        ids = F.col("evidence_ids")
        also(F.exists(ids, blank), "candidate evidence IDs must not be empty")
        also(F.size(ids) != F.size(F.array_distinct(ids)), "candidate evidence IDs must be unique")
    if "evidence_gaps" in present:
        also(F.exists("evidence_gaps", blank), "candidate evidence gaps must not be empty")
    if "financials" in present:
        rows = F.col("financials")
        also(
            F.exists(rows, lambda f: blank(f["metric"]) | blank(f["label"]) | blank(f["unit"]) | blank(f["period"])),
            "candidate financial text must not be empty",
        )
        also(
            F.exists(rows, lambda f: f["value"].isNull() | F.isnan(f["value"]) | (F.abs(f["value"]) == float("inf"))),
            "candidate financial value must be finite",
        )
        also(
            F.exists(rows, lambda f: F.size(f["source_ids"]) != F.size(F.array_distinct(f["source_ids"]))),
            "candidate financial source IDs must be unique",
        )
        if "evidence_ids" in present:
            cited = F.array_distinct(F.flatten(F.transform(rows, lambda f: f["source_ids"])))
            also(
                F.size(F.array_except(cited, F.col("evidence_ids"))) > 0,
                "candidate financial sources must be present in evidence IDs",
            )
    return problem


def split_candidates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a ``problem`` column)."""
    checked = df.withColumn("problem", candidate_problem(df))
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")
