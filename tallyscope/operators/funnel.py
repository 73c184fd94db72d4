"""Coverage gate, audit rows, funnel counts and collection summaries of one screen."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tallyscope.functions.numeric import round_half_even
from tallyscope.operators.digests import ordered_digest
from tallyscope.operators.quality import DataViolation

# Fixed value: failure text when nothing was recorded for an issuer.
NO_PACKET = "trusted SEC evidence packet unavailable"
PROVIDERS = ("sec", "yfinance")
# Candidate fields that are part of a result's fingerprint.
FINGERPRINT_FIELDS = (
    "candidate_id",
    "ticker",
    "company",
    "bucket",
    "priority_score",
    "screen_rank",
    "financials",
    "evidence_ids",
    "as_of",
    "source_mode",
)


def required_screened(selected: int, minimum_count: int, minimum_ratio: float = 0.70) -> int:
    return max(minimum_count, math.ceil(selected * minimum_ratio))


def coverage_gate(selected: DataFrame, screened: DataFrame, minimum_count: int, minimum_ratio: float = 0.70) -> int:
    """Number screened, or raise when too few; write the audit rows before calling this."""
    both = selected.select(F.lit(0).alias("done")).unionByName(screened.select(F.lit(1).alias("done")))
    total, done = both.agg(F.count_if(F.col("done") == 0), F.count_if(F.col("done") == 1)).first()
    needed = required_screened(total, minimum_count, minimum_ratio)
    if done < needed:
        raise DataViolation(f"screened {done} of {total} issuers, at least {needed} required")
    return done


def failure_text(failures: DataFrame) -> DataFrame:
    """``provider/phase: error`` joined per ticker in recorded order (``ord``)."""
    line = F.concat("provider", F.lit("/"), "phase", F.lit(": "), "error")
    collected = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return failures.groupBy("ticker").agg(
        F.concat_ws("; ", F.transform(collected, lambda x: x["line"])).alias("failure")
    )


def audit_rows(
    members: DataFrame,
    screened: DataFrame,
    failures: DataFrame,
    surfaced: DataFrame,
    reviewed: DataFrame | None = None,
) -> DataFrame:
    """One row per selected member, whatever became of it.

    ``screened``: entity_id, composite_score, evidence_gaps, source_ids; ``failures``: ticker,
    failure; ``surfaced`` and ``reviewed``: entity_id. All joins are on the member key, and the
    members are at most the policy's target size.
    """
    c = F.col
    flags = surfaced.select("entity_id").distinct().withColumn("_surfaced", F.lit(True))
    joined = (
        members.join(screened.select("entity_id", "composite_score", "evidence_gaps", "source_ids"), "entity_id", "left")
        .join(failures.select("ticker", "failure"), "ticker", "left")
        .join(flags, "entity_id", "left")
    )
    if reviewed is None:
        joined = joined.withColumn("_reviewed", F.lit(None).cast("boolean"))
    else:
        joined = joined.join(
            reviewed.select("entity_id").distinct().withColumn("_reviewed", F.lit(True)), "entity_id", "left"
        )
    failed = c("failure").isNotNull() | c("composite_score").isNull()
    quality = F.when(failed, "failed").when(F.size("evidence_gaps") == 0, "complete").otherwise("partial")
    return joined.select(
        c("rank").alias("universe_rank"),
        "ticker",
        "company",
        "cik",
        c("sec_exchange").alias("exchange"),
        "market_cap",
        "currency",
        F.when(failed, "failed").otherwise("screened").alias("status"),
        round_half_even("composite_score", 0).cast("int").alias("screen_score"),
        F.coalesce("_reviewed", F.lit(False)).alias("deep_reviewed"),
        F.coalesce("_surfaced", F.lit(False)).alias("surfaced"),
        quality.alias("data_quality"),
        F.when(failed, F.coalesce("failure", F.lit(NO_PACKET))).alias("failure"),
        F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"),
    )


def funnel(counts: DataFrame, audit: DataFrame, access_modes: DataFrame | None = None) -> DataFrame:
    """One row of stage counts. ``counts`` is the universe coverage row.

    ``excluded`` is what was fetched but not selected, not the number of exclusion rows.
    """
    c = F.col
    stages = audit.agg(
        F.count(F.lit(1)).alias("eligible_rows"),
        F.count_if(c("status") == "screened").alias("screened"),
        F.count_if("surfaced").alias("surfaced"),
        F.count_if("deep_reviewed").alias("deep_reviewed"),
        F.count_if(c("status") == "failed").alias("failed"),
    )
    posture = F.lit("unknown")
    if access_modes is not None:
        modes = access_modes.agg(F.array_sort(F.collect_set("access_mode")).alias("m")).scalar()
        only = lambda mode: modes == F.array(F.lit(mode))
        posture = F.when(only("cache"), "cache").when(only("network"), "network").otherwise("mixed")
    staged = counts.withColumn("_s", stages.select(F.struct(*stages.columns).alias("s")).scalar())
    return staged.select("*", "_s.*").select(
        c("provider_reported_total").alias("provider_matches"),
        c("fetched_row_count").alias("inspected"),
        c("screened_unique_count").alias("screened_unique"),
        F.greatest(F.lit(0), c("provider_reported_total") - c("fetched_row_count")).alias("uninspected"),
        c("selected_count").alias("selected"),
        (c("selected_count") - c("failed")).alias("eligible"),
        "screened",
        "deep_reviewed",
        "surfaced",
        F.greatest(F.lit(0), c("fetched_row_count") - c("selected_count")).alias("excluded"),
        "failed",
        posture.alias("cache_posture"),
    )


def collection_rows(requested: DataFrame, issuers: DataFrame) -> DataFrame:
    """Per requested ticker: ready with its counts, or failed."""
    return requested.join(issuers, "ticker", "left").select(
        "ticker",
        F.when(F.col("observation_count").isNotNull(), "ready").otherwise("failed").alias("status"),
        *[c for c in issuers.columns if c != "ticker"],
    )


def collection_summary(rows: DataFrame, statuses: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: requested, ready, failed, partial, and per provider successes and failures.

    ``statuses``: ticker, provider, status of the ready issuers; ``failures``: ticker, provider.
    """
    tagged = (
        rows.select(F.lit("issuer").alias("kind"), F.col("status").alias("a"), F.lit(None).cast("string").alias("b"))
        .unionByName(statuses.select(F.lit("status").alias("kind"), F.col("provider").alias("a"), F.col("status").alias("b")))
        .unionByName(failures.select(F.lit("failure").alias("kind"), F.col("provider").alias("a"), F.lit(None).cast("string").alias("b")))
    )
    c = F.col
    issuer, failure = c("kind") == "issuer", c("kind") == "failure"
    columns = [
        F.count_if(issuer).alias("requested_count"),
        F.count_if(issuer & (c("a") == "ready")).alias("ready_count"),
        F.count_if(issuer & (c("a") == "failed")).alias("failed_count"),
        ((F.count_if(issuer & (c("a") == "failed")) > 0) | (F.count_if(failure) > 0)).alias("partial"),
    ]
    for provider in PROVIDERS:
        ok = (c("kind") == "status") & (c("a") == provider) & (c("b") == "ok")
        columns += [
            F.count_if(ok).alias(f"{provider}_successes"),
            F.count_if(failure & (c("a") == provider)).alias(f"{provider}_failures"),
        ]
    return tagged.agg(*columns)


def binding_problems(selected: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Market values whose currency or page hash is not the one the member was selected with.

    ``selected`` is the flattened selection (``<name>_observation`` structs).
    """
    c = F.col
    market = selected.select(
        "entity_id",
        c("revenue_observation.unit.symbol").alias("revenue_symbol"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("name"), c(f"{n}_observation").alias("obs"))
                    for n in ("market_cap", "share_price")
                ]
            )
        ).alias("m"),
    ).select("entity_id", "revenue_symbol", "m.*")
    bound = market.join(
        members.select("entity_id", "currency", c("content_hash").alias("page_hash")), "entity_id"
    )
    currency = F.when(
        c("obs").isNull() | (c("obs.unit.symbol") != c("revenue_symbol")), "mixed or dropped a same-currency market value"
    ).when(c("obs.unit.symbol") != c("currency"), "market currency is not the member currency")
    wrong = bound.withColumn("problem", currency)
    cited = wrong.where("problem is null").select("entity_id", "name", "page_hash", F.explode("obs.evidence_ids").alias("evidence_id"))
    lost = cited.join(evidence.select("evidence_id", "content_hash"), "evidence_id", "left").where(
        c("content_hash").isNull() | (c("content_hash") != c("page_hash"))
    )
    return (
        wrong.where("problem is not null")
        .select("entity_id", "name", "problem")
        .unionByName(lost.select("entity_id", "name", F.lit("market value lost its page hash").alias("problem")))
    )


def result_fingerprint(manifest: DataFrame, funnel_row: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: ``fingerprint`` of the manifest, the funnel and every candidate.

    Candidates enter in the order of their rank, as a hash tree; the result does not depend on how rows are distributed.
    """
    row = F.sha2(F.to_json(F.struct(*FINGERPRINT_FIELDS), {"ignoreNullFields": "false"}), 256)
    listed = ordered_digest(candidates, row, [F.col("screen_rank")], "h").scalar()
    counts = funnel_row.select(
        F.sha2(F.to_json(F.struct(*sorted(funnel_row.columns)), {"ignoreNullFields": "false"}), 256).alias("h")
    ).scalar()
    return manifest.select(
        F.sha2(F.concat_ws("|", "content_hash", "policy_hash", counts, listed), 256).alias("fingerprint")
    )
