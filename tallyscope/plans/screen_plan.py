"""The whole screen: documents and screen pages to candidates, audit rows and funnel."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.operators.funnel import audit_rows, failure_text, funnel
from tallyscope.operators.ledger import merge
from tallyscope.operators.records import EVIDENCE_COLUMNS, Batch, combine
from tallyscope.operators.screen import (
    SCREEN_METRICS,
    build_candidates,
    evidence_gaps,
    screen_metrics,
    screen_rank,
)
from tallyscope.operators.selection import ordered_sources, select_observations, selected_values
from tallyscope.operators.universe import Universe, UniversePolicy, check_universe, select_universe
from tallyscope.session import settle
from tallyscope.sources.company_facts import normalize_company_facts, rekey_to_ticker
from tallyscope.sources.identity import identity_evidence
from tallyscope.sources.market_data import normalize_members


# The providers of filings and of market values.
FILINGS, MARKET = "sec", "yfinance"


class Screen(NamedTuple):
    """``ledger`` holds all evidence that candidates cite, the identity evidence of the issuers included."""

    universe: Universe
    ledger: Batch
    analyses: DataFrame
    ranked: DataFrame
    candidates: DataFrame
    audit: DataFrame
    funnel: DataFrame


def run_screen(
    documents: DataFrame,
    quotes: DataFrame,
    pages: DataFrame,
    identities: DataFrame,
    mapping_hash: Column,
    policy: UniversePolicy = UniversePolicy(),
    failures: DataFrame | None = None,
    candidate_limit: int | None = None,
) -> Screen:
    """``documents``: company facts (document, retrieved_at); ``identities``: ticker, cik, company, exchange.

    ``failures``: ticker, provider, phase, error, ord of what could not be collected. Without filings an issuer is left
    out of the analysis and its failures show up in its audit row; without market values it stays, with a gap and an
    unproven exposure. The per-issuer analysis table is
    the one settled table of the second half; everything after it works on one row per issuer.
    """
    universe = select_universe(quotes, pages, identities, policy)
    check_universe(universe)
    members = universe.members
    facts = normalize_company_facts(documents)
    known = members.select("ticker", "cik", "company")
    filings = Batch(rekey_to_ticker(facts.observations, known), facts.evidence, facts.issues)
    if failures is None:
        failures = members.where("false").select(
            "ticker", F.lit("").alias("provider"), F.lit("").alias("phase"), F.lit("").alias("error"), F.lit(0).alias("ord")
        )
    without_market = failures.where(F.col("provider") == MARKET).select("ticker").distinct()
    market = normalize_members(members.join(without_market, "ticker", "left_anti"))
    identity_rows = identity_evidence(known, F.current_timestamp(), mapping_hash)
    empty = Batch(*[table.limit(0) for table in filings])
    collected_rows = combine(filings, market)
    evidence = collected_rows.evidence.unionByName(identity_rows.select(*EVIDENCE_COLUMNS))
    merged = merge(empty, collected_rows._replace(evidence=evidence))
    ledger = Batch(*[settle(table) for table in merged])

    removed = failures.where(F.col("provider") == FILINGS).select("ticker").distinct()
    reasons = failure_text(failures.join(removed, "ticker", "left_semi"))
    failed = failures.groupBy("ticker").agg(F.array_sort(F.collect_set("provider")).alias("_failed"))
    selection = select_observations(ledger.observations.join(removed, "ticker", "left_anti"))
    identity = identity_rows.select("ticker", F.col("evidence_id").alias("identity_evidence_id"))
    values = selected_values(selection.selected)
    sources = selection.selected.select("entity_id", ordered_sources(selection.selected).alias("source_ids"))
    measured = (
        screen_metrics(values)
        .join(sources, "entity_id")
        .join(members.select("entity_id", "ticker", "company"), "entity_id")
        .join(identity, "ticker")
        .join(failed, "ticker", "left")
        .withColumn("failed_providers", F.coalesce("_failed", F.array().cast("array<string>")))
        .withColumn("has_market", ~F.array_contains("failed_providers", MARKET))
        .drop("_failed")
    )
    analyses = settle(measured)
    ranked = screen_rank(analyses.select("entity_id", *SCREEN_METRICS), settled=True).ranked
    candidates = settle(build_candidates(analyses, ranked, candidate_limit))
    scored = analyses.select("entity_id", "source_ids", evidence_gaps().alias("evidence_gaps")).join(
        ranked.select("entity_id", "composite_score"), "entity_id"
    )
    audit = settle(
        audit_rows(members, scored, reasons, candidates.select(F.col("candidate_id").alias("entity_id")))
    )
    modes = universe.pages.select("access_mode") if "access_mode" in universe.pages.columns else None
    return Screen(
        universe, ledger, analyses, ranked, candidates, audit, funnel(universe.counts, audit, modes)
    )
