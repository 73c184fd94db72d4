"""Universe selection: screen rows to ranked members, with a reason for every row left out."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.functions.text import canonical_json, is_digest, normalize_ticker
from tallyscope.operators.digests import ordered_digest
from tallyscope.operators.ordering import ordinal
from tallyscope.operators.quality import DataViolation, Violation, digest_rows, raise_on
from tallyscope.session import settle, settle_observed

# Exclusion reason and detail texts.
INVALID_ROW = "invalid_market_row"
NON_EQUITY = "non_equity"
MARKET_EXCHANGE = "market_exchange_outside_policy"
INCOMPLETE = "incomplete_screen_metrics"
FAILED_MARKET = "failed_market_threshold"
FAILED_LIQUIDITY = "failed_liquidity_threshold"
DUPLICATE_ROW = "duplicate_market_row"
MISSING_IDENTITY = "missing_sec_identity"
IDENTITY_EXCHANGE = "sec_exchange_outside_policy"
DUPLICATE_ISSUER = "duplicate_issuer"
BELOW_CUTOFF = "below_target_cutoff"
_DETAIL = {
    INVALID_ROW: "missing or invalid ticker",
    INCOMPLETE: "market cap, price, three-month volume, or currency was missing",
    FAILED_MARKET: "market cap or share price was below policy",
    FAILED_LIQUIDITY: "three-month average volume was below policy",
    DUPLICATE_ROW: "duplicate screener symbol was de-duplicated",
    MISSING_IDENTITY: "ticker was absent from the official SEC exchange map",
    BELOW_CUTOFF: "qualified but ranked below the controller-owned analysis budget",
}
_NOT_AN_OBJECT = "quote row is not an object"

# Rules on a whole universe, in the order in which they are reported.
CONFLICTING_TOTALS = "pages disagree on the total number of rows"
GROWING_COUNTS = "counts must not grow from reported to fetched, screened and selected rows"
REPEATED_TICKER = "a ticker appears on two members"
BAD_DIGEST = "a member digest is not a SHA-256"
NO_PAGE = "a member comes from no given page"
LINEAGE = ["content_hash", "request_hash", "retrieved_at"]


@dataclass(frozen=True)
class UniversePolicy:
    """Thresholds and sizes of one reproducible universe."""

    profile_id: str = "US_LARGE_LIQUID_V1"
    target_size: int = 300
    minimum_size: int = 200
    page_size: int = 250
    max_screened: int | None = None
    minimum_market_cap: float = 300_000_000.0
    minimum_share_price: float = 1.0
    minimum_average_daily_volume_3m: float = 200_000.0
    sec_exchanges: tuple[str, ...] = ("Nasdaq", "NYSE")
    market_exchange_codes: tuple[str, ...] = ("NMS", "NGM", "NCM", "NYQ")

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Z0-9_]{3,64}", self.profile_id):
            raise ValueError("profile_id: 3 to 64 capitals, digits or underscores")
        if not 1 <= self.minimum_size <= self.target_size:
            raise ValueError("minimum_size must be at least 1 and at most target_size")
        if self.max_screened is not None and self.max_screened < self.target_size:
            raise ValueError("max_screened, if set, must reach target_size")
        if self.page_size < 1:
            raise ValueError("pages need at least one row")
        for name in ("minimum_market_cap", "minimum_share_price", "minimum_average_daily_volume_3m"):
            value = getattr(self, name)
            if isinstance(value, bool) or not math.isfinite(value) or value <= 0:
                raise ValueError(f"{name}: a positive, finite threshold is needed")
        for name in ("sec_exchanges", "market_exchange_codes"):
            texts = [v.strip() for v in getattr(self, name)]
            if not texts or any(not t for t in texts):
                raise ValueError(f"{name}: at least one entry, none of them blank")
            if name == "market_exchange_codes":
                texts = [t.upper() for t in texts]
            object.__setattr__(self, name, tuple(dict.fromkeys(texts)))

    def with_sizes(self, **sizes: int) -> UniversePolicy:
        return replace(self, **sizes)

    def as_fields(self) -> dict[str, Column]:
        """The policy as literal columns, for hashing next to the members."""
        fields = {
            name: F.lit(getattr(self, name))
            for name in (
                "profile_id",
                "target_size",
                "minimum_size",
                "page_size",
                "max_screened",
                "minimum_market_cap",
                "minimum_share_price",
                "minimum_average_daily_volume_3m",
            )
        }
        fields["sec_exchanges"] = F.array(*[F.lit(v) for v in self.sec_exchanges])
        fields["market_exchange_codes"] = F.array(*[F.lit(v) for v in self.market_exchange_codes])
        return fields


class Universe(NamedTuple):
    members: DataFrame
    exclusions: DataFrame
    pages: DataFrame
    counts: DataFrame
    found: dict[str, int] | None = None


def provider_screen(rows: DataFrame, policy: UniversePolicy) -> DataFrame:
    """The screen a provider runs before paging: thresholds pushed to the scan, cap order, pages."""
    kept = (
        rows.where(F.col("exchange").isin(*policy.market_exchange_codes))
        .where(F.col("market_cap") >= policy.minimum_market_cap)
        .where(F.col("share_price") >= policy.minimum_share_price)
        .where(F.col("average_daily_volume_3m") >= policy.minimum_average_daily_volume_3m)
    )
    return paginate(kept, policy)


def paginate(rows: DataFrame, policy: UniversePolicy) -> DataFrame:
    """All rows in cap order with ``page_offset`` and ``position``; the first ``max_screened`` if that is set."""
    order = [-F.coalesce("market_cap", F.lit(float("-inf"))), F.col("ticker").isNull(), F.col("ticker")]
    if policy.max_screened is not None:
        rows = rows.orderBy(*order).limit(policy.max_screened)
    numbered = ordinal(rows, order, "_number").withColumn("_number", F.col("_number") - 1)
    offset = (F.floor(F.col("_number") / policy.page_size) * policy.page_size).cast("int")
    return (
        numbered.withColumn("page_offset", offset)
        .withColumn("position", (F.col("_number") - F.col("page_offset")).cast("int"))
        .drop("_number")
    )


def judge_quotes(quotes: DataFrame, policy: UniversePolicy) -> DataFrame:
    """Cleaned quote rows with the first screen rule each one fails (``reason``, ``detail``)."""
    c = F.col
    ticker = normalize_ticker("ticker")
    exchange = F.upper(F.trim("exchange"))
    kind = F.upper(F.trim(F.coalesce(c("quote_type"), F.lit(""))))
    is_object = c("is_object") if "is_object" in quotes.columns else F.lit(True)
    cleaned = quotes.select(
        "page_offset",
        "position",
        ticker.alias("ticker"),
        exchange.alias("market_exchange_code"),
        kind.alias("_kind"),
        is_object.alias("_object"),
        "market_cap",
        "share_price",
        "average_daily_volume_3m",
        F.upper(F.trim("currency")).alias("currency"),
        "content_hash",
        "request_hash",
        "retrieved_at",
    )
    incomplete = (
        c("market_cap").isNull()
        | c("share_price").isNull()
        | c("average_daily_volume_3m").isNull()
        | F.coalesce(c("currency") == "", F.lit(True))
    )
    outside = ~F.coalesce(c("market_exchange_code").isin(*policy.market_exchange_codes), F.lit(False))
    reason = (
        F.when(~c("_object") | c("ticker").isNull(), INVALID_ROW)
        .when(c("_kind") != "EQUITY", NON_EQUITY)
        .when(outside, MARKET_EXCHANGE)
        .when(incomplete, INCOMPLETE)
        .when(
            (c("market_cap") < policy.minimum_market_cap) | (c("share_price") < policy.minimum_share_price),
            FAILED_MARKET,
        )
        .when(c("average_daily_volume_3m") < policy.minimum_average_daily_volume_3m, FAILED_LIQUIDITY)
    )
    shown = F.coalesce(F.when(c("market_exchange_code") != "", c("market_exchange_code")), F.lit("missing"))
    detail = (
        F.when(~c("_object"), _NOT_AN_OBJECT)
        .when(c("reason") == NON_EQUITY, F.concat(F.lit("provider quote type was "), c("_kind")))
        .when(c("reason") == MARKET_EXCHANGE, F.concat(F.lit("provider exchange was "), shown))
    )
    for name, text in _DETAIL.items():
        detail = detail.when(c("reason") == name, text)
    judged = cleaned.withColumn("reason", reason).withColumn("detail", detail)
    return judged.withColumn("ticker", F.coalesce("ticker", F.lit("UNKNOWN"))).drop("_kind", "_object")


def judge_issuers(rows: DataFrame, identities: DataFrame, policy: UniversePolicy) -> DataFrame:
    """Join verdicts of usable rows: best row per ticker, known identity on an allowed exchange,
    best ticker per issuer. Adds identity columns, ``reason`` and ``detail``.

    Winners are maxima with partial aggregation, so a ticker or issuer that repeats in a large part
    of the rows is reduced before the shuffle; the row key that finds the winner again is unique.
    """
    c = F.col
    winners = rows.groupBy("ticker").agg(
        F.max_by(
            F.struct("page_offset", "position"),
            F.struct("market_cap", "content_hash", -c("page_offset"), -c("position")),
        ).alias("_w")
    ).select("_w.*", F.lit(True).alias("_best"))
    named = rows.drop("reason", "detail").join(winners, ["page_offset", "position"], "left").join(
        identities.select("ticker", "cik", "company", c("exchange").alias("sec_exchange")), "ticker", "left"
    )
    allowed = F.lower("sec_exchange").isin(*[e.lower() for e in policy.sec_exchanges])
    reason = (
        F.when(c("_best").isNull(), DUPLICATE_ROW)
        .when(c("cik").isNull(), MISSING_IDENTITY)
        .when(~allowed, IDENTITY_EXCHANGE)
    )
    flagged = settle(named.withColumn("reason", reason).drop("_best"))
    keepers = (
        flagged.where("reason is null")
        .groupBy("cik")
        .agg(F.min_by("ticker", F.struct(-c("market_cap"), c("ticker"))).alias("_kept"))
    )
    judged = flagged.join(keepers, "cik", "left")
    final = F.coalesce("reason", F.when(c("ticker") != c("_kept"), DUPLICATE_ISSUER))
    detail = (
        F.when(c("reason") == IDENTITY_EXCHANGE, F.concat(F.lit("official SEC exchange was "), c("sec_exchange")))
        .when(
            c("reason") == DUPLICATE_ISSUER,
            F.concat(F.lit("same verified SEC CIK as higher-ranked share class "), c("_kept")),
        )
        .when(c("reason") == DUPLICATE_ROW, _DETAIL[DUPLICATE_ROW])
        .when(c("reason") == MISSING_IDENTITY, _DETAIL[MISSING_IDENTITY])
    )
    return judged.withColumn("reason", final).withColumn("detail", detail).drop("_kept")


MEMBER_COLUMNS = (
    "rank",
    "entity_id",
    "ticker",
    "cik",
    "company",
    "sec_exchange",
    "market_exchange_code",
    "market_cap",
    "share_price",
    "average_daily_volume_3m",
    "currency",
    "content_hash",
    "request_hash",
    "retrieved_at",
)


def cut_to_target(eligible: DataFrame, policy: UniversePolicy) -> tuple[DataFrame, DataFrame]:
    """Largest issuers up to the target, ranked; the rest as exclusions. The members are to be settled by the caller."""
    ranked = ordinal(eligible, [-F.col("market_cap"), F.col("ticker")], "rank")
    members = (
        ranked.where(F.col("rank") <= policy.target_size)
        .withColumn("rank", F.col("rank").cast("int"))
        .withColumn("entity_id", F.concat(F.lit("ticker:"), F.col("ticker")))
        .select(*MEMBER_COLUMNS)
    )
    below = ranked.where(F.col("rank") > policy.target_size).select(
        "ticker", F.lit(BELOW_CUTOFF).alias("reason"), F.lit(_DETAIL[BELOW_CUTOFF]).alias("detail")
    )
    return members, below


def select_universe(
    quotes: DataFrame, pages: DataFrame, identities: DataFrame, policy: UniversePolicy = UniversePolicy()
) -> Universe:
    """Full selection from screener quotes.

    ``pages`` has one row per page: page_offset, total, row_count and lineage columns; ``quotes`` has page_offset and
    position, which are lineage only. Every quote becomes a member or gets a reason in two passes (screen, then joins);
    the first is settled because members, exclusions and counts all read it.
    """
    judged = settle(judge_quotes(quotes, policy))
    rows = judged.where("reason is null")
    issuers = judge_issuers(rows, identities, policy)
    chosen, below = cut_to_target(issuers.where("reason is null"), policy)
    members, found = _settle_members(chosen, pages)
    shown = ["ticker", "reason", "detail"]
    exclusions = (
        judged.where("reason is not null")
        .select(*shown)
        .unionByName(issuers.where("reason is not null").select(*shown))
        .unionByName(below)
    )
    counts, uneven = _settle_counts(coverage_counts(members, rows, pages), pages)
    return Universe(members, exclusions, pages, counts, {**uneven, **found})


def _settle_members(members: DataFrame, pages: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Members as a table, and how many of them break a rule. They are at most the target size, so the flags are cheap."""
    known = pages.select(*LINEAGE, F.lit(True).alias("_known")).distinct()
    copies = members.groupBy("ticker").agg(F.count(F.lit(1)).alias("_copies"))
    flagged = members.join(known, LINEAGE, "left").join(copies, "ticker")
    settled, found = settle_observed(
        flagged,
        MEMBER_COLUMNS,
        repeated=F.count_if(F.col("_copies") > 1),
        malformed=F.count_if(~is_digest("content_hash") | ~is_digest("request_hash")),
        lost=F.count_if(F.col("_known").isNull()),
    )
    rules = {REPEATED_TICKER: "repeated", BAD_DIGEST: "malformed", NO_PAGE: "lost"}
    return settled, {message: found[name] or 0 for message, name in rules.items()}


def _settle_counts(counts: DataFrame, pages: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    totals = pages.agg((F.min("total") != F.max("total")).alias("differ")).scalar()
    settled, found = settle_observed(
        counts.withColumn("_differ", totals), counts.columns, differ=F.count_if("_differ"), growing=F.count_if(_growing())
    )
    return settled, {CONFLICTING_TOTALS: found["differ"] or 0, GROWING_COUNTS: found["growing"] or 0}


def _as_one_row(spark_rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return spark_rows.agg(
        *[F.coalesce(F.max(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    )


def coverage_counts(members: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: provider_reported_total, fetched_row_count, screened_unique_count, selected_count."""

    def labelled(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("long").alias("n")).select(F.lit(name).alias("name"), "n")

    parts = (
        labelled(pages, "provider_reported_total", F.max("total"))
        .unionByName(labelled(pages, "fetched_row_count", F.sum("row_count")))
        .unionByName(labelled(rows, "screened_unique_count", F.count_distinct("ticker")))
        .unionByName(labelled(members, "selected_count", F.count(F.lit(1))))
    )
    return _as_one_row(
        parts, ["provider_reported_total", "fetched_row_count", "screened_unique_count", "selected_count"]
    )


def exclusion_counts(exclusions: DataFrame) -> DataFrame:
    return exclusions.groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


def exclusion_samples(exclusions: DataFrame, limit: int | None = None) -> DataFrame:
    """Exclusions by reason, ticker and detail, for a report; the first ``limit`` of them if that is set."""
    ordered = exclusions.orderBy("reason", "ticker", "detail")
    return ordered if limit is None else ordered.limit(limit)


def posture(selected: Column, policy: UniversePolicy) -> Column:
    return (
        F.when(selected >= policy.target_size, "target_met")
        .when(selected >= policy.minimum_size, "minimum_met")
        .otherwise("insufficient")
    )


def manifest(universe: Universe, identity_hash: Column | str, policy: UniversePolicy) -> DataFrame:
    """One row: coverage counts, posture, not-inspected rows, policy hash, content hash and id.

    Members, exclusions and pages enter the content hash in order, as hash trees.
    """
    member_print = F.sha2(F.to_json(F.struct(*MEMBER_COLUMNS), {"ignoreNullFields": "false"}), 256)
    excluded = F.sha2(F.concat_ws("\u0001", "reason", "ticker", "detail"), 256)
    page = F.sha2(F.to_json(F.struct("page_offset", "content_hash", "request_hash")), 256)
    members_hash, excluded_hash, pages_hash = (
        ordered_digest(rows, row, [F.col(name) for name in order], "h").scalar()
        for rows, row, order in (
            (universe.members, member_print, ["rank"]),
            (universe.exclusions, excluded, ["reason", "ticker", "detail"]),
            (universe.pages, page, ["page_offset"]),
        )
    )
    identity = F.lit(identity_hash) if isinstance(identity_hash, str) else identity_hash
    c = F.col
    counts = universe.counts.select(
        "*",
        posture(c("selected_count"), policy).alias("posture"),
        F.greatest(F.lit(0), c("provider_reported_total") - c("fetched_row_count")).alias("provider_rows_not_inspected"),
        (c("selected_count") / F.lit(float(policy.target_size))).alias("target_coverage"),
        F.sha2(canonical_json(policy.as_fields()), 256).alias("policy_hash"),
        members_hash.alias("_members"),
        excluded_hash.alias("_excluded"),
        pages_hash.alias("_pages"),
    )
    content = F.sha2(
        F.concat_ws(
            "|",
            "policy_hash",
            "_members",
            "_excluded",
            "_pages",
            identity,
            "provider_reported_total",
            "screened_unique_count",
            "fetched_row_count",
        ),
        256,
    )
    hashed = counts.withColumn("content_hash", content).drop("_members", "_excluded", "_pages")
    return hashed.withColumn("manifest_id", F.concat(F.lit("universe-"), F.substring("content_hash", 1, 16)))


def _growing() -> Column:
    c = F.col
    return (
        (c("selected_count") > c("screened_unique_count"))
        | (c("screened_unique_count") > c("fetched_row_count"))
        | (c("fetched_row_count") > c("provider_reported_total"))
    )


def check_universe(universe: Universe) -> None:
    """Raise when totals conflict, coverage is inconsistent, or members lost their page lineage.

    ``select_universe`` counts offending rows while it writes members and counts, so no job is started for its result. A
    universe from elsewhere (``found`` is None) is examined here.
    """
    if universe.found is not None:
        for message, rows in universe.found.items():
            if rows:
                raise DataViolation(f"{message}: {rows} rows")
        return
    lost = universe.members.join(universe.pages.select(*LINEAGE).distinct(), LINEAGE, "left_anti")
    raise_on(
        Violation(CONFLICTING_TOTALS, universe.pages.agg(F.count_distinct("total").alias("totals")).where("totals > 1")),
        Violation(GROWING_COUNTS, universe.counts.where(_growing())),
        Violation(REPEATED_TICKER, universe.members.groupBy("ticker").count().where("count > 1")),
        Violation(BAD_DIGEST, digest_rows(universe.members, ["content_hash", "request_hash"])),
        Violation(NO_PAGE, lost),
    )


class CoverageError(DataViolation):
    """Fewer members than the policy's minimum; carries the one-row manifest."""

    def __init__(self, row: dict) -> None:
        self.manifest = row
        super().__init__(f"universe has {row['selected_count']} members, posture {row['posture']}")


def require_minimum(manifest_row: DataFrame) -> dict:
    """Return the one-row manifest, or raise with it when the posture is insufficient."""
    row = manifest_row.first().asDict()
    if row["posture"] == "insufficient":
        raise CoverageError(row)
    return row
