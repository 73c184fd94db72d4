"""Universe selection and screen bookkeeping over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyscope.operators import funnel as fn
from tallyscope.operators import universe as un
from tallyscope.plans import tables as t
from tallyscope.plans.finance_queries import ORACLES as FINANCE_SQL
from tallyscope.plans.finance_queries import screen_candidates
from tallyscope.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

POLICY = un.UniversePolicy(
    target_size=300,
    minimum_size=100,
    page_size=250,
    minimum_market_cap=300_000_000.0,
    minimum_share_price=1.0,
    minimum_average_daily_volume_3m=200_000.0,
    sec_exchanges=("NYSE", "Nasdaq"),
    market_exchange_codes=("NMS",),
)


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def quotes_and_pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Customers as screener quotes in cap order, cut into pages of 250."""
    volume = t.table(spark, folder, "orders").groupBy("o_custkey").agg(
        (F.count(F.lit(1)) * 50_000.0).alias("average_daily_volume_3m")
    )
    rows = (
        t.table(spark, folder, "customer")
        .join(volume, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "ETF").otherwise("EQUITY").alias("quote_type"),
            F.when(F.col("c_nationkey") < 20, "NMS").otherwise("PNK").alias("exchange"),
            (F.col("c_acctbal") * 1e6).alias("market_cap"),
            (F.col("c_acctbal") / 100.0).alias("share_price"),
            "average_daily_volume_3m",
            F.when(F.col("c_mktsegment") != "BUILDING", "USD").alias("currency"),
        )
    )
    numbered = un.paginate(rows, POLICY)
    page_hash = F.sha2(F.concat(F.lit("page-"), F.col("page_offset").cast("string")), 256)
    quotes = settle(
        numbered.select(
            "*",
            page_hash.alias("content_hash"),
            F.sha2(F.concat(F.lit("request-"), F.col("page_offset").cast("string")), 256).alias("request_hash"),
            F.lit("2025-03-01").cast("timestamp").alias("retrieved_at"),
        )
    )
    total = t.table(spark, folder, "customer").agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    pages = quotes.groupBy("page_offset", "content_hash", "request_hash", "retrieved_at").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return quotes, pages.withColumn("total", total).withColumn("access_mode", F.lit("cache"))


def listed_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Identity map: some customers share a registrant, some are unlisted or unknown."""
    nations = t.table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    return (
        t.table(spark, folder, "customer")
        .where("c_acctbal < 5000 or c_acctbal > 5200")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
            F.lpad((F.col("c_custkey") % 700).cast("string"), 10, "0").alias("cik"),
            F.col("c_name").alias("company"),
            F.when(F.col("n_regionkey") == 0, "OTC").when(F.col("n_regionkey") == 1, "nasdaq").otherwise("NYSE").alias("exchange"),
        )
    )


def selected(spark: SparkSession, folder: str) -> un.Universe:
    quotes, pages = quotes_and_pages(spark, folder)
    return un.select_universe(quotes, pages, listed_identities(spark, folder), POLICY)


_UNIVERSE_SQL = """
volume as (select o_custkey, count(*) * 50000.0::double as volume from orders group by 1),
quotes as (
  select 'T' || c_custkey as ticker, c_custkey, c_name, c_nationkey, c_acctbal * 1e6::double as cap, c_acctbal / 100.0::double as price,
    volume, c_mktsegment, (row_number() over (order by c_acctbal * 1e6::double desc, 'T' || c_custkey) - 1) as n
  from customer left join volume on c_custkey = o_custkey),
paged as (select *, n // 250 * 250 as page_offset from quotes),
screened as (select *,
    case when c_mktsegment = 'HOUSEHOLD' then 'non_equity' when c_nationkey >= 20 then 'market_exchange_outside_policy'
      when volume is null or c_mktsegment = 'BUILDING' then 'incomplete_screen_metrics'
      when cap < 3e8 or price < 1 then 'failed_market_threshold' when volume < 200000 then 'failed_liquidity_threshold' end as reason
  from paged),
identity as (
  select 'T' || c_custkey as ticker, c_custkey % 700 as cik,
    case n_regionkey when 0 then 'OTC' when 1 then 'nasdaq' else 'NYSE' end as sec_exchange
  from customer join nation on c_nationkey = n_nationkey where c_acctbal < 5000 or c_acctbal > 5200),
scope as (
  select s.*, i.cik, i.sec_exchange from screened s left join identity i using (ticker)),
listed as (select *, first_value(ticker) over (partition by cik order by cap desc, ticker) as kept
  from scope where reason is null and cik is not null and sec_exchange <> 'OTC'),
eligible as (select *, row_number() over (order by cap desc, ticker) as rank from listed where ticker = kept),
members as (select * from eligible where rank <= 300),
exclusions as (
  select ticker, reason from scope where reason is not null
  union all select ticker, 'missing_sec_identity' from scope where reason is null and cik is null
  union all select ticker, 'sec_exchange_outside_policy' from scope where reason is null and sec_exchange = 'OTC'
  union all select ticker, 'duplicate_issuer' from listed where ticker <> kept
  union all select ticker, 'below_target_cutoff' from eligible where rank > 300)"""


@query(
    "universe_members",
    f"""with {_UNIVERSE_SQL}
    select cast(rank as integer) as rank, ticker, lpad(cast(cik as varchar), 10, '0') as cik, sec_exchange, cap as market_cap
    from members""",
)
def universe_members(spark: SparkSession, folder: str) -> DataFrame:
    return selected(spark, folder).members.select("rank", "ticker", "cik", "sec_exchange", "market_cap")


@query("universe_exclusions", f"with {_UNIVERSE_SQL} select ticker, reason from exclusions")
def universe_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    return selected(spark, folder).exclusions.select("ticker", "reason")


@query(
    "universe_counts",
    f"""with {_UNIVERSE_SQL},
    c as (select (select count(*) from customer) as total, (select count(*) from screened) as fetched,
      (select count(distinct ticker) from scope where reason is null) as screened, (select count(*) from members) as selected)
    select total as provider_reported_total, cast(fetched as bigint) as fetched_row_count, screened as screened_unique_count,
      selected as selected_count, cast(total - fetched as bigint) as provider_rows_not_inspected,
      case when selected >= 300 then 'target_met' when selected >= 100 then 'minimum_met' else 'insufficient' end as posture
    from c""",
)
def universe_counts(spark: SparkSession, folder: str) -> DataFrame:
    row = un.manifest(selected(spark, folder), "0" * 64, POLICY)
    return row.select(
        "provider_reported_total",
        "fetched_row_count",
        "screened_unique_count",
        "selected_count",
        "provider_rows_not_inspected",
        "posture",
    )


@query(
    "exclusion_counts",
    f'with {_UNIVERSE_SQL} select reason, count(*) as "count" from exclusions group by reason',
)
def exclusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return un.exclusion_counts(selected(spark, folder).exclusions)


@query(
    "universe_rules",
    f"""with {_UNIVERSE_SQL},
    pages as (select count(distinct page_offset) as n from paged),
    broken as (select count(*) as n from members where page_offset % 500 = 0)
    select '{un.CONFLICTING_TOTALS}' as rule, cast(case when n > 1 then 1 else 0 end as bigint) as violations from pages
    union all select '{un.GROWING_COUNTS}', cast(0 as bigint)
    union all select '{un.REPEATED_TICKER}', cast(0 as bigint)
    union all select '{un.BAD_DIGEST}', n from broken union all select '{un.NO_PAGE}', n from broken""",
)
def universe_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Violations counted while a universe is written: every other page has shortened hashes, one another total."""
    quotes, pages = quotes_and_pages(spark, folder)
    cut = F.when(F.col("page_offset") % 500 == 0, F.substring("content_hash", 1, 10)).otherwise(F.col("content_hash"))
    more = F.col("total") + F.when(F.col("page_offset") == 250, 1).otherwise(0)
    universe = un.select_universe(
        quotes.withColumn("content_hash", cut), pages.withColumn("total", more), listed_identities(spark, folder), POLICY
    )
    return spark.createDataFrame(list(universe.found.items()), "rule string, violations bigint")


def _audit(spark: SparkSession, folder: str) -> tuple[un.Universe, DataFrame]:
    """Members against the scores of the whole issuer screen; unknown issuers are failures."""
    universe = selected(spark, folder)
    scores = settle(
        screen_candidates(spark, folder).select(
            F.concat(F.lit("ticker:T"), F.col("entity_id").cast("string")).alias("entity_id"),
            "composite_score",
            F.split("evidence_gaps", "; ").alias("_gaps"),
            "confidence",
        )
    )
    scored = scores.where("confidence = 'high'").select(
        "entity_id",
        "composite_score",
        F.filter("_gaps", lambda g: g != "").alias("evidence_gaps"),
        F.array("entity_id").alias("source_ids"),
    )
    failures = (
        universe.members.join(scored.select("entity_id"), "entity_id", "left_anti")
        .select("ticker", F.lit("sec").alias("provider"), F.lit("facts").alias("phase"), F.lit("low confidence").alias("error"), F.lit(0).alias("ord"))
    )
    shortlist = universe.members.join(scored, "entity_id").select("entity_id")
    return universe, fn.audit_rows(universe.members, scored, fn.failure_text(failures), shortlist)


_AUDIT_SQL = f"""with {_UNIVERSE_SQL},
    scores as (select 'T' || entity_id as ticker, composite_score, evidence_gaps from ({FINANCE_SQL["screen_candidates"]}) where confidence = 'high'),
    joined as (select m.rank, m.ticker, composite_score, evidence_gaps
      from members m left join scores using (ticker)),
    audit as (
      select cast(rank as integer) as universe_rank, ticker, case when composite_score is null then 'failed' else 'screened' end as status,
        cast(round_even(cast(cast(composite_score as varchar) as decimal(38,18)), 0) as integer) as screen_score,
        composite_score is not null as surfaced,
        case when composite_score is null then 'failed' when evidence_gaps = '' then 'complete' else 'partial' end as data_quality,
        case when composite_score is null then 'sec/facts: low confidence' end as failure
      from joined)"""


@query("audit_rows", f"{_AUDIT_SQL} select * from audit")
def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    _, audit = _audit(spark, folder)
    return audit.select("universe_rank", "ticker", "status", "screen_score", "surfaced", "data_quality", "failure")


@query(
    "funnel",
    f"""{_AUDIT_SQL},
    n as (select (select count(*) from customer) as total, (select count(*) from screened) as fetched,
      (select count(distinct ticker) from scope where reason is null) as uniq,
      count(*) as selected, count(*) filter (where status = 'screened') as screened, count(*) filter (where surfaced) as surfaced,
      count(*) filter (where status = 'failed') as failed from audit)
    select total as provider_matches, fetched as inspected, uniq as screened_unique, total - fetched as uninspected, selected,
      selected - failed as eligible, screened, cast(0 as bigint) as deep_reviewed, surfaced, fetched - selected as excluded, failed,
      'cache' as cache_posture from n""",
)
def funnel(spark: SparkSession, folder: str) -> DataFrame:
    universe, audit = _audit(spark, folder)
    return fn.funnel(universe.counts, settle(audit), universe.pages.select("access_mode"))
