"""Normalization, ledger, packet and annotation queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.functions import text as tx
from tallyscope.functions.numeric import round_half_even
from tallyscope.operators import annotations as an
from tallyscope.operators import ledger as lg
from tallyscope.operators import packets as pk
from tallyscope.operators import records as rc
from tallyscope.operators import selection as sel
from tallyscope.plans import tables as t
from tallyscope.plans.tables import half_even_sql as R
from tallyscope.session import settle, spread
from tallyscope.sources import company_facts as cf
from tallyscope.sources import identity as idn
from tallyscope.sources import market_data as md
from tallyscope.sources import payloads as pay
from tallyscope.sources import screen_pages as sp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_AT = datetime(2025, 3, 1)


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# --- normalization ------------------------------------------------------------------------------


@query(
    "latest_restatement",
    """
    with r as (
      select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_suppkey,
        lpad(cast(l_partkey as varchar), 10, '0') || lpad(cast(cast(round(l_extendedprice * 100) as bigint) as varchar), 12, '0') desc) as n
      from lineitem)
    select cast(l_orderkey as varchar) as entity_id, cast(l_linenumber as varchar) as name,
      strftime(l_shipdate, '%Y-%m-%d') as filed, l_suppkey as priority, l_extendedprice as value
    from r where n = 1""",
)
def latest_restatement(spark: SparkSession, folder: str) -> DataFrame:
    lines = t.table(spark, folder, "lineitem")
    facts = lines.select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.col("l_linenumber").cast("string").alias("name"),
        tx.unit_struct(F.lit("currency"), F.lit("USD")).alias("unit"),
        tx.instant(F.lit("1998-12-31")).alias("period"),
        F.to_date("l_shipdate").alias("filed"),
        F.col("l_suppkey").alias("priority"),
        F.concat(
            F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
            F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0"),
        ).alias("evidence_id"),
        F.col("l_extendedprice").alias("value"),
    )
    return cf.latest_restatements(facts).select("entity_id", "name", _day("filed").alias("filed"), "priority", "value")


@query(
    "restatement_audit",
    """
    with i as (
      select cast(l_suppkey as varchar) as entity_id, 'large_fact' as code,
        'lineitem[' || l_orderkey || ',' || l_linenumber || ',' || l_partkey || ']' as provider_path,
        'quantity ' || cast(l_quantity as integer) as message, l_orderkey * 10 + l_linenumber as ord
      from lineitem where l_quantity > 40)
    select entity_id, code, provider_path, message from i""",
)
def restatement_audit(spark: SparkSession, folder: str) -> DataFrame:
    lines = t.table(spark, folder, "lineitem").where("l_quantity > 40")
    issues = lines.selectExpr(
        "cast(l_suppkey as string) as entity_id",
        "'large_fact' as code",
        "concat('lineitem[', l_orderkey, ',', l_linenumber, ',', l_partkey, ']') as provider_path",
        "concat('quantity ', cast(l_quantity as int)) as message",
        "l_orderkey * 10 + l_linenumber as ord",
    )
    return rc.bounded_issues(issues).drop("ord")


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "customer").select(
        F.concat(F.lit(" c"), F.col("c_custkey")).alias("ticker"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "usd")
        .when(F.col("c_mktsegment") != "HOUSEHOLD", "EUR")
        .alias("currency"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100.0).alias("last_price"),
        (F.col("c_acctbal") * 1000.0).alias("market_cap"),
        F.lit("NMS").alias("exchange"),
        F.lit(_AT).alias("observed_at"),
        F.lit(_AT).alias("retrieved_at"),
    )


@query(
    "unpivot_market",
    """
    with c as (select 'C' || c_custkey as ticker, case when c_mktsegment = 'MACHINERY' then 'USD'
        when c_mktsegment <> 'HOUSEHOLD' then 'EUR' end as symbol, c_acctbal from customer)
    select ticker, 'share_price' as name, c_acctbal / 100.0::double as value, symbol, 'currency_per_share' as kind
      from c where symbol is not null and c_acctbal > 0
    union all select ticker, 'market_cap', c_acctbal * 1000.0::double, symbol, 'currency' from c where symbol is not null""",
)
def unpivot_market(spark: SparkSession, folder: str) -> DataFrame:
    batch = md.normalize_snapshots(_snapshots(spark, folder))
    return batch.observations.select(
        "ticker", "name", "value", F.col("unit.symbol").alias("symbol"), F.col("unit.kind").alias("kind")
    )


@query(
    "snapshot_issues",
    """
    select 'ticker:C' || c_custkey as entity_id, 'missing_currency' as code, 'snapshot.currency' as provider_path
      from customer where c_mktsegment = 'HOUSEHOLD'
    union all select 'ticker:C' || c_custkey, 'missing_value', 'snapshot.last_price'
      from customer where c_mktsegment <> 'HOUSEHOLD' and c_acctbal <= 0""",
)
def snapshot_issues(spark: SparkSession, folder: str) -> DataFrame:
    return md.normalize_snapshots(_snapshots(spark, folder)).issues.select("entity_id", "code", "provider_path")


def _history(spark: SparkSession, folder: str) -> rc.Batch:
    wide = t.table(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("Ticker"),
        F.lit("USD").alias("Currency"),
        F.col("event_id").alias("Row Index"),
        _day("ts").alias("Date"),
        (F.col("value") - 5.0).alias("Close"),
        (F.col("value") * 10.0).alias("Volume"),
        F.when(F.col("event_type") == "signup", 0.0).otherwise(F.col("value")).alias("Dividends"),
    )
    return md.normalize_history(md.standard_history(wide), auto_adjust=False, retrieved_at=_AT)


_HISTORY_SQL = """
    cells as (
      select 'U' || user_id as ticker, strftime(ts, '%Y-%m-%d') as day, event_id, 'close_price' as name, 0 as i,
        value - 5.0::double as value from events
      union all select 'U' || user_id, strftime(ts, '%Y-%m-%d'), event_id, 'volume', 1, value * 10.0::double from events
      union all select 'U' || user_id, strftime(ts, '%Y-%m-%d'), event_id, 'dividends_per_share', 2, value from events
        where event_type <> 'signup' and value <> 0),
    good as (select *, row_number() over (partition by ticker, name, day order by event_id desc) as newest,
        row_number() over (partition by ticker, name, day order by event_id) as oldest
      from cells where (name = 'close_price' and value > 0) or (name <> 'close_price' and value >= 0))"""


@query("price_history", f"with {_HISTORY_SQL} select ticker, name, day, value from good where newest = 1")
def price_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = _history(spark, folder).observations
    return rows.select("ticker", "name", F.col("period.end").cast("string").alias("day"), "value")


@query(
    "price_history_issues",
    f"""with {_HISTORY_SQL},
    i as (
      select 'ticker:' || ticker as entity_id, 'duplicate_history_value' as code, event_id * 100 + i as ord from good where oldest > 1
      union all select 'ticker:' || ticker, 'invalid_value', event_id * 100 + i from cells where name = 'close_price' and value <= 0)
    select entity_id, code, count(*) as issues from i group by 1, 2""",
)
def price_history_issues(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).issues.groupBy("entity_id", "code").agg(F.count(F.lit(1)).alias("issues"))


def _fact_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One company-facts document per order line, built inside the row; the lines are dealt out, not the long documents."""
    lines = spread(
        t.table(spark, folder, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
        )
    )
    return lines.selectExpr(
        """concat('{"cik":', l_orderkey, ',"entityName":"Order","facts":{"us-gaap":{"Revenues":{"units":{"USD":[{"val":',
        cast(l_extendedprice as decimal(12,2)), ',"start":"1995-01-01","end":"', date_add(date'1995-12-30', l_linenumber),
        '","filed":"', date_format(l_shipdate, 'yyyy-MM-dd'), '","form":"',
        case l_returnflag when 'R' then '10-K/A' when 'A' then '10-K' else '8-K' end,
        '","accn":"', l_partkey, '-', l_suppkey, '","fy":1995,"fp":"FY"}]}},',
        '"PaymentsToAcquirePropertyPlantAndEquipment":{"units":{"',
        case when l_quantity > 45 then 'shares' else 'USD' end, '":[{"val":-', cast(l_quantity as int),
        ',"end":"1995-12-31","filed":"', date_format(l_shipdate, 'yyyy-MM-dd'), '"',
        case when l_linenumber = 7 then '' else ',"form":"10-K"' end, ',"accn":"', l_partkey, '"}]}}}}}') as document""",
        "timestamp'2025-03-01' as retrieved_at",
    )


@query(
    "company_facts",
    """
    with f as (
      select 'cik:' || lpad(cast(l_orderkey as varchar), 10, '0') as entity_id, 'revenue' as name,
        cast(date '1995-12-30' + l_linenumber as varchar) as period_end, 'duration' as kind, 'preserve' as sign_policy, l_shipdate from lineitem
        where l_returnflag in ('R', 'A')
      union all select 'cik:' || lpad(cast(l_orderkey as varchar), 10, '0'), 'capital_expenditures', '1995-12-31', 'instant', 'absolute', l_shipdate
        from lineitem where l_quantity <= 45 and l_linenumber <> 7)
    select entity_id, name, period_end, kind, sign_policy, strftime(max(l_shipdate), '%Y-%m-%d') as filing_date
    from f group by 1, 2, 3, 4, 5""",
)
def company_facts(spark: SparkSession, folder: str) -> DataFrame:
    batch = cf.normalize_company_facts(_fact_documents(spark, folder), dealt=True)
    return batch.observations.select(
        "entity_id",
        "name",
        F.col("period.end").cast("string").alias("period_end"),
        F.col("period.kind").alias("kind"),
        F.get_json_object("metadata", "$.sign_policy").alias("sign_policy"),
        F.get_json_object("metadata", "$.filing_date").alias("filing_date"),
    )


@query(
    "company_fact_issues",
    """
    with i as (select 'cik:' || lpad(cast(l_orderkey as varchar), 10, '0') as entity_id,
      case when l_quantity > 45 then 'unsupported_unit' when l_linenumber = 7 then 'missing_form' end as code from lineitem)
    select entity_id, code, count(*) as issues from i where code is not null group by 1, 2""",
)
def company_fact_issues(spark: SparkSession, folder: str) -> DataFrame:
    issues = cf.company_fact_issues(_fact_documents(spark, folder), dealt=True)
    return issues.groupBy("entity_id", "code").agg(F.count(F.lit(1)).alias("issues"))


# One document per customer that holds every known concept once: value customer key + position in the rule table.
_UNIT_OF = {"currency": "USD", "shares": "shares", "currency_per_share": "USD/shares", "ratio": "pure"}


def _concept_documents(spark: SparkSession, folder: str) -> DataFrame:
    taxonomies: dict[str, list[str]] = {}
    for i, (taxonomy, concept, _, kind, _, absolute) in enumerate(cf.RULES):
        sign = "-" if absolute else ""
        taxonomies.setdefault(taxonomy, []).append(
            f"""'"{concept}":{{"label":"L{i}","units":{{"{_UNIT_OF[kind]}":[{{"val":{sign}', c_custkey + {i},"""
            f"""',"start":"2023-01-01","end":"2023-12-31","fy":2023,"fp":"FY","form":"10-K","filed":"2024-02-01","accn":"a-{i}"}}]}}}}'"""
        )
    facts = ", ',', ".join(
        f"""'"{taxonomy}":{{', """ + ", ',', ".join(members) + ", '}'" for taxonomy, members in taxonomies.items()
    )
    return spread(t.table(spark, folder, "customer").select("c_custkey")).selectExpr(
        f"""concat('{{"cik":', c_custkey, ',"facts":{{"other":{{"Unknown":{{}}}},', {facts}, '}}}}') as document""",
        "timestamp'2025-03-01' as retrieved_at",
    )


@query(
    "company_concepts",
    """
    select 'cik:' || lpad(cast(c_custkey as varchar), 10, '0') as entity_id, name, cast(c_custkey + nth as double) as value, kind, symbol,
      concept, label
    from customer, (values
      ('revenue', 0, 'currency', 'USD', 'RevenueFromContractWithCustomerExcludingAssessedTax', 'L0'),
      ('cost_of_revenue', 3, 'currency', 'USD', 'CostOfRevenue', 'L3'),
      ('gross_profit', 6, 'currency', 'USD', 'GrossProfit', 'L6'),
      ('operating_income', 7, 'currency', 'USD', 'OperatingIncomeLoss', 'L7'),
      ('net_income', 8, 'currency', 'USD', 'NetIncomeLoss', 'L8'),
      ('operating_cash_flow', 9, 'currency', 'USD', 'NetCashProvidedByUsedInOperatingActivities', 'L9'),
      ('capital_expenditures', 10, 'currency', 'USD', 'PaymentsToAcquirePropertyPlantAndEquipment', 'L10'),
      ('current_assets', 11, 'currency', 'USD', 'AssetsCurrent', 'L11'),
      ('current_liabilities', 12, 'currency', 'USD', 'LiabilitiesCurrent', 'L12'),
      ('cash_and_equivalents', 13, 'currency', 'USD', 'CashAndCashEquivalentsAtCarryingValue', 'L13'),
      ('total_debt', 14, 'currency', 'USD', 'DebtAndFinanceLeaseObligations', 'L14'),
      ('current_debt', 17, 'currency', 'USD', 'LongTermDebtAndFinanceLeaseObligationsCurrent', 'L17'),
      ('short_term_debt', 19, 'currency', 'USD', 'ShortTermBorrowings', 'L19'),
      ('long_term_debt', 20, 'currency', 'USD', 'LongTermDebtAndFinanceLeaseObligationsNoncurrent', 'L20'),
      ('shareholders_equity', 22, 'currency', 'USD', 'StockholdersEquity', 'L22'),
      ('total_assets', 24, 'currency', 'USD', 'Assets', 'L24'),
      ('accounts_receivable', 25, 'currency', 'USD', 'AccountsReceivableNetCurrent', 'L25'),
      ('inventory', 26, 'currency', 'USD', 'InventoryNet', 'L26'),
      ('accounts_payable', 27, 'currency', 'USD', 'AccountsPayableCurrent', 'L27'),
      ('interest_expense', 28, 'currency', 'USD', 'InterestExpenseNonOperating', 'L28'),
      ('income_tax_expense', 29, 'currency', 'USD', 'IncomeTaxExpenseBenefit', 'L29'),
      ('income_before_tax', 30, 'currency', 'USD', 'IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest', 'L30'),
      ('depreciation_and_amortization', 32, 'currency', 'USD', 'DepreciationDepletionAndAmortization', 'L32'),
      ('diluted_shares_outstanding', 34, 'shares', 'shares', 'WeightedAverageNumberOfDilutedSharesOutstanding', 'L34'),
      ('earnings_per_share', 35, 'currency_per_share', 'USD', 'EarningsPerShareDiluted', 'L35'),
      ('dividends_paid', 36, 'currency', 'USD', 'PaymentsOfDividends', 'L36'),
      ('dividends_per_share', 38, 'currency_per_share', 'USD', 'CommonStockDividendsPerShareDeclared', 'L38'),
      ('effective_tax_rate', 39, 'ratio', 'pure', 'EffectiveIncomeTaxRateContinuingOperations', 'L39'),
      ('preferred_stock', 40, 'currency', 'USD', 'PreferredStocksIncludingAdditionalPaidInCapital', 'L40'),
      ('minority_interest', 41, 'currency', 'USD', 'MinorityInterest', 'L41'),
      ('shares_outstanding', 42, 'shares', 'shares', 'EntityCommonStockSharesOutstanding', 'L42')
    ) as r(name, nth, kind, symbol, concept, label)""",
)
def company_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """All concepts of the rule table in every document; one preferred concept for each name is left."""
    observations = cf.normalize_company_facts(_concept_documents(spark, folder), dealt=True).observations
    return observations.select(
        "entity_id",
        "name",
        "value",
        F.col("unit.kind").alias("kind"),
        F.col("unit.symbol").alias("symbol"),
        F.get_json_object("metadata", "$.concept").alias("concept"),
        F.get_json_object("metadata", "$.label").alias("label"),
    )


# Faults of a company-facts document by customer key: the text that stands for the facts, and the issue it must give.
_GOOD_FACT = '{"val":1,"end":"2023-12-31","filed":"2024-02-01","form":"10-K","accn":"a"}'


def _with_fact(fact: str, unit: str = "USD") -> str:
    return '{"us-gaap":{"Assets":{"units":{"' + unit + '":[' + fact + "]}}}}"


def _changed(old: str, new: str) -> str:
    return _with_fact(_GOOD_FACT.replace(old, new))


_FACT_FAULTS = (
    (_with_fact(_GOOD_FACT), None, None),
    ("[]", "invalid_facts", "facts must be an object"),
    ('{"us-gaap":{"Assets":[]}}', "invalid_concept", "known concept payload must be an object"),
    ('{"us-gaap":{"Assets":{"units":[1,2]}}}', "invalid_units", "units must be an object"),
    ('{"us-gaap":{"Assets":{"label":"x"}}}', "invalid_units", "units must be an object"),
    ('{"us-gaap":{"Assets":{"units":{}}}}', None, None),
    ('{"us-gaap":{"Assets":{"units":{"USD":{"a":1,"b":2}}}}}', "invalid_unit_facts", "unit facts must be an array"),
    ('{"us-gaap":{"Assets":{"units":{"USD":[]}}}}', None, None),
    (_with_fact(_GOOD_FACT, "shares"), "unsupported_unit", "'shares' is not valid for canonical metric total_assets"),
    (_with_fact("7"), "invalid_fact", "fact must be an object"),
    (_changed(',"form":"10-K"', ""), "missing_form", "fact is missing its filing form"),
    (_changed('"10-K"', '"8-K"'), None, None),
    (_changed('"accn":"a"', '"accn":" "'), "missing_accession", "fact is missing its accession number"),
    (_changed("2024-02-01", "2024-02-30"), "invalid_fact", "filed must be an ISO date"),
    (_changed('"end":"2023-12-31"', '"end":20231231'), "invalid_fact", "end must be an ISO date"),
    (_changed('"end"', '"start":"2023","end"'), "invalid_fact", "start must be an ISO date"),
    (_changed('"end"', '"start":"2024-01-01","end"'), "invalid_fact", "period start must not be after period end"),
    (_changed('"end"', '"fy":"x","end"'), "invalid_fact", "fy must be a four-digit year"),
    (_changed('"end"', '"fy":99,"end"'), "invalid_fact", "fiscal_year must be a four-digit year"),
    (_changed('"end"', '"fp":"abcdefghijklmnopq","end"'), "invalid_fact", "fiscal_period must contain between 1 and 16 characters"),
    (_changed('"val":1', '"val":"1"'), "invalid_fact", "val must be a finite JSON number"),
    (_changed('"val":1', '"val":1,"val":2'), "invalid_document", "document is not strict JSON"),
    (_changed('"val":1', '"val":NaN'), "invalid_document", "document is not strict JSON"),
)


def _quoted(value: str | None) -> str:
    return "cast(null as varchar)" if value is None else "'" + value.replace("'", "''") + "'"


@query(
    "fact_faults",
    "with faults as (select * from (values "
    + ", ".join(f"({i}, {_quoted(code)}, {_quoted(message)})" for i, (_, code, message) in enumerate(_FACT_FAULTS))
    + f""") as f(nth, code, message))
    select 'cik:' || lpad(cast(c_custkey as varchar), 10, '0') as entity_id, code, message
    from customer join faults on nth = c_custkey % {len(_FACT_FAULTS)} and code is not null and code <> 'invalid_document'
    union all select null, code, message from customer join faults on nth = c_custkey % {len(_FACT_FAULTS)} and code = 'invalid_document'""",
)
def fact_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with every kind of fault, each of which must give its issue and nothing else."""
    texts = F.array(*[F.lit(text) for text, _, _ in _FACT_FAULTS])
    facts = F.element_at(texts, (F.col("c_custkey") % len(_FACT_FAULTS) + 1).cast("int"))
    raw = t.table(spark, folder, "customer").select(
        F.concat(F.lit('{"cik":'), F.col("c_custkey").cast("string"), F.lit(',"facts":'), facts, F.lit("}")).alias("document"),
        F.expr("timestamp'2025-03-01'").alias("retrieved_at"),
    )
    return cf.company_fact_issues(raw).select("entity_id", "code", "message")


@query(
    "cik_normalize",
    """select c_custkey, lpad(cast(c_custkey as varchar), 10, '0') as cik, cast(null as varchar) as from_name,
      cast(null as varchar) as too_long from customer""",
)
def cik_normalize(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return t.table(spark, folder, "customer").select(
        "c_custkey",
        tx.normalize_cik(F.concat(F.lit(" CIK"), key, F.lit(" "))).alias("cik"),
        tx.normalize_cik("c_name").alias("from_name"),
        tx.normalize_cik(F.concat(F.lit("12345678901"), key)).alias("too_long"),
    )


@query(
    "ticker_normalize",
    """select 'T' || c_nationkey || '.A' as ticker, min(c_custkey) as ord from customer group by 1""",
)
def ticker_normalize(spark: SparkSession, folder: str) -> DataFrame:
    asked = t.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit(" t"), "c_nationkey", F.lit(".a ")).alias("ticker")
    )
    return idn.dedupe_tickers(asked).select("ticker", "ord")


@query(
    "currency_units",
    """
    select n_name, case n_regionkey when 0 then 'currency' when 1 then 'currency_per_share' when 2 then 'shares'
        when 3 then 'ratio' end as kind,
      case n_regionkey when 0 then 'NAT' when 1 then 'NAT' when 2 then 'shares' when 3 then 'pure' end as symbol,
      case when n_regionkey = 0 then 'NAT' end as currency
    from nation""",
)
def currency_units(spark: SparkSession, folder: str) -> DataFrame:
    region = F.col("n_regionkey")
    label = (
        F.when(region == 0, F.substring("n_name", 1, 3))
        .when(region == 1, F.concat(F.lower(F.substring("n_name", 1, 3)), F.lit("/shares")))
        .when(region == 2, " Shares ")
        .when(region == 3, "PURE")
        .otherwise(F.col("n_name"))
    )
    units = t.table(spark, folder, "nation").select("n_name", tx.parse_unit(label).alias("u"), tx.currency_code(label).alias("currency"))
    return units.select("n_name", F.col("u.kind").alias("kind"), F.col("u.symbol").alias("symbol"), "currency")


@query(
    "evidence_ids",
    """
    with l as (select o_orderkey, '{"customer":' || o_custkey || ',"order":' || o_orderkey || '}' as locator from orders)
    select o_orderkey, 'sec:order:' || substr(sha256('{"locator":"' || replace(locator, '"', '\\"') ||
        '","provider":"sec","source_kind":"order"}'), 1, 24) as evidence_id,
      sha256('{"identity":"' || o_orderkey || '","operation":"get","parameters":"{}","provider":"sec"}') as request_hash
    from l""",
)
def evidence_ids(spark: SparkSession, folder: str) -> DataFrame:
    locator = tx.canonical_json({"order": F.col("o_orderkey"), "customer": F.col("o_custkey")})
    return t.table(spark, folder, "orders").select(
        "o_orderkey",
        tx.evidence_id(F.lit("sec"), F.lit("order"), locator).alias("evidence_id"),
        tx.request_hash(F.lit("sec"), F.lit("get"), F.col("o_orderkey").cast("string"), F.lit("{}")).alias("request_hash"),
    )


@query(
    "payload_freshness",
    """
    with p as (select regexp_extract(url, '//([^/]+)/', 1) as host, html, page_id,
        timestamp '2025-03-01' - to_hours(page_id) as fetched_at from pages),
    n as (select *, row_number() over (partition by host order by fetched_at desc) as n from p where page_id % 7 <> 3)
    select host, sha256(html) as content_hash, fetched_at >= timestamp '2025-03-01' - interval 48 hour as fresh
    from n where n = 1""",
)
def payload_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh page loses its text after stamping, so its stored hash no longer matches."""
    rows = t.table(spark, folder, "pages").select(
        F.lit("web").alias("provider"),
        F.lit("get").alias("operation"),
        F.regexp_extract("url", "//([^/]+)/", 1).alias("identity"),
        F.lit("{}").alias("parameters"),
        F.col("html").alias("payload"),
        "page_id",
        (F.lit(_AT).cast("timestamp") - F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("fetched_at"),
    )
    tampered = pay.stamp_payloads(rows).withColumn(
        "payload", F.when(F.col("page_id") % 7 == 3, "lost").otherwise(F.col("payload"))
    )
    latest = pay.latest_payloads(tampered, _AT, timedelta(hours=48)).latest
    return latest.select(F.col("identity").alias("host"), "content_hash", "fresh")


@query(
    "recent_filings",
    """select c_custkey, '10-K' as form, c_name as accession from customer
    union all select c_custkey, '8-K', null from customer""",
)
def recent_filings(spark: SparkSession, folder: str) -> DataFrame:
    submissions = t.table(spark, folder, "customer").select(
        "c_custkey",
        F.struct(
            F.struct(
                F.array(F.lit("10-K"), F.col("c_mktsegment"), F.lit("8-K")).alias("form"),
                F.array("c_name", "c_mktsegment").alias("accession"),
            ).alias("recent")
        ).alias("filings"),
    )
    return idn.recent_filings(submissions).select("c_custkey", "form", "accession")


@query(
    "exchange_map",
    """select 'C' || c_custkey as ticker, lpad(cast(c_custkey as varchar), 10, '0') as cik, c_name as company,
      c_mktsegment as exchange from customer where c_acctbal > 0""",
)
def exchange_map(spark: SparkSession, folder: str) -> DataFrame:
    documents = t.table(spark, folder, "customer").selectExpr(
        """try_parse_json(concat('{"fields":["name","cik","exchange","ticker"],"data":[["', c_name, '",', c_custkey, ',"',
        c_mktsegment, '","c', c_custkey, if(c_acctbal > 0, '', ' bad'), '"],["short"]]}')) as v"""
    )
    return idn.parse_exchange_map(documents)


@query(
    "screen_pages",
    """
    select c_custkey as page_offset, 0 as position, 'C' || c_custkey as ticker, 'EQUITY' as quote_type,
      case when c_acctbal > 0 then c_acctbal end as market_cap, c_acctbal / 100.0::double as share_price from customer
    union all select c_custkey, 1, c_name, null, null, null from customer""",
)
def screen_pages(spark: SparkSession, folder: str) -> DataFrame:
    documents = t.table(spark, folder, "customer").selectExpr(
        "c_custkey as page_offset",
        """concat('{"total":2,"quotes":[{"symbol":"C', c_custkey, '","ticker":"hidden","quoteType":"EQUITY","marketCap":',
        if(c_acctbal > 0, cast(c_acctbal as string), 'null'), ',"intradaymarketcap":5,"regularMarketPrice":{"raw":"', c_acctbal / 100.0D,
        '"}},{"ticker":"', c_name, '","marketCap":true,"price":"n/a"}]}') as document""",
        "sha2('x', 256) as content_hash",
        "sha2('y', 256) as request_hash",
        "timestamp'2025-03-01' as retrieved_at",
        "'cache' as access_mode",
    )
    quotes, _ = sp.parse_pages(documents)
    return quotes.select("page_offset", "position", "ticker", "quote_type", "market_cap", "share_price")


# --- ledger -------------------------------------------------------------------------------------


@query(
    "ledger_ingest_idempotent",
    "select distinct o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus <> 'F'",
)
def ledger_ingest_idempotent(spark: SparkSession, folder: str) -> DataFrame:
    orders = t.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return lg.new_rows(orders.where("o_orderstatus = 'F'"), orders.unionByName(orders), "o_orderkey")


@query(
    "ledger_collisions",
    """
    select id from (select l_orderkey || '-' || l_linenumber as id,
        hash(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as h from lineitem)
    group by id having count(distinct h) > 1""",
)
def ledger_collisions(spark: SparkSession, folder: str) -> DataFrame:
    lines = t.table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_shipdate",
        "l_returnflag",
    )
    old = lines.where("l_returnflag = 'A'").drop("l_returnflag")
    return lg.colliding_ids(old, lines.where("l_returnflag <> 'A'").drop("l_returnflag"), "id")


def _yearly_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly facts in long form, currency by key so that some customers report in two."""
    years = t.yearly_facts(spark, folder)
    names = ("revenue", "net_income", "income_tax_expense")
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
    long = years.select("entity", "fy", F.explode(cells).alias("c")).select("entity", "fy", "c.*")
    symbol = F.when((F.col("fy") == 1995) & (F.col("entity") % 3 == 0), "EUR").otherwise("USD")
    return long.select(
        F.concat_ws("-", "entity", "fy", "name").alias("observation_id"),
        F.col("entity").cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("ticker"),
        "name",
        "value",
        F.col("value").cast("string").alias("value_text"),
        tx.unit_struct(F.lit("currency"), symbol).alias("unit"),
        tx.period_struct(
            F.lit("duration"), F.make_date("fy", F.lit(1), F.lit(1)), F.make_date("fy", F.lit(12), F.lit(31)), F.col("fy"), F.lit("FY")
        ).alias("period"),
        F.array(F.concat_ws(":", F.lit("ev"), "entity", "fy")).alias("evidence_ids"),
        F.lit("{}").alias("metadata"),
    )


@query(
    "ledger_select",
    f"with {t.YEARLY_SQL} select cast(entity as varchar) as entity_id, {R('net_income', 4)} as value from yearly where fy = 1996",
)
def ledger_select(spark: SparkSession, folder: str) -> DataFrame:
    period = tx.period_struct(
        F.lit("duration"), F.lit("1996-01-01"), F.lit("1996-12-31"), F.lit(1996), F.lit("FY")
    )
    chosen = lg.select_observations(_yearly_observations(spark, folder), name="net_income", period=period)
    return chosen.select("entity_id", round_half_even("value", 4).alias("value"))


@query(
    "comparable_revenue",
    f"""with {t.YEARLY_SQL},
    o as (select entity, fy, revenue, net_income, case when fy = 1995 and entity % 3 = 0 then 'EUR' else 'USD' end as symbol from yearly),
    g as (select entity, symbol, max(fy) as latest, count(*) as n, min(fy) as first from o group by 1, 2),
    b as (select entity, arg_min(symbol, [-latest, -n, first]) as symbol from g group by entity),
    r as (select o.*, row_number() over (partition by o.entity order by fy desc) as k from o join b using (entity, symbol))
    select cast(entity as varchar) as entity_id, max(case when k = 1 then symbol end) as symbol,
      max(case when k = 1 then fy end) as fy, max(case when k = 2 then fy end) as prior_fy,
      {R("max(case when k = 1 then net_income end)", 4)} as net_income
    from r where k <= 2 group by entity""",
)
def comparable_revenue(spark: SparkSession, folder: str) -> DataFrame:
    selected = sel.select_observations(_yearly_observations(spark, folder)).selected
    return selected.select(
        "entity_id",
        F.col("revenue.unit.symbol").alias("symbol"),
        F.col("revenue.period.fiscal_year").alias("fy"),
        F.col("prior_revenue.period.fiscal_year").alias("prior_fy"),
        round_half_even(F.col("net_income.value"), 4).alias("net_income"),
    )


@query(
    "ref_integrity",
    """
    select 'label' as side, cast(doc_id as varchar) as id from labels where doc_id not in (select doc_id from documents where lang = 'en')
    union all select 'document', cast(doc_id as varchar) from documents where doc_id not in (select doc_id from labels)""",
)
def ref_integrity(spark: SparkSession, folder: str) -> DataFrame:
    labels = t.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"))
    documents = t.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")

    def citing(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").alias("observation_id"), F.array("id").alias("evidence_ids"))

    def cited(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").alias("evidence_id"))

    one = rc.unresolved_citations(citing(labels), cited(documents.where("lang = 'en'")))
    two = rc.unresolved_citations(citing(documents), cited(labels))
    return one.select(F.lit("label").alias("side"), F.col("evidence_id").alias("id")).unionByName(
        two.select(F.lit("document").alias("side"), F.col("evidence_id").alias("id"))
    )


@query(
    "build_packets",
    """
    with n as (select o_custkey, count(*) as n, string_agg('ev' || lpad(cast(o_orderkey as varchar), 12, '0'), ',' order by o_orderkey) as ids
      from orders group by 1)
    select cast(o_custkey as varchar) as packet_id, n as observation_count, ids as source_ids, cast(null as varchar) as reason
    from n""",
)
def build_packets(spark: SparkSession, folder: str) -> DataFrame:
    orders = t.table(spark, folder, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    observations = orders.select(
        F.concat(F.lit("ob"), key).alias("observation_id"),
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("ticker"),
        F.lit("order_total").alias("name"),
        F.col("o_totalprice").alias("value"),
        F.col("o_totalprice").cast("string").alias("value_text"),
        tx.unit_struct(F.lit("currency"), F.lit("USD")).alias("unit"),
        tx.instant(F.to_date("o_orderdate")).alias("period"),
        F.array(F.concat(F.lit("ev"), key)).alias("evidence_ids"),
        F.lit("{}").alias("metadata"),
    )
    evidence = orders.select(F.concat(F.lit("ev"), key).alias("evidence_id"), F.col("o_orderpriority").alias("source_kind"))
    asked = orders.select(F.col("o_custkey").cast("string").alias("packet_id"), F.concat(F.lit("ob"), key).alias("observation_id"))
    built = pk.build_packets(asked, observations, evidence)
    good = built.packets.select(
        "packet_id",
        F.size("observations").alias("observation_count"),
        F.concat_ws(",", "source_ids").alias("source_ids"),
        F.lit(None).cast("string").alias("reason"),
    )
    bad = built.rejected.select(
        "packet_id",
        F.lit(None).cast("int").alias("observation_count"),
        F.lit(None).cast("string").alias("source_ids"),
        "reason",
    )
    return good.unionByName(bad)


@query(
    "packet_sets",
    """
    select p_partkey, case when p_size < 10 then 'missing ' || p_type when p_size < 20 then 'unreferenced extra'
      when p_size < 30 then 'source_ids do not match the evidence records' end as problem
    from part where p_size < 30""",
)
def packet_sets(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    both = F.array("p_brand", "p_type")
    packets = t.table(spark, folder, "part").select(
        "p_partkey",
        both.alias("referenced"),
        F.when(size < 10, F.array("p_brand"))
        .when(size < 20, F.array(F.lit("extra"), F.col("p_brand"), F.col("p_type")))
        .otherwise(F.array("p_type", "p_brand"))
        .alias("available"),
        F.when(size < 30, F.array("p_brand")).otherwise(F.array_sort(both)).alias("declared"),
    )
    return pk.packet_problems(packets).select("p_partkey", "problem")


@query(
    "compat_check",
    """
    select o_custkey, case when count(distinct case when o_orderstatus <> 'P' then o_orderpriority end) > 1
        then 'observation scales do not match' else 'observation currencies do not match' end as problem
    from orders group by o_custkey
    having count(distinct case when o_orderstatus <> 'P' then o_orderpriority end) > 1
      or count(distinct case when o_orderstatus = 'F' then year(o_orderdate) end) > 1""",
)
def compat_check(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "currency").when(status == "O", "shares").otherwise("ratio")
    rows = t.table(spark, folder, "orders").select(
        "o_custkey",
        F.col("o_custkey").alias("entity_id"),
        tx.unit_struct(kind, F.year("o_orderdate").cast("string"), F.col("o_orderpriority")).alias("unit"),
    )
    return pk.incompatible_groups(rows, ["o_custkey"])


@query(
    "bind_calls",
    """
    with packet as (select 'F' as packet_id, s_suppkey from supplier where s_acctbal > 0
      union all select 'O', s_suppkey from supplier union all select 'P', s_suppkey from supplier where s_nationkey < 10),
    refs as (select o_custkey, o_orderkey, o_orderpriority,
        case when l_tax = 0.0 then 'unbound_numeric_input' when packet.s_suppkey is null then 'observation_not_allowed' end as code
      from lineitem join orders on l_orderkey = o_orderkey
      left join packet on packet.packet_id = o_orderstatus and packet.s_suppkey = l_suppkey),
    codes as (select o_custkey, o_orderkey, code from refs where code is not null
      union all select o_custkey, o_orderkey, 'controller_field_not_allowed' from orders where o_orderpriority = '1-URGENT')
    select cast(o_custkey as varchar) as batch_id, cast(o_orderkey as varchar) as call_id, min(code) as code
    from codes group by 1, 2""",
)
def bind_calls(spark: SparkSession, folder: str) -> DataFrame:
    orders = t.table(spark, folder, "orders")
    calls = orders.select(
        F.col("o_custkey").cast("string").alias("batch_id"),
        F.col("o_orderkey").cast("string").alias("call_id"),
        F.col("o_orderstatus").alias("packet_id"),
        F.lit("calculate").alias("operation"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("context")))
        .otherwise(F.array(F.lit("operations")))
        .alias("supplied"),
    )
    references = t.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("call_id"),
        F.concat(F.lit("values["), "l_linenumber", F.lit("]")).alias("path"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_suppkey").cast("string").alias("observation_id"),
        (F.col("l_tax") != 0.0).alias("is_reference"),
    )
    packets = (
        t.table(spark, folder, "supplier")
        .select(
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(F.col("s_acctbal") > 0, "F"), F.lit("O"), F.when(F.col("s_nationkey") < 10, "P")
                    )
                )
            ).alias("packet_id"),
            F.col("s_suppkey").cast("string").alias("observation_id"),
            F.lit("e").alias("entity_id"),
            F.lit("T").alias("ticker"),
            F.col("s_acctbal").alias("value"),
            tx.unit_struct(F.lit("currency"), F.lit("USD")).alias("unit"),
            tx.instant(F.lit("1995-12-31")).alias("period"),
            F.array(F.col("s_name")).alias("evidence_ids"),
        )
    )
    return pk.bind_observations(calls, references, packets).rejected


@query(
    "annotation_check",
    """
    select doc_id as id, case when length(text) not between 1 and 2000 then 'invalid_diligence_output'
      when source = 'forum' or lang = 'de' then 'invalid_citations'
      when doc_id not in (select doc_id from labels) then 'source_not_allowed' else 'accepted' end as code
    from documents""",
)
def annotation_check(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    twice = (F.col("source") == "forum") | (F.col("lang") == "de")
    outputs = t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.to_json(
            F.struct(
                F.col("text").alias("summary"),
                F.array("source").alias("risks"),
                F.array("lang").alias("questions"),
                F.when(twice, F.array(key, key)).otherwise(F.array(key)).alias("source_ids"),
            )
        ).alias("output_text"),
    )
    allowed = t.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("source_id")
    )
    result = an.validate_annotations(outputs, allowed)
    return result.accepted.select("id", F.lit("accepted").alias("code")).unionByName(result.rejected.select("id", "code"))
