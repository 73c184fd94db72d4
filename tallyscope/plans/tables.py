"""Financial views of the driver's star-schema tables, so that operators can run on them.

Each view has a twin in SQL (``*_SQL``), used by the oracle of every query that starts from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyscope.operators.ordering import ordinal
from tallyscope.session import parts_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(column: Column | str) -> Column:
    """A two-decimal amount as a whole number: sums of longs are exact and stay in generated code."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value * 100.0).cast("bigint")


def yearly_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Statement facts per customer and year; sums are exact, hence independent of row order.

    The lines are dealt out by order into parts of about one size, whose number grows with the input: sorting and summing
    them takes a task the memory of its part, however large the table is.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy")
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    price = _cents("l_extendedprice")
    summed = (
        lines.repartition(parts_of(lines), "l_orderkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("entity", "fy")
        .agg(
            (F.sum(price * (100 - _cents("l_discount"))) / 10000.0).alias("revenue"),
            (F.sum(_cents("l_quantity") * _cents("p_retailprice")) / 10000.0).alias("cost_of_revenue"),
            (F.sum(price * _cents("l_tax")) / 10000.0).alias("income_tax_expense"),
        )
    )
    return summed.withColumn("net_income", F.col("revenue") - F.lit(0.6) * F.col("cost_of_revenue"))


YEARLY_SQL = """
facts as (
  select o_custkey as entity, year(o_orderdate) as fy,
    cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as revenue,
    cast(sum(cast(l_quantity as decimal(12,2)) * cast(p_retailprice as decimal(12,2))) as double) as cost_of_revenue,
    cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2))) as double) as income_tax_expense
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  group by 1, 2),
yearly as (select *, revenue - 0.6 * cost_of_revenue as net_income from facts)"""

_YEAR_FACTS = ("revenue", "cost_of_revenue", "net_income")


def issuer_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Latest and previous year per customer, with a market value where the balance is positive.

    After the yearly aggregation a customer has one row per calendar year, so the two-row pick is
    over a handful of rows.
    """
    recent = Window.partitionBy("entity").orderBy(F.col("fy").desc())
    years = yearly_facts(spark, folder).withColumn("_n", F.row_number().over(recent)).where("_n <= 2")
    now, before = F.col("_n") == 1, F.col("_n") == 2
    wide = years.groupBy("entity").agg(
        F.max(F.when(now, F.col("fy"))).alias("fy"),
        F.max(F.when(before, F.col("fy"))).alias("prior_fy"),
        *[F.max(F.when(now, F.col(n))).alias(n) for n in (*_YEAR_FACTS, "income_tax_expense")],
        *[F.max(F.when(before, F.col(n))).alias(f"prior_{n}") for n in _YEAR_FACTS],
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 1000.0).alias("market_cap"),
    )
    return wide.join(customers, "entity")


ISSUER_SQL = (
    YEARLY_SQL
    + """,
numbered as (select *, row_number() over (partition by entity order by fy desc) as n from yearly),
wide as (
  select entity,
    max(case when n = 1 then fy end) as fy, max(case when n = 2 then fy end) as prior_fy,
    max(case when n = 1 then revenue end) as revenue,
    max(case when n = 1 then cost_of_revenue end) as cost_of_revenue,
    max(case when n = 1 then net_income end) as net_income,
    max(case when n = 1 then income_tax_expense end) as income_tax_expense,
    max(case when n = 2 then revenue end) as prior_revenue,
    max(case when n = 2 then cost_of_revenue end) as prior_cost_of_revenue,
    max(case when n = 2 then net_income end) as prior_net_income
  from numbered where n <= 2 group by entity),
issuers as (
  select wide.*, c_nationkey as nation, case when c_acctbal > 0 then c_acctbal * 1000.0::double end as market_cap
  from wide join customer on entity = c_custkey)"""
)


def statement_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Issuer facts widened to a full statement; some customers lack some facts or have zeros."""
    c = F.col
    key = c("entity")
    return issuer_facts(spark, folder).select(
        "*",
        (c("revenue") - c("cost_of_revenue") * 0.7).alias("operating_income"),
        (c("prior_revenue") - c("prior_cost_of_revenue") * 0.7).alias("prior_operating_income"),
        (c("revenue") * 0.25).alias("operating_cash_flow"),
        c("income_tax_expense").alias("capital_expenditures"),
        (c("cost_of_revenue") * 0.5).alias("total_debt"),
        (c("income_tax_expense") * 2.0).alias("cash"),
        F.when(key % 11 == 0, F.lit(0.0)).otherwise(c("revenue") * 0.4).alias("stockholders_equity"),
        F.when(key % 7 != 0, (key + 1000).cast("double")).alias("shares_outstanding"),
        (c("revenue") * 0.6).alias("current_assets"),
        (c("cost_of_revenue") * 0.3).alias("current_liabilities"),
        F.when(key % 5 != 0, c("cost_of_revenue") * 0.1).alias("inventory"),
        (c("revenue") * 0.1).alias("accounts_receivable"),
        (c("cost_of_revenue") * 0.05).alias("accounts_payable"),
        (c("income_tax_expense") * 0.5).alias("interest_expense"),
        (c("revenue") * 1.5).alias("total_assets"),
        (c("net_income") + c("income_tax_expense")).alias("income_before_tax"),
        F.when(key % 13 != 0, c("cost_of_revenue") * 0.03).alias("depreciation_and_amortization"),
        F.when(key % 3 == 0, F.lit(0.5)).alias("dividends_per_share"),
    )


STATEMENT_SQL = (
    ISSUER_SQL
    + """,
statements as (
  select *,
    revenue - cost_of_revenue * 0.7::double as operating_income,
    prior_revenue - prior_cost_of_revenue * 0.7::double as prior_operating_income,
    revenue * 0.25::double as operating_cash_flow,
    income_tax_expense as capital_expenditures,
    cost_of_revenue * 0.5::double as total_debt,
    income_tax_expense * 2.0::double as cash_and_equivalents,
    case when entity % 11 = 0 then 0.0::double else revenue * 0.4::double end as shareholders_equity,
    case when entity % 7 <> 0 then (entity + 1000)::double end as diluted_shares_outstanding,
    revenue * 0.6::double as current_assets,
    cost_of_revenue * 0.3::double as current_liabilities,
    case when entity % 5 <> 0 then cost_of_revenue * 0.1::double end as inventory,
    revenue * 0.1::double as accounts_receivable,
    cost_of_revenue * 0.05::double as accounts_payable,
    income_tax_expense * 0.5::double as interest_expense,
    revenue * 1.5::double as total_assets,
    net_income + income_tax_expense as income_before_tax,
    case when entity % 13 <> 0 then cost_of_revenue * 0.03::double end as depreciation_and_amortization,
    case when entity % 3 = 0 then 0.5::double end as dividends_per_share
  from issuers)"""
)


def daily_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Last positive event value per user and day, with the day's average over users as benchmark."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    prices = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        (F.max_by("value", F.struct("ts", "event_id")) + 1.0).alias("price")
    )
    average = prices.groupBy("day").agg(
        (F.sum(F.col("price").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))).alias("benchmark")
    )
    return prices.join(average, "day")


PRICES_SQL = """
last_event as (
  select user_id, cast(ts as date) as day, value + 1.0::double as price,
    row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as n
  from events),
only_prices as (select user_id, day, price from last_event where n = 1),
averages as (
  select day, cast(sum(cast(price as decimal(18,6))) as double) / count(*) as benchmark from only_prices group by day),
prices as (select user_id, only_prices.day, price, benchmark from only_prices join averages using (day))"""


def plain_run_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log without sequence numbers: one run per user, kinds by event type."""
    kinds = {
        "signup": "task_started",
        "click": "tool_started",
        "view": "tool_completed",
        "purchase": "task_completed",
        "error": "tool_failed",
    }
    kind = F.lit(None).cast("string")
    for event_type, name in kinds.items():
        kind = F.when(F.col("event_type") == event_type, name).otherwise(kind)
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        kind.alias("kind"),
        F.col("ts").alias("timestamp"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("message"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("lane-"), (F.col("event_id") % 4).cast("string"))).alias(
            "agent_id"
        ),
        F.col("props").alias("payload"),
        "event_id",
        "value",
    )


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """The log with a sequence by time: a position per user over range partitions, so that no user is one task."""
    numbered = ordinal(plain_run_events(spark, folder), [F.col("timestamp"), F.col("event_id")], "_position", keys=["run_id"])
    return numbered.withColumn("sequence", (F.col("_position") - 1).cast("long")).drop("_position")


RUN_EVENTS_SQL = """
log as (
  select cast(user_id as varchar) as run_id,
    row_number() over (partition by user_id order by ts, event_id) - 1 as sequence,
    case event_type when 'signup' then 'task_started' when 'click' then 'tool_started'
      when 'view' then 'tool_completed' when 'purchase' then 'task_completed'
      when 'error' then 'tool_failed' end as kind,
    ts as timestamp, event_type || ' ' || cast(event_id as varchar) as message,
    case when event_id % 4 <> 0 then 'lane-' || cast(event_id % 4 as varchar) end as agent_id,
    props as payload, event_id, value
  from events)"""


def half_even_sql(expression: str, precision: int = 6) -> str:
    text = f"cast(cast({expression} as varchar) as decimal(38,18))"
    return f"cast(round_even({text}, {precision}) as double)"
