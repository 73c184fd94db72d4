"""Market snapshots, price histories and screen members to observations, evidence and issues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tallyscope.functions.numeric import is_finite
from tallyscope.functions.text import (
    canonical_json,
    currency_code,
    history_key,
    instant,
    market_timestamp,
    unit_struct,
)
from tallyscope.operators.records import (
    Batch,
    bounded_issues,
    evidence_of,
    observations_of,
    with_identity,
)

_QUOTE = "https://finance.yahoo.com/quote/"
SCREENER_URL = "https://query2.finance.yahoo.com/v1/finance/screener"

# History field, canonical name, unit kind, event-only flag, smallest value rule.
HISTORY_FIELDS: tuple[tuple[str, str, str, bool, str], ...] = (
    ("open", "open_price", "currency_per_share", False, "positive"),
    ("high", "high_price", "currency_per_share", False, "positive"),
    ("low", "low_price", "currency_per_share", False, "positive"),
    ("close", "close_price", "currency_per_share", False, "positive"),
    ("adjclose", "adjusted_close_price", "currency_per_share", False, "positive"),
    ("volume", "volume", "shares", False, "not negative"),
    ("dividends", "dividends_per_share", "currency_per_share", True, "not negative"),
    ("stocksplits", "stock_split_ratio", "ratio", True, "positive when present"),
    ("capitalgains", "capital_gains_per_share", "currency_per_share", True, "not negative"),
)
_ADJUSTABLE = ("open", "high", "low", "close")


def _symbol(value: Column) -> Column:
    text = F.upper(F.trim(value))
    return F.when(text != "", text)


def _unit(kind: Column, currency: Column) -> Column:
    symbol = (
        F.when(kind.isin("currency", "currency_per_share"), currency)
        .when(kind == "shares", "shares")
        .otherwise("pure")
    )
    return unit_struct(kind, symbol)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot JSON lines; camel-case keys win over their snake-case twins when both are present.

    ``observed_at`` and ``retrieved_at`` of a line are kept, else both are the file's modification time. A line that is
    no JSON keeps its text in ``unreadable``, which becomes an issue in :func:`normalize_snapshots`; blank lines are no
    rows.
    """
    raw = spark.read.text(path).where("trim(value) <> ''").selectExpr(
        "value", "try_parse_json(value) as v", "_metadata.file_modification_time as _at"
    )
    first = lambda a, b, kind: (
        f"try_variant_get(coalesce(try_variant_get(v, '$.{a}', 'variant'), "
        f"try_variant_get(v, '$.{b}', 'variant')), '$', '{kind}')"
    )
    return raw.selectExpr(
        "try_variant_get(v, '$.ticker', 'string') as ticker",
        "nullif(trim(try_variant_get(v, '$.currency', 'string')), '') as currency",
        f"{first('lastPrice', 'last_price', 'double')} as last_price",
        f"{first('marketCap', 'market_cap', 'double')} as market_cap",
        "nullif(trim(try_variant_get(v, '$.exchange', 'string')), '') as exchange",
        "coalesce(try_variant_get(v, '$.observed_at', 'timestamp'), _at) as observed_at",
        "coalesce(try_variant_get(v, '$.retrieved_at', 'timestamp'), _at) as retrieved_at",
        "case when v is null then value end as unreadable",
    )


def _finish(rows: DataFrame, source_kind: str, locator: dict[str, Column], metadata: dict[str, Column]) -> DataFrame:
    c = F.col
    base = rows.select(
        "*",
        F.concat(F.lit("ticker:"), c("ticker")).alias("entity_id"),
        _unit(c("kind"), c("currency")).alias("unit"),
        instant(F.to_date("observed_at")).alias("period"),
        c("value").cast("string").alias("value_text"),
        F.concat(F.lit(_QUOTE), c("ticker")).alias("source_url"),
    )
    fields = {
        "ticker": c("ticker"),
        "provider_field": c("field"),
        "observed_at": c("observed_at").cast("string"),
        "reported_value": c("value"),
        **locator,
    }
    named = with_identity(base, "yfinance", source_kind, fields, {"currency": c("currency")})
    return named.withColumn("metadata", canonical_json({"provider_field": c("field"), **metadata}))


def normalize_snapshots(snapshots: DataFrame) -> Batch:
    """Snapshot rows (ticker, currency, last_price, market_cap, exchange, observed_at, retrieved_at[, unreadable]).

    A row without a usable ticker, or one that could not be read, becomes an issue without an entity.
    """
    c = F.col
    if "unreadable" not in snapshots.columns:
        snapshots = snapshots.withColumn("unreadable", F.lit(None).cast("string"))
    base = snapshots.withColumn("ticker", _symbol(c("ticker"))).withColumn("currency", currency_code("currency"))
    field = lambda i, source, name, kind: F.struct(
        F.lit(i).alias("i"),
        F.lit(source).alias("field"),
        F.lit(name).alias("name"),
        F.lit(kind).alias("kind"),
        c(source).cast("double").alias("value"),
    )
    cells = base.where("ticker is not null").select(
        "ticker",
        "currency",
        "exchange",
        "observed_at",
        "retrieved_at",
        F.explode(
            F.array(
                field(0, "last_price", "share_price", "currency_per_share"),
                field(1, "market_cap", "market_cap", "currency"),
            )
        ).alias("_cell"),
    ).select("*", "_cell.*")
    path = F.concat(F.lit("snapshot."), c("field"))
    no_currency = c("currency").isNull()

    def problem(code: str, where: Column, text: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), where.alias("provider_path"), text.alias("message"))

    issue = (
        F.when(
            no_currency & (c("i") == 0),
            problem(
                "missing_currency",
                F.lit("snapshot.currency"),
                F.lit("currency is required to normalize price and market-cap values"),
            ),
        )
        .when(
            ~no_currency & c("value").isNull(),
            problem("missing_value", path, F.concat(c("field"), F.lit(" is unavailable"))),
        )
        .when(
            ~no_currency & ~is_finite("value"),
            problem("invalid_value", path, F.concat(c("field"), F.lit(" must be a finite JSON number"))),
        )
    )
    judged = cells.withColumn("issue", issue)
    lost = base.where("ticker is null").select(
        F.lit(None).cast("string").alias("entity_id"),
        F.when(c("unreadable").isNull(), "invalid_ticker").otherwise("invalid_snapshot").alias("code"),
        F.when(c("unreadable").isNull(), "snapshot.ticker").otherwise("snapshot").alias("provider_path"),
        F.when(c("unreadable").isNull(), F.lit("ticker must be a non-empty string"))
        .otherwise(F.concat(F.lit("line is not JSON: "), c("unreadable")))
        .alias("message"),
        F.lit(0).cast("long").alias("ord"),
    )
    issues = judged.where("issue is not null").select(
        F.concat(F.lit("ticker:"), c("ticker")).alias("entity_id"), "issue.*", c("i").cast("long").alias("ord")
    ).unionByName(lost)
    good = judged.where("issue is null and currency is not null")
    records = _finish(
        good, "market_snapshot", {"exchange": c("exchange")}, {"exchange": c("exchange"), "currency": c("currency")}
    )
    return Batch(observations_of(records), evidence_of(records), bounded_issues(issues))


def standard_history(rows: DataFrame) -> DataFrame:
    """Rename free-form headers to history keys; the first of two equal keys is kept."""
    known = {f[0] for f in HISTORY_FIELDS} | {"date", "datetime", "ticker", "currency", "rowindex"}
    columns: dict[str, Column] = {}
    for name in rows.columns:
        key = history_key(name)
        if key in known and key not in columns:
            columns[key] = F.col(f"`{name}`").alias(key)
    return rows.select(*columns.values())


def read_price_history(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet") -> DataFrame:
    """Wide price rows with the headers the provider wrote; the schema is given, never inferred."""
    options = {"header": "true"} if file_format == "csv" else {}
    return standard_history(spark.read.schema(schema).options(**options).format(file_format).load(path))


def _timestamp(rows: DataFrame) -> Column:
    """``datetime`` when the column exists, else ``date``."""
    name = "datetime" if "datetime" in rows.columns else "date"
    if isinstance(rows.schema[name].dataType, T.StringType):
        return market_timestamp(name)
    return F.col(name).cast("timestamp")


def normalize_history(
    rows: DataFrame,
    auto_adjust: bool,
    retrieved_at: datetime | Column,
    interval: str = "1d",
) -> Batch:
    """Wide price rows (ticker, currency, rowindex, date or datetime, fields) to long observations.

    Later rows replace earlier ones of the same field and time. The number of replaced values is
    found with an aggregate; only repeated keys are joined back to name the rows.
    """
    if not isinstance(auto_adjust, bool):
        raise ValueError("auto_adjust must be a boolean")
    step = interval.strip()
    if not step or len(step) > 20:
        raise ValueError("interval must contain between 1 and 20 characters")
    c = F.col
    known = {f[0]: f for f in HISTORY_FIELDS}
    present = [name for name in known if name in rows.columns]
    kinds = {name: rows.schema[name].dataType for name in present}
    retrieved = retrieved_at if isinstance(retrieved_at, Column) else F.lit(retrieved_at)

    def cell(order: int, name: str) -> Column:
        _, canonical, kind, event, domain = known[name]
        numeric = isinstance(kinds[name], T.NumericType)
        return F.struct(
            F.lit(order).alias("i"),
            F.lit(name).alias("field"),
            F.lit(canonical).alias("name"),
            F.lit(kind).alias("kind"),
            F.lit(event).alias("event_only"),
            F.lit(domain).alias("domain"),
            (c(name).cast("double") if numeric else F.lit(None).cast("double")).alias("value"),
            c(name).isNotNull().alias("given"),
        )

    read = rows.select(
        _symbol(c("ticker")).alias("ticker"),
        currency_code("currency").alias("currency"),
        c("rowindex").cast("long").alias("rowindex"),
        _timestamp(rows).alias("observed_at"),
        retrieved.cast("timestamp").alias("retrieved_at"),
        F.array(*[cell(i, n) for i, n in enumerate(present)]).alias("_cells"),
    )
    base = read.where("ticker is not null and currency is not null")
    entity = F.concat(F.lit("ticker:"), c("ticker"))
    row_path = F.concat(F.lit("history["), c("rowindex").cast("string"), F.lit("]"))
    unnamed = read.where("ticker is null or currency is null").select(
        entity.alias("entity_id"),
        F.when(c("ticker").isNull(), "invalid_ticker").otherwise("missing_currency").alias("code"),
        row_path.alias("provider_path"),
        F.when(c("ticker").isNull(), "ticker must be a non-empty string")
        .otherwise("a three-letter currency is needed")
        .alias("message"),
        (c("rowindex") * 100).alias("ord"),
    )
    bad_time = base.where("observed_at is null").select(
        entity.alias("entity_id"),
        F.lit("invalid_timestamp").alias("code"),
        row_path.alias("provider_path"),
        F.lit("date or datetime value must use ISO format").alias("message"),
        (c("rowindex") * 100).alias("ord"),
    )
    cells = (
        base.where("observed_at is not null")
        .select("ticker", "currency", "rowindex", "observed_at", "retrieved_at", F.explode("_cells").alias("_c"))
        .select("ticker", "currency", "rowindex", "observed_at", "retrieved_at", "_c.*")
        .where("given")
    )
    low = F.when(c("domain") == "not negative", c("value") < 0).otherwise(c("value") <= 0)
    wording = F.when(c("domain") == "not negative", F.lit(" must not be negative")).otherwise(
        F.concat(F.lit(" must be "), c("domain"))
    )
    message = F.when(~is_finite("value"), F.concat(c("field"), F.lit(" must be a finite JSON number"))).when(
        low, F.concat(c("field"), wording)
    )
    quiet = c("event_only") & F.coalesce(c("value") == 0, F.lit(False))
    judged = cells.where(~quiet).withColumn("_message", message)
    cell_path = F.concat(row_path, F.lit("."), c("field"))
    invalid = judged.where("_message is not null").select(
        entity.alias("entity_id"),
        F.lit("invalid_value").alias("code"),
        cell_path.alias("provider_path"),
        c("_message").alias("message"),
        (c("rowindex") * 100 + c("i")).alias("ord"),
    )
    good = judged.where("_message is null").drop("_message", "event_only", "domain", "given")
    key = ["ticker", "field", "observed_at"]
    kept = [n for n in good.columns if n not in key]
    latest = good.groupBy(*key).agg(
        F.max_by(F.struct(*kept), "rowindex").alias("_last"),
        F.min("rowindex").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )
    repeated = latest.where("_n > 1").select(*key, "_first")
    replaced = good.join(repeated, key).where(c("rowindex") > c("_first")).select(
        entity.alias("entity_id"),
        F.lit("duplicate_history_value").alias("code"),
        cell_path.alias("provider_path"),
        F.concat(
            F.lit("later "),
            c("name"),
            F.lit(" value replaced an earlier value at "),
            F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ssxxx"),
        ).alias("message"),
        (c("rowindex") * 100 + c("i")).alias("ord"),
    )
    winners = latest.select(*key, "_last.*")
    records = _finish(
        winners,
        "price_history",
        {"interval": F.lit(step), "auto_adjust": F.lit(auto_adjust)},
        {
            "currency": c("currency"),
            "interval": F.lit(step),
            "auto_adjust": F.lit(auto_adjust),
            "adjusted": c("field").isin(*_ADJUSTABLE) if auto_adjust else F.lit(False),
        },
    )
    issues = unnamed.unionByName(bad_time).unionByName(invalid).unionByName(replaced)
    return Batch(observations_of(records), evidence_of(records), bounded_issues(issues))


def normalize_members(members: DataFrame) -> Batch:
    """Price, market cap and volume of selected universe members, bound to their screen page.

    The page has no quote time, so its retrieval time is used and the metadata says so.
    """
    c = F.col
    field = lambda source, column, kind: F.struct(
        F.lit(source).alias("field"),
        F.lit(column).alias("name"),
        F.lit(kind).alias("kind"),
        c(column).cast("double").alias("value"),
    )
    rows = members.select(
        "ticker",
        "entity_id",
        "currency",
        "market_exchange_code",
        "request_hash",
        c("content_hash").alias("page_hash"),
        c("retrieved_at").alias("observed_at"),
        "retrieved_at",
        F.explode(
            F.array(
                field("regularMarketPrice", "share_price", "currency_per_share"),
                field("marketCap", "market_cap", "currency"),
                field("averageDailyVolume3Month", "average_daily_volume_3m", "shares"),
            )
        ).alias("_f"),
    ).select("*", "_f.*")
    base = rows.select(
        "*",
        _unit(c("kind"), c("currency")).alias("unit"),
        instant(F.to_date("observed_at")).alias("period"),
        c("value").cast("string").alias("value_text"),
        F.lit(SCREENER_URL).alias("source_url"),
    )
    locator = {
        "ticker": c("ticker"),
        "provider_field": c("field"),
        "request_hash": c("request_hash"),
        "page_content_hash": c("page_hash"),
        "reported_value": c("value"),
        "currency": c("currency"),
        "exchange": c("market_exchange_code"),
        "retrieved_at": c("retrieved_at").cast("string"),
    }
    named = with_identity(base, "yfinance", "equity_screen_page", locator, {}, content_hash=c("page_hash"))
    metadata = canonical_json(
        {
            "provider_field": c("field"),
            "exchange": c("market_exchange_code"),
            "currency": c("currency"),
            "request_hash": c("request_hash"),
            "page_content_hash": c("page_hash"),
            "observed_at_basis": F.lit("provider_page_retrieval_time"),
        }
    )
    records = named.withColumn("metadata", metadata)
    none = records.where("false").selectExpr(
        "entity_id", "'' as code", "'' as provider_path", "'' as message", "cast(0 as bigint) as ord"
    )
    return Batch(observations_of(records), evidence_of(records), none)
