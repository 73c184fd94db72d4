"""Screener page documents to quotes and page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyscope.operators.quality import Violation, raise_on

# Target column and the page keys that may hold it, first present key first.
_TEXT_KEYS = {
    "ticker": ("symbol", "ticker"),
    "quote_type": ("quoteType", "quote_type"),
    "exchange": ("exchange", "exchangeCode"),
    "currency": ("currency", "financialCurrency"),
}
_NUMBER_KEYS = {
    "market_cap": ("marketCap", "intradaymarketcap"),
    "share_price": ("regularMarketPrice", "intradayprice", "price"),
    "average_daily_volume_3m": ("averageDailyVolume3Month", "avgdailyvol3m"),
}


def _first_present(keys: tuple[str, ...]) -> str:
    """The first key that exists, even when its value is null: a null hides the later names."""
    return "coalesce(" + ", ".join(f"_quote['{k}']" for k in keys) + ")"


def _number(keys: tuple[str, ...]) -> str:
    """Number, numeric text, or either inside {raw: x}; booleans and non-finite values are null."""
    value = _first_present(keys)
    inner = f"if(try_cast({value} as map<string, variant>) is null, {value}, try_cast({value} as map<string, variant>)['raw'])"
    number = f"case when schema_of_variant({inner}) <> 'BOOLEAN' then try_cast(trim(try_cast({inner} as string)) as double) end"
    return f"case when abs({number}) < double('infinity') then {number} end"


def parse_pages(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotes, pages) from page documents.

    ``documents`` has page_offset, document, content_hash, request_hash, retrieved_at, access_mode.
    A page without a quotes list or a non-negative total has a ``problem``.
    """
    parsed = documents.selectExpr("*", "try_parse_json(document) as _v").selectExpr(
        "* except (document, _v)",
        "try_cast(try_variant_get(_v, '$.quotes', 'variant') as array<variant>) as _quotes",
        "case when schema_of_variant(try_variant_get(_v, '$.total', 'variant')) <> 'BOOLEAN' then "
        "try_variant_get(_v, '$.total', 'int') end as total",
    )
    pages = parsed.selectExpr(
        "page_offset",
        "total",
        "coalesce(size(_quotes), 0) as row_count",
        "content_hash",
        "request_hash",
        "retrieved_at",
        "access_mode",
        "case when _quotes is null then 'market equity screen did not contain a quotes list' "
        "when coalesce(total, -1) < 0 then 'market screen total must be a non-negative integer' end as problem",
    )
    rows = parsed.selectExpr(
        "page_offset",
        "content_hash",
        "request_hash",
        "retrieved_at",
        "posexplode(_quotes) as (position, _item)",
    ).selectExpr("* except (_item)", "try_cast(_item as map<string, variant>) as _quote")
    text = [f"try_cast({_first_present(keys)} as string) as {name}" for name, keys in _TEXT_KEYS.items()]
    numbers = [f"{_number(keys)} as {name}" for name, keys in _NUMBER_KEYS.items()]
    quotes = rows.selectExpr("* except (_quote)", "_quote is not null as is_object", *text, *numbers)
    return quotes, pages


def read_screen_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parquet table of fetched pages (see :func:`parse_pages`); raise on an unusable page."""
    quotes, pages = parse_pages(spark.read.parquet(path))
    raise_on(Violation("unusable screen page", pages.where(F.col("problem").isNotNull()).select("page_offset", "problem")))
    return quotes, pages.drop("problem")
