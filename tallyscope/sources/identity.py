"""Ticker and exchange identity maps, filing indexes and ticker lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.functions.text import (
    blank_to_null,
    canonical_json,
    evidence_id,
    normalize_cik,
    normalize_ticker,
)
from tallyscope.operators.quality import DataViolation, Violation, raise_on

FILING_FORMS = ("10-K", "10-Q", "8-K")
TICKER_MAP_URL = "https://www.sec.gov/files/company_tickers.json"
EXCHANGE_MAP_URL = "https://www.sec.gov/files/company_tickers_exchange.json"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).selectExpr("try_parse_json(value) as v")


def parse_ticker_map(documents: DataFrame) -> DataFrame:
    """``{"0": {ticker, title, cik_str}}`` to ticker, cik, company; unusable rows are skipped."""
    rows = documents.selectExpr("explode(try_cast(v as map<string, variant>)) as (_key, _row)")
    typed = rows.selectExpr(
        "try_variant_get(_row, '$.ticker', 'string') as ticker",
        "try_variant_get(_row, '$.title', 'string') as company",
        "try_variant_get(_row, '$.cik_str', 'string') as cik",
    )
    return _valid_identities(typed, ["ticker", "cik", "company"])


def parse_exchange_map(documents: DataFrame) -> DataFrame:
    """``{fields: [..], data: [[..]]}`` to ticker, cik, company, exchange; positions come from fields."""
    tables = documents.selectExpr(
        "try_cast(v:fields as array<string>) as _fields", "try_cast(v:data as array<variant>) as _data"
    )
    rows = tables.selectExpr("_fields", "explode(_data) as _item").selectExpr(
        "_fields", "try_cast(_item as array<variant>) as _row"
    ).where("size(_row) >= size(_fields)")
    at = lambda name: f"try_cast(get(_row, cast(array_position(_fields, '{name}') as int) - 1) as string)"
    typed = rows.selectExpr(
        f"{at('ticker')} as ticker", f"{at('name')} as company", f"{at('cik')} as cik", f"{at('exchange')} as exchange"
    )
    return _valid_identities(typed, ["ticker", "cik", "company", "exchange"])


def _valid_identities(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    cleaned: dict[str, Column] = {
        "ticker": normalize_ticker("ticker"),
        "cik": normalize_cik("cik"),
        "company": blank_to_null("company"),
        "exchange": blank_to_null("exchange"),
    }
    return rows.select(*[cleaned[n].alias(n) for n in columns]).dropna().distinct()


def check_identities(identities: DataFrame) -> None:
    """Raise when one ticker maps to two identities, or nothing is left."""
    raise_on(
        Violation(
            "identity map contains conflicting entries",
            identities.groupBy("ticker").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1"),
        )
    )
    if identities.isEmpty():
        raise DataViolation("identity map did not contain any valid entries")


def _has_fields(documents: DataFrame) -> DataFrame:
    needed = ("cik", "name", "ticker", "exchange")
    known = " and ".join(f"array_contains(try_cast(v:fields as array<string>), '{n}')" for n in needed)
    return documents.where(f"not coalesce({known} and try_cast(v:data as array<variant>) is not null, false)")


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    identities = parse_ticker_map(_documents(spark, path))
    check_identities(identities)
    return identities


def read_exchange_map(spark: SparkSession, path: str) -> DataFrame:
    documents = _documents(spark, path)
    if not _has_fields(documents).isEmpty():
        raise DataViolation("exchange map does not contain the required identity fields")
    identities = parse_exchange_map(documents)
    check_identities(identities)
    return identities


def identity_evidence(
    identities: DataFrame, retrieved_at: Column, mapping_hash: Column, source_url: str = TICKER_MAP_URL
) -> DataFrame:
    """One evidence row per issuer of the ticker map."""
    c = F.col
    rows = identities.select("ticker", "cik", "company", retrieved_at.alias("retrieved_at"), mapping_hash.alias("_map"))
    locator = canonical_json(
        {"ticker": c("ticker"), "cik": c("cik"), "company": c("company"), "mapping_content_hash": c("_map")}
    )
    kind = F.lit("company_ticker_identity")
    return rows.withColumn("source_locator", locator).select(
        "ticker",
        evidence_id(F.lit("sec"), kind, c("source_locator")).alias("evidence_id"),
        F.lit("sec").alias("provider"),
        kind.alias("source_kind"),
        "source_locator",
        F.lit(source_url).alias("source_url"),
        c("retrieved_at").alias("observed_at"),
        "retrieved_at",
        F.sha2("source_locator", 256).alias("content_hash"),
    )


def recent_filings(submissions: DataFrame, forms: Sequence[str] = FILING_FORMS) -> DataFrame:
    """Struct of parallel arrays (``filings.recent``) to one row per filing of the wanted forms.

    Arrays shorter than ``form`` give nulls in their column.
    """
    recent = submissions.select(*[c for c in submissions.columns if c != "filings"], "filings.recent.*")
    arrays = list(submissions.schema["filings"].dataType["recent"].dataType.fieldNames())
    zipped = recent.withColumn("_rows", F.slice(F.arrays_zip(*arrays), 1, F.size("form")))
    others = [c for c in recent.columns if c not in arrays]
    return (
        zipped.select(*others, F.explode("_rows").alias("_row"))
        .select(*others, "_row.*")
        .where(F.col("form").isin(*forms))
    )


def dedupe_tickers(requests: DataFrame, maximum: int | None = None) -> DataFrame:
    """Normalized distinct tickers in first-seen order (``ord``); raise on a bad one, or on none or too many if a maximum is set."""
    if maximum is not None and maximum < 1:
        raise ValueError("maximum must be positive")
    cleaned = requests.select("ord", F.col("ticker").alias("_raw"), normalize_ticker("ticker").alias("ticker"))
    raise_on(Violation("invalid ticker", cleaned.where("ticker is null").select("_raw")))
    unique = cleaned.groupBy("ticker").agg(F.min("ord").alias("ord"))
    if maximum is None:
        return unique
    count = unique.limit(maximum + 1).count()
    if not 1 <= count <= maximum:
        raise DataViolation(f"ticker universe must contain between 1 and {maximum} unique tickers")
    return unique
