"""Identifier, unit, date and JSON helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyscope.functions.numeric import as_column

TICKER_PATTERN = r"^[A-Z0-9][A-Z0-9.\-]{0,19}$"
DIGEST_PATTERN = r"^[0-9a-f]{64}$"


def blank_to_null(value: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    text = F.trim(as_column(value))
    return F.when(text != "", text)


def normalize_cik(value: Column | str) -> Column:
    """Ten-digit zero-padded registrant number; null when the input is not 1 to 10 digits."""
    text = F.trim(as_column(value).cast("string"))
    digits = F.when(text.startswith("CIK"), text.substr(F.lit(4), F.length(text))).otherwise(text)
    return F.when(digits.rlike(r"^[0-9]{1,10}$"), F.lpad(digits, 10, "0"))


def normalize_ticker(value: Column | str) -> Column:
    text = F.upper(F.trim(as_column(value)))
    return F.when(text.rlike(TICKER_PATTERN), text)


def currency_code(value: Column | str) -> Column:
    text = F.upper(F.trim(as_column(value)))
    return F.when(text.rlike(r"^\p{L}{3}$"), text)


def unit_struct(kind: Column, symbol: Column, scale: Column | None = None) -> Column:
    return F.struct(
        kind.alias("kind"),
        symbol.alias("symbol"),
        (F.lit("units") if scale is None else scale).alias("scale"),
    )


def parse_unit(value: Column | str) -> Column:
    """Provider unit label to (kind, symbol, scale); null when the label is not supported."""
    text = F.trim(as_column(value))
    lowered = F.lower(text)
    per_share = lowered.contains("/shares") & lowered.rlike(r"^\p{L}{3}/shares$")
    return (
        F.when(lowered == "shares", unit_struct(F.lit("shares"), F.lit("shares")))
        .when(lowered == "pure", unit_struct(F.lit("ratio"), F.lit("pure")))
        .when(per_share, unit_struct(F.lit("currency_per_share"), F.upper(F.substring(text, 1, 3))))
        .when(text.rlike(r"^\p{L}{3}$"), unit_struct(F.lit("currency"), F.upper(text)))
    )


def iso_date(value: Column | str) -> Column:
    """Strict calendar date: YYYY-MM-DD or the compact YYYYMMDD, else null."""
    text = as_column(value)
    dashed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    # A replacement costs far more than a test, and few dates need one.
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date")).when(
        text.rlike(r"^\d{8}$"), dashed.try_cast("date")
    )


def market_timestamp(value: Column | str) -> Column:
    """ISO date or datetime text to a UTC timestamp; a missing offset means UTC."""
    text = F.trim(as_column(value))
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    whole_hour = F.regexp_replace(text, r"^(\S{10}[T ]\d{2})(Z|[+-].*)?$", "$1:00$2")
    return F.when(text.rlike(shape), F.try_to_timestamp(F.replace(whole_hour, F.lit(","), F.lit("."))))


def is_digest(value: Column | str) -> Column:
    return F.coalesce(as_column(value).rlike(DIGEST_PATTERN), F.lit(False))


def history_key(header: str) -> str:
    """Column header of a price file reduced to lower-case letters and digits."""
    return "".join(ch for ch in header.lower() if ch.isalnum())


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with keys in sorted order and nulls kept, so equal content hashes equally."""
    members = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def sha256_json(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def request_hash(
    provider: Column | str, operation: Column | str, identity: Column | str, parameters: Column | str
) -> Column:
    """Digest that identifies one provider request; ``parameters`` is canonical JSON text."""
    return sha256_json(
        {
            "provider": as_column(provider),
            "operation": as_column(operation),
            "identity": as_column(identity),
            "parameters": as_column(parameters),
        }
    )


def evidence_id(provider: Column, source_kind: Column, locator: Column) -> Column:
    """``locator`` is canonical JSON text."""
    digest = sha256_json({"provider": provider, "source_kind": source_kind, "locator": locator})
    return F.concat(provider, F.lit(":"), source_kind, F.lit(":"), F.substring(digest, 1, 24))


def observation_id(
    provider: Column, entity_id: Column, name: Column, period: Column, evidence: Column
) -> Column:
    digest = sha256_json(
        {
            "provider": provider,
            "entity_id": entity_id,
            "name": name,
            "period": period,
            "evidence_id": evidence,
        }
    )
    return F.concat(F.lit("obs:"), provider, F.lit(":"), F.substring(digest, 1, 24))


def period_struct(kind: Column, start: Column, end: Column, year: Column, fiscal_period: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        start.cast("date").alias("start"),
        end.cast("date").alias("end"),
        year.cast("int").alias("fiscal_year"),
        F.upper(blank_to_null(fiscal_period)).alias("fiscal_period"),
    )


def instant(end: Column) -> Column:
    return period_struct(F.lit("instant"), F.lit(None), end, F.lit(None), F.lit(None).cast("string"))
