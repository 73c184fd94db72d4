import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import universe as un
from tallyscope.operators.quality import DataViolation
from tallyscope.operators.records import check_batch
from tallyscope.sources.market_data import normalize_members
from tallyscope.sources.screen_pages import parse_pages

FETCHED = datetime(2031, 7, 9, 12)
SMALL = un.UniversePolicy(
    profile_id="OWN_TEST",
    target_size=6,
    minimum_size=3,
    page_size=4,
    minimum_market_cap=50.0,
    minimum_share_price=2.0,
    minimum_average_daily_volume_3m=10.0,
    sec_exchanges=("ARCA",),
    market_exchange_codes=("AA", "BB"),
)

# symbol, type, exchange, cap, price, volume, currency; the verdict each of them must get.
LISTING = [
    ("ALFA", "EQUITY", "AA", 900.0, 20.0, 50.0, "USD", 1),
    ("BRAVO", "equity", "bb", 800.0, 20.0, 50.0, "usd", 2),
    ("CEDAR", "EQUITY", "AA", 700.0, 20.0, 50.0, "USD", "duplicate_issuer"),
    ("DELTA", "FUND", "AA", 690.0, 20.0, 50.0, "USD", "non_equity"),
    ("EMBER", "EQUITY", "ZZ", 680.0, 20.0, 50.0, "USD", "market_exchange_outside_policy"),
    ("FJORD", "EQUITY", "AA", None, 20.0, 50.0, "USD", "incomplete_screen_metrics"),
    ("GROVE", "EQUITY", "AA", 49.0, 20.0, 50.0, "USD", "failed_market_threshold"),
    ("HAVEN", "EQUITY", "AA", 660.0, 1.5, 50.0, "USD", "failed_market_threshold"),
    ("INLET", "EQUITY", "AA", 650.0, 20.0, 9.0, "USD", "failed_liquidity_threshold"),
    ("JUNCO", "EQUITY", "AA", 640.0, 20.0, 50.0, "USD", "missing_sec_identity"),
    ("KNOLL", "EQUITY", "AA", 630.0, 20.0, 50.0, "USD", "sec_exchange_outside_policy"),
    ("LARCH", "EQUITY", "AA", 620.0, 20.0, 50.0, "USD", 3),
    ("MAPLE", "EQUITY", "AA", 610.0, 20.0, 50.0, "USD", 4),
    ("NORTH", "EQUITY", "AA", 600.0, 20.0, 50.0, "USD", 5),
    ("OSIER", "EQUITY", "AA", 590.0, 20.0, 50.0, "USD", 6),
    ("PLOVER", "EQUITY", "AA", 580.0, 20.0, 50.0, "USD", "below_target_cutoff"),
    ("no ticker", "EQUITY", "AA", 570.0, 20.0, 50.0, "USD", "invalid_market_row"),
]


def document_pages(spark, rows, size, totals=None):
    keys = ("symbol", "quoteType", "exchange", "marketCap", "regularMarketPrice", "averageDailyVolume3Month", "currency")
    quotes = [dict(zip(keys, row)) if isinstance(row, tuple) else row for row in rows]
    documents = []
    for number, start in enumerate(range(0, len(quotes), size)):
        total = totals[number] if totals else len(quotes)
        body = {"start": start, "total": total, "quotes": quotes[start : start + size]}
        documents.append((start, json.dumps(body), FETCHED, "network"))
    df = spark.createDataFrame(documents, "page_offset int, document string, retrieved_at timestamp, access_mode string")
    hashes = {"content_hash": F.sha2("document", 256), "request_hash": F.sha2(F.col("page_offset").cast("string"), 256)}
    return df.withColumns(hashes)


def identity_map(spark, rows):
    known = []
    for number, row in enumerate(rows):
        name = row[0] if isinstance(row, tuple) else None
        if name in (None, "JUNCO", "no ticker", *[k[0] for k in known]):
            continue
        issuer = 0 if name == "CEDAR" else number
        known.append((name, f"{issuer:010d}", f"{name} plc", "SHELF" if name == "KNOLL" else "Arca"))
    return spark.createDataFrame(known, "ticker string, cik string, company string, exchange string")


def chosen(spark, rows, policy=SMALL, totals=None):
    parsed, pages = parse_pages(document_pages(spark, rows, policy.page_size, totals))
    return un.select_universe(parsed, pages.drop("problem"), identity_map(spark, rows), policy)


def test_every_quote_gets_one_verdict(spark):
    universe = chosen(spark, LISTING)
    ranks = {r["ticker"]: r["rank"] for r in universe.members.collect()}
    assert ranks == {row[0]: row[-1] for row in LISTING if isinstance(row[-1], int)}
    reasons = {r["ticker"]: r["reason"] for r in universe.exclusions.collect()}
    wanted = {row[0]: row[-1] for row in LISTING if isinstance(row[-1], str)}
    wanted["UNKNOWN"] = wanted.pop("no ticker")
    assert reasons == wanted
    assert un.exclusion_samples(universe.exclusions).count() == len(wanted)
    assert un.exclusion_samples(universe.exclusions, 2).count() == 2
    twin = universe.exclusions.where("reason = 'duplicate_issuer'").first()
    assert twin["detail"].endswith(" ALFA")
    un.check_universe(universe)
    row = un.require_minimum(un.manifest(universe, "f" * 64, SMALL))
    assert (row["posture"], row["fetched_row_count"], row["provider_rows_not_inspected"]) == ("target_met", len(LISTING), 0)
    shuffled = chosen(spark, LISTING)._replace(members=universe.members.repartition(3))
    assert un.manifest(shuffled, "f" * 64, SMALL).first()["manifest_id"] == row["manifest_id"]
    check_batch(normalize_members(universe.members))


def test_repeated_and_odd_rows(spark):
    rows = [LISTING[0], LISTING[1], LISTING[1], 17, LISTING[11]]
    universe = chosen(spark, rows)
    assert sorted((r["ticker"], r["reason"]) for r in universe.exclusions.collect()) == [
        ("BRAVO", "duplicate_market_row"),
        ("UNKNOWN", "invalid_market_row"),
    ]
    assert universe.members.count() == 3


def test_all_rows_far_beyond_the_target(spark):
    rows = [(f"S{i:04d}", "EQUITY", "AA", 1e6 - i, 5.0, 20.0, "USD") for i in range(530)]
    universe = chosen(spark, rows)
    assert universe.members.count() == 6 and universe.exclusions.count() == 524


def test_too_few_members_and_conflicting_totals(spark):
    few = chosen(spark, LISTING[:2])
    with pytest.raises(un.CoverageError) as error:
        un.require_minimum(un.manifest(few, "f" * 64, SMALL))
    assert error.value.manifest["selected_count"] == 2
    with pytest.raises(DataViolation, match="disagree on the total"):
        un.check_universe(chosen(spark, LISTING[:6], totals=[6, 7]))


def test_rules_counted_while_writing(spark):
    universe = chosen(spark, LISTING)
    assert universe.found == dict.fromkeys((un.CONFLICTING_TOTALS, un.GROWING_COUNTS, un.REPEATED_TICKER, un.BAD_DIGEST, un.NO_PAGE), 0)
    none = chosen(spark, LISTING[-1:])
    assert none.members.count() == 0 and not any(none.found.values())
    # A universe put together elsewhere is examined by a job.
    unseen = universe._replace(found=None)
    un.check_universe(unseen)
    broken = universe.members.withColumn("content_hash", F.substring("content_hash", 1, 9))
    for members, message in (
        (universe.members.union(universe.members.limit(1)), un.REPEATED_TICKER),
        (broken, un.BAD_DIGEST),
        (universe.members.withColumn("retrieved_at", F.lit("1999-01-01").cast("timestamp")), un.NO_PAGE),
    ):
        with pytest.raises(DataViolation, match=message):
            un.check_universe(unseen._replace(members=members))
    quotes, pages = parse_pages(document_pages(spark, LISTING, SMALL.page_size))
    lost = un.select_universe(quotes, pages.drop("problem").withColumn("request_hash", F.lit("0" * 64)), identity_map(spark, LISTING), SMALL)
    assert lost.found[un.NO_PAGE] == lost.members.count() > 0
    with pytest.raises(DataViolation, match=un.NO_PAGE):
        un.check_universe(lost)


def test_pages_and_policy(spark):
    rows = spark.range(90).select(
        F.concat(F.lit("Q"), "id").alias("ticker"),
        F.lit("BB").alias("exchange"),
        (F.col("id") + 11).cast("double").alias("market_cap"),
        F.lit(3.0).alias("share_price"),
        F.lit(12.0).alias("average_daily_volume_3m"),
    )
    pages = un.provider_screen(rows, SMALL).groupBy("page_offset").agg(F.count("*").alias("n"), F.max("market_cap").alias("top"))
    found = {r["page_offset"]: (r["n"], r["top"]) for r in pages.collect()}
    # 51 rows reach the least cap of 50: twelve pages of four and one of three.
    assert len(found) == 13 and found[0] == (4, 100.0) and found[48] == (3, 52.0)
    capped = un.provider_screen(rows, SMALL.with_sizes(max_screened=9))
    assert capped.count() == 9 and capped.agg(F.min("market_cap")).first()[0] == 92.0
    for wrong in ({"minimum_size": 7}, {"profile_id": "no"}, {"minimum_share_price": -1.0}, {"market_exchange_codes": (" ",)}, {"max_screened": 5}):
        with pytest.raises(ValueError):
            SMALL.with_sizes(**wrong)
