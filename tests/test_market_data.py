import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyscope.functions.text import currency_code, market_timestamp, parse_unit
from tallyscope.operators.quality import DataViolation
from tallyscope.operators.records import check_batch
from tallyscope.sources import market_data as md
from tallyscope.sources.identity import (
    dedupe_tickers,
    identity_evidence,
    read_exchange_map,
    read_ticker_map,
    recent_filings,
)

AT = datetime(2025, 3, 1)


def snapshots(spark, *rows):
    return spark.createDataFrame(
        [(*r, AT, AT) for r in rows],
        "ticker string, currency string, last_price double, market_cap double, exchange string, "
        "observed_at timestamp, retrieved_at timestamp",
    )


def test_snapshot(spark):
    batch = md.normalize_snapshots(
        snapshots(
            spark,
            (" abc ", "usd", 12.5, 1_250_000.0, "NMS"),
            ("NOC", None, 1.0, 2.0, None),
            ("GAP", "EUR", None, float("nan"), None),
        )
    )
    rows = {(r["ticker"], r["name"]): r for r in batch.observations.collect()}
    assert set(rows) == {("ABC", "share_price"), ("ABC", "market_cap")}
    price = rows[("ABC", "share_price")]
    assert price["value"] == 12.5 and price["unit"].asDict() == {
        "kind": "currency_per_share",
        "symbol": "USD",
        "scale": "units",
    }
    assert price["period"]["end"] == date(2025, 3, 1) and price["entity_id"] == "ticker:ABC"
    assert sorted((r["entity_id"], r["code"]) for r in batch.issues.collect()) == [
        ("ticker:GAP", "invalid_value"),
        ("ticker:GAP", "missing_value"),
        ("ticker:NOC", "missing_currency"),
    ]
    check_batch(batch)


def test_history(spark):
    schema = (
        "Ticker string, Currency string, `Row Index` int, Date string, Open double, Close double, "
        "`Adj Close` double, Volume double, Dividends double, `Stock Splits` double, `Capital Gains` double"
    )
    rows = [
        ("abc", "USD", 0, "2025-01-02", 1.0, 2.0, 2.0, 0.0, 0.0, 0.0, 0.0),
        ("abc", "USD", 1, "2025-01-03T00:00:00Z", -1.0, float("nan"), None, -5.0, 0.5, 2.0, 0.1),
        ("abc", "USD", 2, "not a date", 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0),
        ("abc", "USD", 3, "2025-01-02T00:00:00", None, 11.0, None, None, None, None, None),
    ]
    wide = md.standard_history(spark.createDataFrame(rows, schema))
    batch = md.normalize_history(wide, auto_adjust=True, retrieved_at=AT)
    got = {(str(r["period"]["end"]), r["name"]): r for r in batch.observations.collect()}
    assert {k: v["value"] for k, v in got.items()} == {
        ("2025-01-02", "open_price"): 1.0,
        ("2025-01-02", "close_price"): 11.0,
        ("2025-01-02", "adjusted_close_price"): 2.0,
        ("2025-01-02", "volume"): 0.0,
        ("2025-01-03", "dividends_per_share"): 0.5,
        ("2025-01-03", "stock_split_ratio"): 2.0,
        ("2025-01-03", "capital_gains_per_share"): 0.1,
    }
    meta = json.loads(got[("2025-01-02", "close_price")]["metadata"])
    assert meta["adjusted"] is True and meta["interval"] == "1d"
    assert json.loads(got[("2025-01-02", "volume")]["metadata"])["adjusted"] is False
    issues = sorted((r["code"], r["provider_path"], r["message"]) for r in batch.issues.collect())
    assert issues == [
        (
            "duplicate_history_value",
            "history[3].close",
            "later close_price value replaced an earlier value at 2025-01-02T00:00:00+00:00",
        ),
        ("invalid_timestamp", "history[2]", "date or datetime value must use ISO format"),
        ("invalid_value", "history[1].close", "close must be a finite JSON number"),
        ("invalid_value", "history[1].open", "open must be positive"),
        ("invalid_value", "history[1].volume", "volume must not be negative"),
    ]
    with pytest.raises(ValueError):
        md.normalize_history(wide, auto_adjust=True, retrieved_at=AT, interval=" ")


def test_snapshot_reader(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text(
        '{"ticker":"A","lastPrice":1.5,"last_price":9,"market_cap":10,"currency":" USD "}\n'
        '{"ticker":"B","lastPrice":null,"last_price":9}\n'
    )
    rows = {r["ticker"]: r for r in md.read_snapshots(spark, str(path)).collect()}
    assert rows["A"]["last_price"] == 1.5 and rows["A"]["market_cap"] == 10.0 and rows["A"]["currency"] == "USD"
    assert rows["B"]["last_price"] is None


def test_identity_maps(spark, tmp_path):
    ticker_map = {
        "0": {"ticker": "aaa", "title": "A Co", "cik_str": 1},
        "1": {"ticker": "b b", "title": "Bad", "cik_str": 2},
        "2": {"ticker": "CCC", "title": "C", "cik_str": "CIK0000000003"},
        "3": 7,
    }
    path = tmp_path / "t.json"
    path.write_text(json.dumps(ticker_map))
    identities = read_ticker_map(spark, str(path))
    assert sorted(map(tuple, identities.collect())) == [
        ("AAA", "0000000001", "A Co"),
        ("CCC", "0000000003", "C"),
    ]
    rows = identity_evidence(identities, F.lit(AT), F.lit("0" * 64)).collect()
    assert len({r["evidence_id"] for r in rows}) == 2
    ticker_map["4"] = {"ticker": "AAA", "title": "Other", "cik_str": 9}
    path.write_text(json.dumps(ticker_map))
    with pytest.raises(DataViolation):
        read_ticker_map(spark, str(path))

    exchange = {
        "fields": ["cik", "name", "ticker", "exchange"],
        "data": [[1, "A Co", "aaa", "Nasdaq"], [2, "B", "BBB", None], [3, "short"], [4, "D", "DDD", "NYSE", "x"]],
    }
    other = tmp_path / "e.json"
    other.write_text(json.dumps(exchange))
    assert sorted(map(tuple, read_exchange_map(spark, str(other)).collect())) == [
        ("AAA", "0000000001", "A Co", "Nasdaq"),
        ("DDD", "0000000004", "D", "NYSE"),
    ]
    other.write_text(json.dumps({"fields": ["cik"], "data": [[1]]}))
    with pytest.raises(DataViolation):
        read_exchange_map(spark, str(other))


def test_filings_and_tickers(spark):
    schema = "cik string, filings struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>>>"
    submissions = spark.createDataFrame(
        [("1", ((["10-K", "4", "8-K"], ["a", "b", "c"], ["2025-01-01", "2025-01-02"]),))], schema
    )
    assert sorted(map(tuple, recent_filings(submissions).collect())) == [
        ("1", "10-K", "a", "2025-01-01"),
        ("1", "8-K", "c", None),
    ]
    asked = spark.createDataFrame([(0, " bbb"), (1, "AAA"), (2, "BBB")], "ord int, ticker string")
    assert [r["ticker"] for r in dedupe_tickers(asked, 8).orderBy("ord").collect()] == ["BBB", "AAA"]
    with pytest.raises(DataViolation):
        dedupe_tickers(asked, 1)
    with pytest.raises(DataViolation):
        dedupe_tickers(spark.createDataFrame([(0, "?")], "ord int, ticker string"), 8)


def test_text_helpers(spark):
    rows = spark.createDataFrame(
        [("USD",), (" shares ",), ("pure",), ("eur/shares",), ("EURO/shares",), ("US",)], "u string"
    )
    got = [r["k"] for r in rows.select(parse_unit("u").alias("k")).collect()]
    assert [None if k is None else (k["kind"], k["symbol"]) for k in got] == [
        ("currency", "USD"),
        ("shares", "shares"),
        ("ratio", "pure"),
        ("currency_per_share", "EUR"),
        None,
        None,
    ]
    times = spark.createDataFrame(
        [("2024-01-02T03:04:05+02:00",), ("2024-01-02 03:04",), ("2024-01-02T03",), ("2024",), ("",)], "t string"
    )
    assert [r[0] for r in times.select(market_timestamp("t")).collect()] == [
        datetime(2024, 1, 2, 1, 4, 5),
        datetime(2024, 1, 2, 3, 4),
        datetime(2024, 1, 2, 3),
        None,
        None,
    ]
    codes = spark.createDataFrame([("usd",), ("us",), ("12a",)], "c string").select(currency_code("c"))
    assert [r[0] for r in codes.collect()] == ["USD", None, None]
