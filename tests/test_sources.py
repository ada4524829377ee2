import json
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tipscope.functions.coerce import to_long
from tipscope.operators.latest import serving_features, store_summary
from tipscope.schemas import DAILY_PRICES, SESSION_KEY
from tipscope.session import scratch_path
from tipscope.sources import calendar as C
from tipscope.sources import exchange_files as X
from tipscope.sources import messages as M
from tipscope.sources import tables as T

HEADER = ", ".join(X.DAILY_COLUMNS)


def line(symbol, day="14-Aug-2026", series="EQ", close="105.5", qty="1000", deliv="-"):
    return (f"{symbol}, {series}, {day}, 100.0, 101, 106, 99, 105, {close}, 103.2, {qty}, "
            f"1.05, 12, {deliv}, {deliv}")


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")


def test_daily_file(spark, tmp_path):
    write(tmp_path / "2026-08-14.csv", HEADER, line("RELIANCE"), line("SMALL", series="SM",
          deliv="40"), line("", ), line("BAD", day="14/08/2026"), line("ODD", qty="1.0",
          close="n/a"))
    write(tmp_path / "2026-08-17.csv", HEADER, line("RELIANCE", day="17-Aug-2026"))
    got = X.read_daily_prices(spark, str(tmp_path))
    assert [(f.name, f.dataType) for f in got.schema] == [
        (f.name, f.dataType) for f in DAILY_PRICES]
    rows = {(r.symbol, r.trade_date): r for r in got.collect()}
    first = rows[("RELIANCE", date(2026, 8, 14))]
    assert (first.exchange, first.close, first.total_traded_qty, first.deliv_pct) == (
        "NSE", 105.5, 1000, None)
    assert first.source_file == "2026-08-14.csv" and not first.is_sme
    small = rows[("SMALL", date(2026, 8, 14))]
    assert small.is_sme and small.deliv_qty == 40
    odd = rows[("ODD", date(2026, 8, 14))]
    assert odd.total_traded_qty == 1 and odd.close is None
    assert len(rows) == 4
    totals = X.load_totals(got).first()
    assert (totals.files, totals.rows) == (2, 4)


def test_missing_columns_are_named(spark, tmp_path):
    write(tmp_path / "x.csv", "SYMBOL, SERIES", "A, EQ")
    with pytest.raises(ValueError, match="DELIV_PER"):
        X.read_daily_prices(spark, str(tmp_path))


def test_a_file_with_another_layout_fails(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER, line("A"))
    write(tmp_path / "b.csv", HEADER.replace("SYMBOL, SERIES", "SERIES, SYMBOL"), line("B"))
    with pytest.raises(Exception):  # noqa: B017
        X.read_daily_prices(spark, str(tmp_path)).collect()


def test_symbol_masters(spark, tmp_path):
    write(tmp_path / "main.csv", "SYMBOL,NAME OF COMPANY, SERIES, DATE OF LISTING, FACE VALUE",
          "ABC,Abc Limited, EQ, 06-OCT-2008, 10", "NOSERIES,Name,,1-Jan-2001,1")
    write(tmp_path / "sme.csv", "SYMBOL, NAME OF COMPANY, SERIES, MARKET LOT",
          "TINY, Tiny Ltd, ST, 1200")
    rows = {r.symbol: r for r in X.read_symbol_masters(spark, {
        "http://main": str(tmp_path / "main.csv"),
        "http://sme": str(tmp_path / "sme.csv")}).collect()}
    assert set(rows) == {"ABC", "TINY"}
    assert rows["ABC"].date_of_listing == date(2008, 10, 6) and rows["ABC"].face_value == 10.0
    assert rows["TINY"].is_sme and rows["TINY"].market_lot == 1200
    assert (rows["TINY"].source_url, rows["TINY"].face_value) == ("http://sme", None)


def test_first_data_dates(spark, tmp_path):
    write(tmp_path / "2026-08-14.csv", HEADER, line("A"), line("B", day="01-Jan-2000"))
    write(tmp_path / "2026-08-16.csv", HEADER, '"A", EQ, "14-Aug-2026", 1')
    write(tmp_path / "2026-08-17.csv", HEADER)
    write(tmp_path / "2026-08-18.csv", HEADER, "A, EQ")
    got = {r.source_file[:10]: r.internal_date
           for r in C.first_data_dates(spark, str(tmp_path)).collect()}
    assert got == {"2026-08-14": "14-Aug-2026", "2026-08-16": "14-Aug-2026",
                   "2026-08-17": None, "2026-08-18": None}


def test_calendar_and_manifest(spark, tmp_path):
    write(tmp_path / "2026-08-14.csv", HEADER, line("A"))
    days = C.calendar_days(spark, date(2026, 8, 12), date(2026, 8, 20))
    fetches = spark.createDataFrame([
        (date(2026, 8, 13), 200, 5, "13-Aug-2026", True),
        (date(2026, 8, 14), 200, 9, "14-Aug-2026", False),
        (date(2026, 8, 15), 200, 9, "14-Aug-2026", False),
        (date(2026, 8, 17), 404, 1, None, False), (date(2026, 8, 18), 503, 1, None, False),
        (date(2026, 8, 19), 200, 7, "18-Aug-2026", False),
        (date(2026, 8, 20), 200, 7, None, False),
    ], "day date, http_code int, bytes bigint, internal_date string, cached boolean")
    got = C.classify_days(days, fetches)
    rows = {r.day.day: (r.status, r.note) for r in got.collect()}
    assert rows == {
        12: ("error", "request failed"), 13: ("skipped", "already cached"), 14: ("valid", None),
        15: ("nodata", "weekend"), 16: ("nodata", "weekend"), 17: ("nodata", "404 holiday"),
        18: ("error", "unexpected status"), 19: ("nodata", "stale/echoed content"),
        20: ("nodata", "stale/echoed content")}
    assert {r.status: r.n_days for r in C.status_totals(got).collect()} == {
        "valid": 1, "skipped": 1, "nodata": 5, "error": 2}
    prints = C.file_fingerprints(spark, str(tmp_path))
    log = str(tmp_path / "log")
    for _ in range(2):
        C.append_manifest(C.manifest_rows(got, prints, "http://x/{ddMMyyyy}.csv"), log)
    logged = spark.read.parquet(log)
    assert logged.count() == 16
    valid = logged.where("status = 'valid'").first()
    assert valid.url == "http://x/14082026.csv" and len(valid.sha256_12) == 12
    assert logged.where("sha256_12 IS NOT NULL").count() == 2


def test_default_range(spark):
    df = spark.createDataFrame([(date(2026, 8, 19),), (date(2024, 2, 29),)], "d date")
    got = df.select(C.default_range("d")[0].alias("a")).collect()
    assert [r.a for r in got] == [date(2024, 8, 19), date(2022, 2, 28)]


def test_messages_requests_and_commands(spark):
    rows = [("telegram", 1, 1, "hi", "2026-08-01 00:00:00"), ("telegram", 1, 2, "", "2026-08-01 00:00:00"),
            ("telegram", 1, 3, "old", "2026-01-01 00:00:00"), ("mail", 1, 4, "x", "2026-08-01 00:00:00"),
            ("telegram", 1, 5, " /HELP ", "2026-08-01 00:00:00")]
    landed = spark.createDataFrame(
        rows, "source string, channel_id bigint, message_id bigint, text string, p string"
    ).withColumn("posted_at", F.to_timestamp("p"))
    recent = M.recent_messages(landed, now=datetime(2026, 8, 19), days=90)
    assert sorted(r.message_id for r in recent.collect()) == ["1", "5"]
    assert [r.message_id for r in M.drop_commands(recent).collect()] == ["1"]
    requests = spark.createDataFrame(
        [("a" * 4000, "manual"), ("a" * 4001, "manual"), ("", "x"), ("t", "fax"), (None, "x")],
        "text string, source string")
    good, bad = M.split_requests(requests)
    assert good.count() == 1 and bad.count() == 4


def test_chat_updates(spark):
    updates = [
        {"update_id": 1}, {"message": {"chat": {"id": 5}, "text": "hello"}},
        {"edited_message": {"chat": {"id": 6}, "text": "edit"}},
        {"message": {}, "edited_message": {"chat": {"id": 7}, "text": "second"}},
        {"message": {"chat": {"id": 8}}}, {"message": {"text": "no chat"}},
        {"message": {"chat": {"id": 9}, "text": ""}},
    ]
    df = spark.createDataFrame([(json.dumps(u),) for u in updates], "update string")
    assert sorted((r.chat_id, r.text) for r in M.parse_updates(df).collect()) == [
        (5, "hello"), (6, "edit"), (7, "second")]


def prices(spark, *rows):
    return spark.createDataFrame(
        list(rows), "exchange string, symbol string, series string, trade_date date, "
                    "close double, source_file string")


@pytest.mark.parametrize("month_of", [None, "trade_date"])
def test_upsert(spark, month_of):
    path = scratch_path(spark, "upsert")
    a = ("NSE", "A", "EQ", date(2026, 7, 31))
    b = ("NSE", "A", "EQ", date(2026, 8, 3))
    load = prices(spark, (*a, 1.0, "f1"), (*b, 2.0, "f1"), (*b, 3.0, "f2"))
    for _ in range(2):
        T.upsert(load, path, SESSION_KEY, month_of=month_of, order_by="source_file")
        got = {r.trade_date: r.close for r in spark.read.parquet(path).collect()}
        assert got == {a[3]: 1.0, b[3]: 3.0} and spark.read.parquet(path).count() == 2
    T.upsert(prices(spark, (*b, 9.0, "f3"), ("NSE", "B", "EQ", b[3], 5.0, "f3")), path,
             SESSION_KEY, month_of=month_of, order_by="source_file")
    rows = spark.read.parquet(path)
    assert rows.count() == 3
    assert {(r.symbol, r.trade_date): r.close for r in rows.collect()} == {
        ("A", a[3]): 1.0, ("A", b[3]): 9.0, ("B", b[3]): 5.0}


def test_serving_store(spark, tmp_path):
    features = spark.createDataFrame(
        [("S", date.fromordinal(date(2026, 1, 1).toordinal() + i), 1.0)
         for i in range(100)] + [("T", date(2026, 1, 1), 2.0)],
        "symbol string, trade_date date, x double")
    symbols = spark.createDataFrame([("S",), ("T",)], "symbol string")
    row = T.build_serving_store(symbols, features, str(tmp_path / "store"), 90).first()
    assert (row.n_rows, row.n_dates, row.n_symbols) == (90, 90, 2)
    assert row.last_date == date(2026, 4, 10)
    assert store_summary(serving_features(features, 5)).first().n_rows == 5


def test_texts_that_are_no_number_cost_no_more_than_numbers(spark):
    def seconds(text):
        rows = spark.range(0, 1_000_000, numPartitions=2).select(to_long(F.concat(
            F.lit(text), F.when(F.col("id") < 0, "x").otherwise(""))).alias("n"))
        start = time.perf_counter()
        rows.agg(F.sum("n")).collect()
        return time.perf_counter() - start

    assert min(seconds("-") for _ in range(2)) < 4 * min(seconds("12") for _ in range(2)) + 1


def test_whole_numbers_as_a_cast_reads_them(spark):
    texts = ["12", "+7", "-3", "\x0112\x7f", "12.0", "1e2", "2.5", "-", "", "9" * 30]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        to_long(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [12, 7, -3, 12, 12, 100, None, None, None, None]
