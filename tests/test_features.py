"""Hand-computed features, and properties every backward-looking feature must have."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tipscope.operators import sessions
from tipscope.operators.features import FEATURE_COLUMNS, market_features, newest_features
from tipscope.operators.latest import latest_features
from tipscope.operators.sessions import cut_blocks, number_sessions

SCHEMA = ("exchange string, symbol string, series string, trade_date date, close double, "
          "high double, low double, prev_close double, total_traded_qty bigint, "
          "turnover_lacs double, deliv_pct double, is_sme boolean")


def business_days(n, start=date(2025, 1, 1)):
    day, out = start, []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


def history(spark, n=30, symbol="ABC", sme=False, **columns):
    closes = columns.get("close", [100.0 + i for i in range(n)])
    closes = [None if c is None else float(c) for c in closes]

    def pick(name, default):
        values = columns.get(name, default)
        return values if name == "qty" else [None if v is None else float(v) for v in values]

    rows = []
    for i, day in enumerate(business_days(n)):
        rows.append((
            "NSE", symbol, "EQ", day, closes[i], pick("high", closes)[i],
            pick("low", [c - 1 if c is not None else None for c in closes])[i],
            pick("prev_close", [None, *closes[:-1]])[i], pick("qty", [1000] * n)[i],
            pick("turnover", [500.0] * n)[i], pick("delivery", [40.0] * n)[i], sme))
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "trade_date").select(name).collect()]


def feature(prices, name, **options):
    return column(market_features(prices, min_history=1, **options), name)


def test_runups(spark):
    out = market_features(history(spark), min_history=1).orderBy("trade_date").collect()
    assert out[4].runup_5d is None
    assert out[10].runup_5d == pytest.approx(110 / 105 - 1)
    assert out[20].runup_10d == pytest.approx(120 / 110 - 1)
    assert out[25].runup_20d == pytest.approx(125 / 105 - 1)


def test_zero_price_before_gives_null(spark):
    assert feature(history(spark, 6, close=[0.0, 1, 1, 1, 1, 2]), "runup_5d")[5] is None


def test_volume_spike_and_short_baseline(spark):
    rng = random.Random(1)
    qty = [int(rng.gauss(1000, 50)) for _ in range(39)] + [8000]
    z = feature(history(spark, 40, qty=qty), "volume_zscore_60d")
    assert z[-1] > 5
    assert z[19] is None and z[20] is not None


def test_volume_zscore_equals_definition(spark):
    rng = random.Random(3)
    qty = [rng.randrange(1, 10**9) for _ in range(90)]
    qty[50] = None
    z = feature(history(spark, 90, qty=qty), "volume_zscore_60d")
    for i in (21, 49, 51, 70, 89):
        base = [q for q in qty[max(0, i - 60):i] if q is not None]
        mean = sum(base) / len(base)
        std = (sum((q - mean) ** 2 for q in base) / (len(base) - 1)) ** 0.5
        assert z[i] == pytest.approx((qty[i] - mean) / std, rel=1e-9)
    assert z[50] is None


def test_flat_volume_has_no_zscore_even_after_a_wild_past(spark):
    qty = [10**12 + i * 977 for i in range(30)] + [1000] * 61
    assert feature(history(spark, 91, qty=qty), "volume_zscore_60d")[-1] is None


def test_fractional_volume_uses_the_same_definition(spark):
    whole = history(spark, 40, qty=[1000 + 7 * (i % 5) for i in range(40)])
    as_double = whole.withColumn("total_traded_qty", F.col("total_traded_qty").cast("double"))
    a, b = feature(whole, "volume_zscore_60d"), feature(as_double, "volume_zscore_60d")
    assert a[25:] == pytest.approx(b[25:])


def test_delivery(spark):
    prices = history(spark, 31, delivery=[30.0] * 30 + [55.0])
    assert feature(prices, "delivery_pct")[-1] == 55.0
    trend = feature(prices, "delivery_pct_trend_10d")
    assert trend[-1] == pytest.approx(25.0)
    assert trend[2] is None and trend[3] == pytest.approx(0.0)


def test_locked_sessions(spark):
    counts = feature(history(
        spark, 5, close=[100.0, 105, 110, 110, 90], high=[100.0, 105, 110, 112, 90],
        low=[100.0, 105, 110, 108, 90], prev_close=[None, 100.0, 105, 110, 110]),
        "upper_circuit_count_10d")
    assert counts == [0, 1, 2, 2, 2]


def test_locked_count_covers_ten_sessions(spark):
    closes = [100.0 + i for i in range(12)]
    counts = feature(history(spark, 12, close=closes, low=closes,
                             prev_close=[99.0, *closes[:-1]]), "upper_circuit_count_10d")
    assert counts[0] == 1 and counts[-1] == 10


@pytest.mark.parametrize("values, median, bucket", [
    ([750.0] * 30, 750.0, "small"), ([20.0] * 30, 20.0, "micro"),
    ([50000.0] * 28 + [1.0, 2.0], 50000.0, "large"), ([1000.0] * 30, 1000.0, "mid"),
])
def test_liquidity(spark, values, median, bucket):
    out = market_features(history(spark, 30, turnover=values), min_history=1)
    assert column(out, "trailing_median_turnover_20d")[-1] == median
    assert column(out, "liquidity_bucket")[-1] == bucket
    assert column(out, "liquidity_bucket")[3] is None


def test_even_window_median_interpolates(spark):
    out = feature(history(spark, 6, turnover=[1.0, 2, 3, 10, 20, 30]),
                  "trailing_median_turnover_20d")
    assert out[4:] == [3.0, 6.5]


def test_listing_age(spark):
    listed = spark.createDataFrame(
        [("NSE", "ABC", "EQ", date(2024, 12, 2))],
        "exchange string, symbol string, series string, date_of_listing date")
    prices = history(spark, 3)
    assert feature(prices, "days_since_listing", symbols=listed)[0] == 30.0
    assert feature(prices, "days_since_listing") == [None] * 3


def test_short_histories_are_left_out(spark):
    both = history(spark, 21, "LONG").unionByName(history(spark, 20, "SHORT"))
    out = market_features(both)
    assert {r.symbol for r in out.select("symbol").distinct().collect()} == {"LONG"}


def test_sme_flag_is_the_earliest_one(spark):
    prices = history(spark, 25).withColumn("is_sme", F.col("trade_date") < date(2025, 1, 3))
    assert set(feature(prices, "is_sme")) == {True}


def test_shape_and_missing_columns(spark):
    out = market_features(history(spark, 40, sme=True), min_history=1)
    assert out.count() == 40 and set(FEATURE_COLUMNS) <= set(out.columns)
    with pytest.raises(ValueError, match="turnover_lacs"):
        market_features(history(spark, 3).drop("turnover_lacs"))


def noisy(spark, n=150, seed=5):
    rng = random.Random(seed)
    closes = [round(rng.uniform(50, 150), 2) for _ in range(n)]
    return history(spark, n, close=closes, qty=[rng.randrange(100, 9000) for _ in range(n)],
                   turnover=[rng.uniform(1, 20000) for _ in range(n)],
                   delivery=[rng.uniform(0, 100) if i % 7 else None for i in range(n)])


def rows(df):
    return sorted(
        tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.collect())


def test_no_look_ahead(spark):
    full = noisy(spark)
    cut = business_days(150)[99]
    early = market_features(full.where(F.col("trade_date") <= cut), min_history=1)
    late = market_features(full, min_history=1).where(F.col("trade_date") <= cut)
    assert list(map(repr, rows(early))) == list(map(repr, rows(late)))


def test_blocks_partitions_and_row_order_do_not_matter(spark, monkeypatch):
    prices = noisy(spark)
    want = list(map(repr, rows(market_features(prices))))
    shuffled = prices.orderBy(F.rand(3)).repartition(7)
    assert list(map(repr, rows(market_features(shuffled)))) == want
    monkeypatch.setattr(sessions.cut_blocks, "__kwdefaults__",
                        {"back": 0, "ahead": 0, "block": 64})
    assert list(map(repr, rows(market_features(prices)))) == want


def test_session_numbers_cross_years(spark):
    days = [date(2023, 12, 28), date(2023, 12, 29), date(2024, 1, 1), date(2025, 6, 2)]
    prices = spark.createDataFrame(
        [("NSE", "A", "EQ", d, False) for d in days],
        "exchange string, symbol string, series string, trade_date date, is_sme boolean")
    out = number_sessions(prices).orderBy("trade_date").collect()
    assert [r.session for r in out] == [1, 2, 3, 4] and {r.sessions for r in out} == {4}


def test_every_session_is_once_its_own_and_copies_reach_far_enough(spark):
    numbered = spark.range(1, 1001).select(
        F.col("id").alias("session"), F.lit(1000).alias("sessions"))
    cut = cut_blocks(numbered, back=60, ahead=60, block=128)
    own = cut.where("NOT is_copy")
    assert own.count() == 1000 and own.select("session").distinct().count() == 1000
    spans = cut.groupBy("block").agg(F.min("session").alias("a"), F.max("session").alias("b"),
                                     F.count("*").alias("n")).orderBy("block").collect()
    for s in spans:
        first, last = s.block * 128 + 1, min(1000, s.block * 128 + 128)
        assert s.a == max(1, first - 60) and s.b == min(1000, last + 60)
        assert s.n == s.b - s.a + 1


@pytest.mark.parametrize("n", [21, 60, 61, 62, 150])
def test_newest_features_equal_the_last_stored_ones(spark, n, monkeypatch):
    monkeypatch.setattr(sessions.cut_blocks, "__kwdefaults__",
                        {"back": 0, "ahead": 0, "block": 64})
    both = noisy(spark, n).unionByName(
        noisy(spark, n - 1, seed=9).withColumn("symbol", F.lit("XYZ")))
    want = rows(latest_features(market_features(both)))
    assert list(map(repr, rows(newest_features(both)))) == list(map(repr, want))
