"""Scores as of a message's own time against the plain operators at that time."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_features import business_days, noisy, rows
from tipscope.operators import sessions as sessions_module
from tipscope.operators.as_of import bursts_as_of, days_asked, features_as_of
from tipscope.operators.bursts import burst_stats
from tipscope.operators.features import market_features
from tipscope.operators.skew import lookup_join
from tipscope.plans import registry
from tipscope.plans import scoring as P
from tipscope.plans.driver_tables import engine_table

START = datetime(2026, 3, 1)


def mention_rows(seed=0, n=400):
    """Quiet weeks, a crowd, repeats, equal times, window ends hit exactly, and nulls."""
    rnd = random.Random(seed)
    rows = [(f"c{rnd.randrange(6)}", rnd.choice("AAB"), START + timedelta(
        minutes=rnd.randrange(0, 120 * 24 * 60, 7))) for _ in range(n)]
    rows += [(f"p{k}", "A", START + timedelta(days=100, hours=k)) for k in range(8)]
    rows += [("p0", "A", START + timedelta(days=100, hours=48)), ("p0", "A", START),
             ("p1", "A", START + timedelta(hours=48)), (None, "A", START),
             ("p2", None, START), ("q", "ONE", START + timedelta(days=3, microseconds=1))]
    return rows + rows[:20]


def mentions(spark, seed=0):
    return spark.createDataFrame(mention_rows(seed),
                                 "channel_id string, ticker string, posted_at timestamp")


@pytest.mark.parametrize("windows", [{}, {"window_hours": 60, "baseline_days": 40,
                                          "step_hours": 36}, {"baseline_days": 1}])
def test_bursts_as_of_equal_burst_stats_at_each_time(spark, windows):
    df = mentions(spark).where("channel_id IS NOT NULL")
    rnd = random.Random(3)
    times = sorted(rnd.sample(sorted({r[2] for r in mention_rows() if r[1]}), 6))
    times += [START + timedelta(days=100, hours=49), START - timedelta(days=1)]
    asked = spark.createDataFrame(
        [(t, at) for at in times for t in ("A", "B", "ONE", "A", None)] + [("A", None)],
        "ticker string, as_of timestamp")
    got = {(r.ticker, r.as_of): r for r in bursts_as_of(asked, df, **windows).collect()}
    assert len(got) == 3 * len(set(times))
    for at in times:
        for want in burst_stats(df, at, **windows).collect():
            found = got[want.ticker, at]
            assert (found.n_channels, found.is_burst) == (want.n_channels, want.is_burst)
            for name in ("baseline_mean", "baseline_std", "z"):
                assert found[name] == pytest.approx(want[name]), (want.ticker, at, name)
    assert any(r.is_burst for r in got.values()) or windows


def test_sample_times_are_made_after_the_shuffle(spark):
    df = mentions(spark)
    asked = df.select("ticker", F.col("posted_at").alias("as_of"))
    whole = bursts_as_of(asked, df)
    assert sorted(map(repr, bursts_as_of(asked, df, group_pairs=2).collect())) == sorted(
        map(repr, whole.collect()))
    lines = whole._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffled = next(k for k, line in enumerate(lines) if "Window [sum" in line)
    assert not any("Exchange" in line for line in lines[:shuffled])


def test_bursts_of_tickers_nobody_named(spark):
    asked = spark.createDataFrame([("NEW", START)], "ticker string, as_of timestamp")
    for df in (mentions(spark), mentions(spark).limit(0)):
        row = bursts_as_of(asked, df).first()
        assert (row.n_channels, row.baseline_mean, row.z, row.is_burst) == (0, 0.0, 0.0, False)
    assert bursts_as_of(asked.limit(0), mentions(spark)).count() == 0
    with pytest.raises(ValueError):
        bursts_as_of(asked, mentions(spark), window_hours=0)


def sessions(spark):
    rows = [(e, s, "EQ", date(2026, 3, d), float(d) + (e == "NSE") / 10)
            for e, s in (("BSE", "A"), ("NSE", "A"), ("NSE", "B")) for d in (2, 3, 6)]
    return spark.createDataFrame(rows + [("NSE", None, "EQ", date(2026, 3, 2), 0.0)],
                                 "exchange string, symbol string, series string, "
                                 "trade_date date, x double")


def test_features_are_those_of_the_newest_session_before_the_day(spark):
    asked = spark.createDataFrame(
        [(t, date(2026, 3, d)) for t in ("A", "B", "C") for d in (1, 2, 3, 4, 6, 30)]
        + [("A", date(2026, 3, 4)), (None, date(2026, 3, 4)), ("A", None)],
        "ticker string, day date")
    got = {(r.ticker, r.day.day): (r.exchange, r.trade_date.day, r.x)
           for r in features_as_of(asked, sessions(spark)).collect()}
    newest = {3: 2, 4: 3, 6: 3, 30: 6}
    assert got == {(t, d): (e, s, s + (e == "NSE") / 10)
                   for t, e in (("A", "BSE"), ("B", "NSE")) for d, s in newest.items()}
    assert features_as_of(asked, sessions(spark).limit(0)).count() == 0


def test_features_are_read_once(spark):
    asked = spark.createDataFrame([("A", date(2026, 3, 4))], "ticker string, day date")
    plan = features_as_of(asked, sessions(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("symbol#") > 0


def factors(spark):
    rows = [("NSE", "SUZLON", "EQ", date(2026, 3, 1) + timedelta(days=d), 0.5, 3, 4.0, "micro",
             True, 10.0, p) for d, p in ((0, 0.2), (40, 0.9))]
    return spark.createDataFrame(
        rows, "exchange string, symbol string, series string, trade_date date, runup_20d double, "
              "upper_circuit_count_10d bigint, volume_zscore_60d double, liquidity_bucket string, "
              "is_sme boolean, days_since_listing double, susceptibility double")


def test_tips_are_scored_by_what_was_known(spark):
    """Before the crowd, after it, without a session, without a ticker."""
    crowd = [(f"c{k}", "SUZLON", START + timedelta(days=45, hours=k)) for k in range(5)]
    named = spark.createDataFrame(crowd, "channel_id string, ticker string, posted_at timestamp")
    at = {"early": START + timedelta(hours=5), "late": START + timedelta(days=20),
          "risen": START + timedelta(days=42), "crowd": START + timedelta(days=45, hours=6)}
    posts = spark.createDataFrame(
        [("telegram", "c", k, "buy SUZLON now, sure shot!", t) for k, t in at.items()]
        + [("telegram", "c", "none", "buy now", START), ("telegram", "c", "when", "SUZLON", None)],
        "source string, channel_id string, message_id string, text string, posted_at timestamp")
    master = spark.createDataFrame([("SUZLON", "Suzlon Energy")], "symbol string, name string")
    tips = P.parse_tips(posts, master)
    scored = {r.message_id: r for r in P.score_tips_as_posted(
        tips, factors(spark), named).collect()}
    assert set(scored) == {*at, "none", "when"}
    assert {k: r.model_susceptibility for k, r in scored.items()} == {
        "early": 0.0, "late": 0.2, "risen": 0.9, "crowd": 0.9, "none": 0.0, "when": 0.0}
    assert {k: r.confidence for k, r in scored.items()} == {
        "early": 0.6, "late": 0.9, "risen": 0.9, "crowd": 0.9, "none": 0.5, "when": 0.6}
    assert scored["late"].value < scored["risen"].value < scored["crowd"].value
    assert scored["crowd"].band == "high"
    reasons = {c.code: c.reason for c in scored["crowd"].contributions}
    assert "5" in reasons["coordination_burst"] and "(" in reasons["market_susceptibility"]
    # The same as scoring everything at the tip's time.
    for name, when in at.items():
        before = factors(spark).where(F.col("trade_date") < F.lit(when).cast("date"))
        bursts = burst_stats(named, when)
        one = P.score_tips(tips.where(F.col("message_id") == name), before.orderBy(
            F.desc("trade_date")).limit(1), bursts).first()
        for column in ("value", "band", "confidence", "model_susceptibility", "contributions"):
            assert one[column] == scored[name][column], (name, column)
    plain = P.score_messages(posts, master, as_of="posted_at").collect()
    assert {r.message_id for r in plain} == set(scored)


@pytest.mark.parametrize("rows", [0, 10_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_equals_a_plain_join(spark, rows, how):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"))
    small = spark.createDataFrame([("hot", 1), (None, 2), *[(f"k{i}", i) for i in range(0, 2000, 7)]],
                                  "key string, value int")
    want = big.join(small, "key", how).select("id", "key", "value")
    got = lookup_join(big, small, "key", spread_by=["id"], how=how, rows=rows)
    assert sorted(map(repr, got.select("id", "key", "value").collect())) == sorted(
        map(repr, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (rows == 0)
    assert math.isclose(got.count(), want.count())


@pytest.mark.parametrize("first, last", [(400, 430), (0, 20), (560, 900), (261, 262), (-40, -10)])
def test_features_of_a_span_are_all_that_its_days_ask_for(spark, monkeypatch, first, last):
    """Over three years; in the second symbol's history a gap lies before the span."""
    monkeypatch.setattr(sessions_module.cut_blocks, "__kwdefaults__",
                        {"back": 0, "ahead": 0, "block": 64})
    days = business_days(600)
    gap = F.col("trade_date").between(days[300], days[420])
    prices = noisy(spark, 600).unionByName(
        noisy(spark, 600, seed=9).withColumn("symbol", F.lit("XYZ")).where(~gap))
    at = [days[0] + timedelta(days=round(k * 1.4)) for k in (first, (first + last) // 2, last)]
    asked = spark.createDataFrame(
        [(t, d) for t in ("ABC", "XYZ", "NONE") for d in at] + [(None, days[0]), ("ABC", None)],
        "ticker string, day date")
    span = days_asked(asked)
    assert span == (at[0], at[-1])
    everything = market_features(prices, min_history=1)
    few = market_features(prices, min_history=1, span=span)
    assert rows(features_as_of(asked, few)) == rows(features_as_of(asked, everything))
    assert few.count() < everything.count()
    assert few.where(F.col("trade_date") >= at[-1]).count() == 0
    assert days_asked(asked.where("ticker IS NULL")) is None


def test_rows_are_stored_before_they_are_ranked(spark, monkeypatch):
    """So that ranked rows meet the sizes of their years without another shuffle."""
    stored = []
    monkeypatch.setattr(sessions_module, "materialize",
                        lambda df, label: stored.append(df) or df.localCheckpoint())
    prices = noisy(spark, 30).select("exchange", "symbol", "series", "trade_date", "is_sme")
    assert sessions_module.number_sessions(prices).count() == 30
    plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    assert len(stored) == 1 and "Window" not in plan and "Exchange" not in plan


def test_stored_tips_leave_their_ids_behind(spark, monkeypatch):
    posts = spark.createDataFrame(
        [("telegram", "c", str(k), "buy now", START) for k in range(4)],
        "source string, channel_id string, message_id string, text string, posted_at timestamp")
    named = posts.select("source", "channel_id", "message_id", F.lit("A").alias("ticker"), "posted_at")
    monkeypatch.setattr(registry, "messages", lambda *_: posts)
    monkeypatch.setattr(registry, "crowded", lambda *_: named)
    tips = registry._crowded_tips(spark, "")
    kept = spark.read.parquet(*tips.inputFiles()).columns
    assert "tip_id" not in kept and "message_id" in kept
    want = {r.message_id: r.tip_id for r in P.parse_tips(posts).collect()}
    assert {r.message_id: r.tip_id for r in tips.collect()} == want


def test_line_items_are_shuffled_before_they_become_prices(spark, tmp_path):
    items = [(k, k % 3, 1 + k % 2, 5.0 + k, 1000.0 * k, 0.1, "N" if k % 2 else "R",
              datetime(2026, 1, 1 + k % 4)) for k in range(40)]
    spark.createDataFrame(
        items, "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
               "l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = engine_table(spark, str(tmp_path), "DAILY_PRICES")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan
    got = {(r.symbol, r.trade_date.day): (r.close, r.high, r.num_trades) for r in found.collect()}
    for supplier in range(3):
        for day in range(4):
            mine = [k for k in range(40) if k % 3 == supplier and k % 4 == day]
            assert got[f"SUP0000{supplier}", day + 1] == (
                100 + max(mine) / 2, 100 + max(mine) / 2, len(mine))
