"""The stored features after any loads are those of a full computation."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from test_features import SCHEMA, business_days, history
from tipscope.operators.features import market_features
from tipscope.plans import feature_store as FS
from tipscope.schemas import SESSION_KEY
from tipscope.session import scratch_path
from tipscope.sources import snapshots as S


def load(rows, root, **options):
    return S.load_snapshot(rows, root, SESSION_KEY, month_of="trade_date", **options)


def listings(spark, **days):
    return spark.createDataFrame([("NSE", s, "EQ", d) for s, d in days.items()],
                                 "exchange string, symbol string, series string, "
                                 "date_of_listing date")


def check(spark, prices_root, features_root, symbols=None, **options):
    got = S.read_snapshot(spark, features_root)
    want = market_features(S.read_snapshot(spark, prices_root), symbols, **options)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def panel(rng, days, symbols, *, share=0.85):
    return [("NSE", s, "EQ", d, rng.uniform(50, 99), rng.choice([99.0, None, float("nan")]), 40.0,
             rng.uniform(50, 99), rng.randrange(1, 9999), rng.uniform(1, 20000),
             rng.choice([None, 40.0, 60.0]), rng.random() < 0.5)
            for s in symbols for d in days if rng.random() < share]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_loads(spark, seed):
    rng = random.Random(seed)
    prices, features = scratch_path(spark, "prices"), scratch_path(spark, "features")
    days = business_days(420)
    master = listings(spark, A=date(2024, 1, 1), C=date(2024, 6, 1))
    load(spark.createDataFrame(panel(rng, days[40:300], "ABC"), SCHEMA), prices)
    assert FS.refresh_features(spark, prices, features, master).rebuilt
    check(spark, prices, features, master)
    loads = [
        panel(rng, days[rng.randrange(290):][:9], "AB"),                  # late and corrected rows
        panel(rng, days[300:310], "ABCD"),                                # new days, a new security
        panel(rng, days[310:345], "D", share=1.0) + panel(rng, days[5:8], "B"),  # an earlier start
    ]
    for rows in loads:
        load(spark.createDataFrame(rows, SCHEMA), prices)
        assert not FS.refresh_features(spark, prices, features, master).rebuilt
        check(spark, prices, features, master)
    other = listings(spark, A=date(2024, 1, 1), C=date(2024, 7, 1))
    assert FS.refresh_features(spark, prices, features, other).months_read
    check(spark, prices, features, other)


def test_a_days_load_reads_the_last_months_only(spark):
    prices, features = scratch_path(spark, "prices"), scratch_path(spark, "features")
    whole = history(spark, 700).unionByName(history(spark, 700, symbol="XYZ"))
    last = business_days(700)[-1]
    load(whole.where(F.col("trade_date") < last), prices)
    first = FS.refresh_features(spark, prices, features)
    assert len(first.months_read) > 30
    load(whole.where(F.col("trade_date") == last), prices)
    stored = S.read_version(spark, features)
    second = FS.refresh_features(spark, prices, features)
    assert len(second.months_read) <= 5
    after = S.read_version(spark, features)
    assert sum(after.months[m] != stored.months.get(m) for m in after.months) <= 1
    check(spark, prices, features)
    assert FS.refresh_features(spark, prices, features) == FS.Refresh(second.version, [], False)
    load(whole.where(F.col("trade_date") == last), prices)  # the same rows again
    assert FS.refresh_features(spark, prices, features).months_read == []
    check(spark, prices, features)


def test_removed_rows_and_other_settings_compute_everything(spark):
    prices, features = scratch_path(spark, "prices"), scratch_path(spark, "features")
    rows = history(spark, 90)
    gone = business_days(90)[30]
    load(rows, prices)
    FS.refresh_features(spark, prices, features)
    load(rows.where(F.col("trade_date") != gone), prices, replace=True)
    assert FS.refresh_features(spark, prices, features).rebuilt
    check(spark, prices, features)
    assert FS.refresh_features(spark, prices, features, min_history=80).rebuilt
    load(rows, prices)
    S.drop_old_versions(spark, prices, keep=1)
    assert FS.refresh_features(spark, prices, features, min_history=80).rebuilt
    check(spark, prices, features, min_history=80)


def test_a_refresh_that_dies_leaves_the_old_features(spark, monkeypatch):
    prices, features = scratch_path(spark, "prices"), scratch_path(spark, "features")
    rows = history(spark, 60)
    day = business_days(60)[50]
    load(rows.where(F.col("trade_date") < day), prices)
    FS.refresh_features(spark, prices, features)
    before = S.read_snapshot(spark, features).count()
    load(rows, prices)

    def die(*args, **options):
        raise OSError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(S, "commit", die)
        with pytest.raises(OSError):
            FS.refresh_features(spark, prices, features)
    assert S.read_snapshot(spark, features).count() == before
    FS.refresh_features(spark, prices, features)
    check(spark, prices, features)


def test_empty_and_short(spark):
    prices, features = scratch_path(spark, "prices"), scratch_path(spark, "features")
    with pytest.raises(ValueError, match="no stored prices"):
        FS.refresh_features(spark, prices, features)
    load(history(spark, 0), prices)
    FS.refresh_features(spark, prices, features)
    assert S.read_snapshot(spark, features).count() == 0
    load(history(spark, 20), prices)
    FS.refresh_features(spark, prices, features)
    assert S.read_snapshot(spark, features).count() == 0
    load(history(spark, 25).unionByName(
        history(spark, 1).withColumn("trade_date", F.lit(None).cast("date"))), prices)
    FS.refresh_features(spark, prices, features)
    assert S.read_snapshot(spark, features).count() == 25
