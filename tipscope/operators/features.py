"""Backward-looking market features of every security and session."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tipscope.functions.coerce import finite
from tipscope.operators.latest import latest_features
from tipscope.operators.sessions import block_window, cut_blocks, number_sessions
from tipscope.schemas import SECURITY_KEY, SESSION_KEY, require_columns

REQUIRED_COLUMNS = (
    "trade_date", "close", "high", "low", "prev_close", "total_traded_qty", "turnover_lacs",
    "deliv_pct",
)
FEATURE_COLUMNS = (
    "runup_5d", "runup_10d", "runup_20d", "volume_zscore_60d", "delivery_pct",
    "delivery_pct_trend_10d", "upper_circuit_count_10d", "trailing_median_turnover_20d",
    "liquidity_bucket", "days_since_listing", "is_sme",
)
# Farthest look-back of any frame below, in sessions.
LOOK_BACK = 60
MIN_HISTORY = 21
# Turnover edges of the liquidity buckets.
LIQUIDITY_EDGES = (100.0, 1000.0, 10000.0)
LIQUIDITY_LABELS = ("micro", "small", "mid", "large")


# Each windowed feature comes as a pair: the window columns it needs, and its value made from
# them. The window columns are added first, so each is computed once however often a value
# mentions it.


def trailing_return(close: str, sessions: int, w: WindowSpec) -> tuple[dict[str, Column], Column]:
    before = f"_{close}_{sessions}"
    return ({before: F.lag(close, sessions).over(w)},
            F.col(close) / F.nullif(F.col(before), F.lit(0.0)) - 1.0)


def volume_zscore(volume: str, w: WindowSpec, *, sessions: int = 60, min_periods: int = 20,
                  whole_numbers: bool = False) -> tuple[dict[str, Column], Column]:
    """Today's volume against the sessions before it; a flat baseline has no z-score.

    Whole-number volumes use differences of running sums, which cost the same for any frame
    length. The sums are decimals: exact, so a flat baseline shows a scatter of exactly zero.
    """
    today = F.col(volume)
    if whole_numbers:
        exact = today.cast("decimal(18,0)")
        summed = {"n": F.when(today.isNotNull(), 1).otherwise(0), "s": exact, "q": exact * exact}
        frames = {"until": w.rowsBetween(Window.unboundedPreceding, -1),
                  "before": w.rowsBetween(Window.unboundedPreceding, -sessions - 1)}
        needs = {f"_v{k}_{end}": F.sum(value).over(frame)
                 for k, value in summed.items() for end, frame in frames.items()}

        def prior(k: str) -> Column:
            return F.coalesce(f"_v{k}_until", F.lit(0)) - F.coalesce(f"_v{k}_before", F.lit(0))

        n, count = prior("n"), prior("n").cast("double")
        scatter = (n.cast("decimal(10,0)") * prior("q") - prior("s") * prior("s")).cast("double")
        mean = prior("s").cast("double") / F.nullif(count, F.lit(0.0))
        spread = F.sqrt(scatter / F.nullif(count * (count - 1.0), F.lit(0.0)))
    else:
        frame = w.rowsBetween(-sessions, -1)
        needs = {"_vn": F.count(volume).over(frame), "_vm": F.avg(volume).over(frame),
                 "_vd": F.stddev_samp(volume).over(frame)}
        n, mean, spread = F.col("_vn"), F.col("_vm"), F.col("_vd")
    value = F.when((n >= min_periods) & (spread > 0.0),
                   (today.cast("double") - mean) / F.nullif(spread, F.lit(0.0)))
    return needs, value


def change_from_mean(value: str, w: WindowSpec, *, sessions: int = 10,
                     min_periods: int = 3) -> tuple[dict[str, Column], Column]:
    prior = w.rowsBetween(-sessions, -1)
    return ({"_dn": F.count(value).over(prior), "_dm": F.avg(value).over(prior)},
            F.when(F.col("_dn") >= min_periods, F.col(value) - F.col("_dm")))


def locked_up(high: Column, low: Column, close: Column, prev_close: Column) -> Column:
    """The whole session traded at one price above the previous close."""
    return F.coalesce((high == low) & (close > prev_close), F.lit(False))


def trailing_count(flag: str, w: WindowSpec, *, sessions: int = 10
                   ) -> tuple[dict[str, Column], Column]:
    frame = w.rowsBetween(-(sessions - 1), 0)
    return {"_lc": F.sum(F.col(flag).cast("bigint")).over(frame)}, F.col("_lc")


def trailing_median(value: str, w: WindowSpec, *, sessions: int = 20,
                    min_periods: int = 5) -> tuple[dict[str, Column], Column]:
    frame = w.rowsBetween(-(sessions - 1), 0)
    n = F.size("_values")
    middle = F.try_element_at("_values", F.floor((n + 1) / 2).cast("int"))
    other = F.try_element_at("_values", (F.floor(n / 2) + 1).cast("int"))
    return ({"_values": F.sort_array(F.collect_list(value).over(frame))},
            F.when(n >= min_periods, (middle + other) / 2.0))


def liquidity_bucket(median: Column) -> Column:
    bucket = F.when(median.isNull(), None)
    for edge, label in zip(LIQUIDITY_EDGES, LIQUIDITY_LABELS):
        bucket = bucket.when(median < edge, label)
    return bucket.otherwise(LIQUIDITY_LABELS[-1])


def with_features(blocks: DataFrame, w: WindowSpec) -> DataFrame:
    """Add every windowed feature."""
    whole = dict(blocks.dtypes)["total_traded_qty"] in ("bigint", "int", "smallint")
    inputs = blocks.withColumns({
        "_close": finite("close"), "_delivery": finite("deliv_pct"),
        "_turnover": finite("turnover_lacs"),
        "_volume": F.col("total_traded_qty") if whole else finite("total_traded_qty"),
        "_locked": locked_up(finite("high"), finite("low"), finite("close"),
                             finite("prev_close")),
    })
    features = {
        "runup_5d": trailing_return("_close", 5, w),
        "runup_10d": trailing_return("_close", 10, w),
        "runup_20d": trailing_return("_close", 20, w),
        "volume_zscore_60d": volume_zscore("_volume", w, whole_numbers=whole),
        "delivery_pct": ({}, F.col("_delivery")),
        "delivery_pct_trend_10d": change_from_mean("_delivery", w),
        "upper_circuit_count_10d": trailing_count("_locked", w),
        "trailing_median_turnover_20d": trailing_median("_turnover", w),
    }
    windowed = inputs.withColumns(
        {name: column for needs, _ in features.values() for name, column in needs.items()})
    return windowed.select(
        *[F.col(c) for c in blocks.columns],
        *[value.alias(name) for name, (_, value) in features.items()])


def finish_features(windowed: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Add the features that need no window and put the columns in table order."""
    return (
        windowed
        .withColumn("liquidity_bucket", liquidity_bucket(F.col("trailing_median_turnover_20d")))
        .withColumn("days_since_listing",
                    F.datediff("trade_date", "date_of_listing").cast("double"))
        .withColumn("is_sme", F.coalesce(F.col("first_is_sme"), F.lit(False)))
        .select(*SESSION_KEY, *FEATURE_COLUMNS, *(extra or []))
    )


def _numbered(prices: DataFrame, symbols: DataFrame | None, min_history: int,
              span: tuple[date, date] | None = None) -> DataFrame:
    require_columns(prices, [*SECURITY_KEY, *REQUIRED_COLUMNS], "price history")
    if "is_sme" not in prices.columns:
        prices = prices.withColumn("is_sme", F.lit(False))
    used = prices.select(*SECURITY_KEY, *REQUIRED_COLUMNS, "is_sme")
    return number_sessions(used, symbols, span=span).where(F.col("sessions") >= min_history)


def market_features(prices: DataFrame, symbols: DataFrame | None = None, *,
                    min_history: int = MIN_HISTORY, only: list[str] | None = None,
                    span: tuple[date, date] | None = None) -> DataFrame:
    """Features of all sessions of all securities with at least ``min_history`` sessions.

    ``prices`` holds one row per security and trade date. ``symbols`` supplies listing dates;
    without it the listing age is missing. The look-back copies of a block are dropped at the
    end, so each session comes out once.

    With a ``span`` (first and last day) sessions that cannot be the newest before any of its days may
    be left out: all from its last day on, and those before the last one of the year before its first.
    """
    numbered = _numbered(prices, symbols, min_history, span)
    if span is not None:
        numbered = numbered.where(F.col("session") >= F.col("earlier") - LOOK_BACK)
    blocks = cut_blocks(numbered, back=LOOK_BACK)
    windowed = with_features(blocks, block_window()).where(~F.col("is_copy"))
    if span is not None:
        windowed = windowed.where(F.col("session") >= F.col("earlier"))
    features = finish_features(windowed)
    return features if only is None else features.select(*SESSION_KEY, *only)


def newest_features(prices: DataFrame, symbols: DataFrame | None = None, *,
                    min_history: int = MIN_HISTORY) -> DataFrame:
    """``latest_features(market_features(...))`` straight from prices.

    Only the sessions that a security's last session looks back to go through the windows.
    """
    numbered = _numbered(prices, symbols, min_history)
    recent = numbered.where(F.col("session") >= F.col("sessions") - LOOK_BACK)
    windowed = with_features(cut_blocks(recent, back=LOOK_BACK), block_window()).where(
        ~F.col("is_copy") & (F.col("session") == F.col("sessions")))
    return latest_features(finish_features(windowed))
