"""Declared table schemas and their keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SECURITY_KEY = ["exchange", "symbol", "series"]
SESSION_KEY = [*SECURITY_KEY, "trade_date"]
MESSAGE_KEY = ["source", "channel_id", "message_id"]


def _schema(spec: str) -> T.StructType:
    """``"name type, name type"`` as a StructType, without needing a live session."""
    kinds = {
        "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
        "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
        "int": T.IntegerType(),
    }
    return T.StructType([
        T.StructField(name, kinds[kind])
        for name, kind in (item.split() for item in spec.split(","))
    ])


SYMBOLS = _schema(
    "exchange string, symbol string, series string, name string, isin string, "
    "face_value double, market_lot bigint, date_of_listing date, is_sme boolean, "
    "source_url string, loaded_at timestamp"
)
DAILY_PRICES = _schema(
    "exchange string, symbol string, series string, trade_date date, prev_close double, "
    "open double, high double, low double, last double, close double, avg_price double, "
    "total_traded_qty bigint, turnover_lacs double, num_trades bigint, deliv_qty bigint, "
    "deliv_pct double, is_sme boolean, source_file string"
)
MARKET_FEATURES = _schema(
    "exchange string, symbol string, series string, trade_date date, runup_5d double, "
    "runup_10d double, runup_20d double, volume_zscore_60d double, delivery_pct double, "
    "delivery_pct_trend_10d double, upper_circuit_count_10d bigint, "
    "trailing_median_turnover_20d double, liquidity_bucket string, "
    "days_since_listing double, is_sme boolean"
)
CHANNEL_MESSAGES = _schema(
    "source string, channel_id string, message_id string, text string, posted_at timestamp"
)
CHANNEL_MENTIONS = _schema(
    "source string, channel_id string, message_id string, ticker string, posted_at timestamp"
)
INGEST_MANIFEST = _schema(
    "date date, url string, http_code int, bytes bigint, status string, "
    "internal_date string, sha256_12 string, retrieved_at_utc timestamp"
)


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    """Raise ``ValueError`` naming every column of ``names`` that ``df`` lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
