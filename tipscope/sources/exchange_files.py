"""Daily price files and symbol masters as typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipscope.functions.coerce import clean, is_sme_series, keep, to_date, to_double, to_long
from tipscope.schemas import SECURITY_KEY, SESSION_KEY, require_columns

# Source header names, in file order, and the table columns they fill.
DAILY_COLUMNS = {
    "SYMBOL": ("symbol", keep), "SERIES": ("series", keep), "DATE1": ("trade_date", to_date),
    "PREV_CLOSE": ("prev_close", to_double), "OPEN_PRICE": ("open", to_double),
    "HIGH_PRICE": ("high", to_double), "LOW_PRICE": ("low", to_double),
    "LAST_PRICE": ("last", to_double), "CLOSE_PRICE": ("close", to_double),
    "AVG_PRICE": ("avg_price", to_double), "TTL_TRD_QNTY": ("total_traded_qty", to_long),
    "TURNOVER_LACS": ("turnover_lacs", to_double), "NO_OF_TRADES": ("num_trades", to_long),
    "DELIV_QTY": ("deliv_qty", to_long), "DELIV_PER": ("deliv_pct", to_double),
}
# Symbol-master header names and the table columns they fill.
MASTER_COLUMNS = {
    "SYMBOL": "symbol", "NAME OF COMPANY": "name", "SERIES": "series",
    "DATE OF LISTING": "date_of_listing", "PAID UP VALUE": "paid_up_value",
    "MARKET LOT": "market_lot", "ISIN NUMBER": "isin", "FACE VALUE": "face_value",
}


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_text_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A headed CSV with every field as text and blanks around names and values removed.

    The header of one file fixes the columns; the reader then checks every other file against
    it and fails on a different layout instead of shifting columns.
    """
    options = {"header": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    names = [name.strip() for name in spark.read.options(**options).csv(paths).columns]
    return spark.read.options(**options, enforceSchema=False).schema(
        text_schema(names)).csv(paths)


def type_daily_rows(raw: DataFrame, *, exchange: str = "NSE",
                    source_file: str = "source_file") -> DataFrame:
    """Untyped price rows to ``daily_prices`` rows; rows without a full key are dropped."""
    require_columns(raw, DAILY_COLUMNS, "daily price file")
    # Cleaned in a step of its own, so a field is stripped once and not at every mention.
    fields = raw.select(*[clean(F.col(name)).alias(name) for name in DAILY_COLUMNS],
                        F.col(source_file).alias("source_file"))
    typed = fields.select(
        F.lit(exchange).alias("exchange"),
        *[parse(F.col(name)).alias(target) for name, (target, parse) in DAILY_COLUMNS.items()],
        is_sme_series("SERIES").alias("is_sme"), "source_file",
    )
    return typed.dropna(subset=["symbol", "series", "trade_date"])


def read_daily_prices(spark: SparkSession, paths: str | list[str], *,
                      exchange: str = "NSE") -> DataFrame:
    """All daily files of a path, list or glob, read in one job."""
    raw = read_text_csv(spark, paths)
    return type_daily_rows(raw.withColumn("source_file", F.col("_metadata.file_name")),
                           exchange=exchange)


def rows_per_file(prices: DataFrame) -> DataFrame:
    """Loaded rows of every source file."""
    return prices.groupBy("source_file").agg(F.count("*").alias("n_rows"))


def load_totals(prices: DataFrame) -> DataFrame:
    """Number of files with rows and of rows loaded."""
    return rows_per_file(prices).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"))


def type_master_rows(raw: DataFrame, *, source_url: str, exchange: str = "NSE") -> DataFrame:
    """Untyped master rows to ``symbols`` rows. Columns a file lacks are NULL."""
    require_columns(raw, ["SYMBOL", "SERIES"], "symbol master")

    def field(target: str):
        source = next(k for k, v in MASTER_COLUMNS.items() if v == target)
        return clean(F.col(f"`{source}`")) if source in raw.columns else (
            F.lit(None).cast("string"))

    return raw.select(
        F.lit(exchange).alias("exchange"),
        field("symbol").alias("symbol"), field("series").alias("series"),
        field("name").alias("name"), field("isin").alias("isin"),
        to_double(field("face_value")).alias("face_value"),
        to_long(field("market_lot")).alias("market_lot"),
        to_date(field("date_of_listing")).alias("date_of_listing"),
        is_sme_series(field("series")).alias("is_sme"),
        F.lit(source_url).alias("source_url"),
        F.current_timestamp().alias("loaded_at"),
    ).dropna(subset=["symbol", "series"])


def read_symbol_masters(spark: SparkSession, paths_by_url: dict[str, str], *,
                        exchange: str = "NSE") -> DataFrame:
    """Union of several masters, each with the address it came from."""
    if not paths_by_url:
        raise ValueError("no symbol master given")
    frames = [
        type_master_rows(read_text_csv(spark, path), source_url=url, exchange=exchange)
        for url, path in paths_by_url.items()
    ]
    table = frames[0]
    for frame in frames[1:]:
        table = table.unionByName(frame)
    return table


__all__ = [
    "DAILY_COLUMNS", "MASTER_COLUMNS", "SECURITY_KEY", "SESSION_KEY", "load_totals",
    "read_daily_prices", "read_symbol_masters", "read_text_csv", "rows_per_file",
    "text_schema", "type_daily_rows", "type_master_rows",
]
