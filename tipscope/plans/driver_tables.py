"""Engine tables derived from the driver's generic tables.

The driver supplies no prices or tips, so each engine table is shaped from its columns by a
deterministic SELECT. The text is shared with the checking SQL; where the two SQL dialects spell
a function differently there is a placeholder. Nothing of the engine's own logic is in here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIALECTS = {
    "spark": {"row": "struct", "text": "STRING", "minutes": "make_dt_interval(0, {h}, 0, 0)",
              "json": "to_json(named_struct({pairs}))", "fmt": "date_format({d}, 'dd-MMM-yyyy')"},
    "duckdb": {"row": "row", "text": "VARCHAR", "minutes": "to_hours({h})",
               "json": "to_json(struct_pack({pairs}))", "fmt": "strftime({d}, '%d-%b-%Y')"},
}

# The supplier that stands behind 15 customers; both tables grow alike, so all are reached.
SUPPLIER_OF = "CAST(floor((o_custkey + 14) / 15) AS INT)"
SYMBOL = "concat('SUP', lpad(CAST({k} AS {text}), 5, '0'))"

UNLISTED = "CASE WHEN l_suppkey % 11 = 3 THEN replace({symbol}, 'SUP', 'NEW') ELSE {symbol} END"

# Daily prices: one row per supplier and ship date.
DAILY_PRICES = """
SELECT 'NSE' AS exchange, {symbol} AS symbol,
       CASE WHEN l_suppkey % 10 = 0 THEN 'SM' ELSE 'EQ' END AS series,
       CAST(l_shipdate AS DATE) AS trade_date,
       max_by((100.0 + l_extendedprice / 2000.0) * (1.0 - l_discount), {last}) AS prev_close,
       100.0 + max(l_extendedprice) / 2000.0 AS high,
       100.0 + min(l_extendedprice) / 2000.0 AS low,
       100.0 + max_by(l_extendedprice, {last}) / 2000.0 AS close,
       CAST(sum(l_quantity) AS BIGINT) AS total_traded_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / 100.0 AS turnover_lacs,
       count(*) AS num_trades,
       100.0 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END)
           / sum(l_quantity) AS deliv_pct,
       l_suppkey % 10 = 0 AS is_sme
FROM {lineitem}
GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
"""
_LAST = "{row}(l_orderkey, l_linenumber, l_extendedprice, l_discount)"

# Symbol master: all suppliers, named by parts. Prices of every 11th supplier carry a symbol that
# the master lacks on purpose.
SYMBOLS = """
SELECT 'NSE' AS exchange, {symbol} AS symbol,
       CASE WHEN s_suppkey % 10 = 0 THEN 'SM' ELSE 'EQ' END AS series,
       concat(coalesce(p_name, s_name), ' ', lower(coalesce(p_type, '')), ' Limited') AS name,
       CAST(date_add(DATE '1995-01-01', CAST(s_suppkey % 900 AS INT)) AS DATE)
           AS date_of_listing,
       s_suppkey % 10 = 0 AS is_sme
FROM {supplier} LEFT JOIN {part} ON p_partkey = s_suppkey
"""

# Mentions: suppliers naming part brands.
CHANNEL_MENTIONS = """
SELECT 'telegram' AS source, CAST(l_suppkey AS {text}) AS channel_id,
       concat(CAST(l_orderkey AS {text}), '-', CAST(l_linenumber AS {text})) AS message_id,
       CASE WHEN l_linenumber % 7 = 0 THEN NULL
            ELSE concat(p_brand, '/', CAST(p_size AS {text})) END AS ticker,
       l_shipdate + {hours} AS posted_at
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
"""

# Crowded mentions: customers as channels naming suppliers within 200 days; a third of them within
# 40 hours of a time of the supplier's own, so that many channels meet.
CROWDED_MENTIONS = """
SELECT 'telegram' AS source, concat('ch', CAST(o_custkey % 40 AS {text})) AS channel_id,
       CAST(o_orderkey AS {text}) AS message_id,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {symbol} END AS ticker,
       CAST(DATE '1998-01-01' AS TIMESTAMP) + {hours} AS posted_at
FROM {orders}
"""
_CROWDED_HOUR = ("CAST(CASE WHEN o_orderkey % 3 = 0 THEN ({supplier} * 97) % 3000 + o_orderkey % 40 "
                 "ELSE (o_orderkey * 37) % 4800 END AS INT)")

# Channel messages: eight kinds of text, from full tips to bare and misspelt company names.
CHANNEL_MESSAGES = """
SELECT 'telegram' AS source, concat('ch', CAST(o_custkey % 40 AS {text})) AS channel_id,
       CAST(o_orderkey AS {text}) AS message_id,
       CASE CAST(o_orderkey % 8 AS INT)
         WHEN 0 THEN concat('buy ', sym, ' now, sure shot! target ', CAST(p_size AS {text}), ' intraday')
         WHEN 1 THEN concat('Kal ', sym, ' me achhi tezi aayegi 📈 tgt: ',
                            CAST(1000 + p_size AS {text}), '.5')
         WHEN 2 THEN full_name
         WHEN 3 THEN concat(lower(p_type), ' ', p_name, ' LTD')
         WHEN 4 THEN concat(substring(full_name, 1, 2), substring(full_name, 4, 60))
         WHEN 5 THEN CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN 'SBI' WHEN 1 THEN 'Infy'
                     WHEN 2 THEN 'L&T' WHEN 3 THEN 'HUL' WHEN 4 THEN 'D-Mart'
                     WHEN 5 THEN 'lic' ELSE '   ' END
         WHEN 6 THEN concat(sym, ' and ', sym2, ': operator khabar, bech do in ',
                            CAST(p_size AS {text}), ' weeks')
         ELSE concat('⚡️now ', sym, ' positional. SEBI registered, ',
                     CASE o_orderstatus WHEN 'F' THEN 'no loss' WHEN 'O' THEN 'hold for 5 days'
                     ELSE 'aaj tp - 80' END)
       END AS text,
       o_orderdate + {hours} AS posted_at
FROM (
  SELECT o.*, p_name, p_type, p_size, {symbol} AS sym, {symbol2} AS sym2,
         concat(p_name, ' ', lower(p_type)) AS full_name
  FROM {orders} o JOIN {part} p ON p_partkey = {supplier_of}
) AS shaped
"""

# The symbol that each channel message means, by kind; none where it names two known ones.
MEANT_TICKERS = """
SELECT CAST(o_orderkey AS {text}) AS message_id, CAST(o_orderkey % 8 AS INT) AS kind,
       CASE CAST(o_orderkey % 8 AS INT)
         WHEN 5 THEN CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN 'SBIN' WHEN 1 THEN 'INFY'
                     WHEN 2 THEN 'LT' WHEN 3 THEN 'HINDUNILVR' WHEN 4 THEN 'DMART'
                     WHEN 5 THEN 'LICI' END
         WHEN 6 THEN CASE WHEN {supplier_of} >= (SELECT max(s_suppkey) FROM {supplier})
                     THEN {symbol} END
         ELSE {symbol}
       END AS expected
FROM {orders} JOIN {part} p ON p_partkey = {supplier_of}
"""

# Long free texts as messages.
DOCUMENT_MESSAGES = """
SELECT 'manual' AS source, source AS channel_id, CAST(doc_id AS {text}) AS message_id, text
FROM {documents}
"""

# Scores and outcomes: one per order.
ORDER_SCORES = """
SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
       CAST((o_orderkey * 7919 + CASE WHEN o_orderstatus = 'F' THEN 211 ELSE 0 END) % 1000
            AS DOUBLE) / 1000.0 AS p
FROM {orders}
"""


def shape(name: str, dialect: str, tables: dict[str, str]) -> str:
    """The SELECT of an engine table, over the given names of the driver tables."""
    d = _DIALECTS[dialect]

    def symbol(key: str) -> str:
        return SYMBOL.format(k=key, text=d["text"])

    parts = {
        "DAILY_PRICES": (DAILY_PRICES, {"symbol": UNLISTED.format(symbol=symbol("l_suppkey")),
                                        "last": _LAST.format(row=d["row"])}),
        "SYMBOLS": (SYMBOLS, {"symbol": symbol("s_suppkey")}),
        "CHANNEL_MENTIONS": (CHANNEL_MENTIONS, {
            "hours": d["minutes"].format(h="CAST(l_orderkey % 24 AS INT)")}),
        "CROWDED_MENTIONS": (CROWDED_MENTIONS, {
            "symbol": symbol(SUPPLIER_OF), "hours": d["minutes"].format(
                h=_CROWDED_HOUR.format(supplier=SUPPLIER_OF))}),
        "CHANNEL_MESSAGES": (CHANNEL_MESSAGES, {
            "symbol": symbol(SUPPLIER_OF), "symbol2": symbol(f"({SUPPLIER_OF} + 1)"),
            "supplier_of": SUPPLIER_OF,
            "hours": d["minutes"].format(h="CAST(o_orderkey % 24 AS INT)")}),
        "MEANT_TICKERS": (MEANT_TICKERS, {"symbol": symbol(SUPPLIER_OF),
                                          "supplier_of": SUPPLIER_OF}),
        "DOCUMENT_MESSAGES": (DOCUMENT_MESSAGES, {}),
        "ORDER_SCORES": (ORDER_SCORES, {}),
    }
    template, extra = parts[name]
    return template.format(text=d["text"], **tables, **extra)


_USED = ("supplier", "part", "orders", "lineitem", "documents", "conversations", "events",
         "labels")
DUCKDB_TABLES = {name: name for name in _USED}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An engine table as a lazy DataFrame over the driver's Parquet files."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _USED}
    if name == "DAILY_PRICES":
        # Few line items share a supplier and day, and a price row's partial form is twice as wide as a
        # line item: shuffled before the aggregate they are half as many bytes.
        tables["lineitem"] = (f"(SELECT * FROM {tables['lineitem']} "
                              "DISTRIBUTE BY l_suppkey, CAST(l_shipdate AS DATE))")
    df = spark.sql(shape(name, "spark", tables))
    if "posted_at" in df.columns:
        df = df.withColumn("posted_at", df["posted_at"].cast("timestamp"))
    return df
