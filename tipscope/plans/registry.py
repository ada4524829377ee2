"""All queries, by name. Each takes (spark, sf_dir) and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipscope.functions import text as X
from tipscope.functions.similarity import subsequence_ratio
from tipscope.operators import as_of as AO
from tipscope.operators import bursts as B
from tipscope.operators import dataset as D
from tipscope.operators import features as FE
from tipscope.operators import latest as L
from tipscope.operators import metrics as M
from tipscope.operators import redflags as R
from tipscope.operators import resolve as RS
from tipscope.operators import scoring as S
from tipscope.operators.labels import LABEL_COLUMN, forward_labels
from tipscope.plans import feature_store as FS
from tipscope.plans import scoring as P
from tipscope.plans import susceptibility as ML
from tipscope.plans.driver_tables import driver_table, engine_table
from tipscope.schemas import MESSAGE_KEY, SESSION_KEY
from tipscope.session import materialize, scratch_path
from tipscope.sources import calendar as C
from tipscope.sources import exchange_files as XF
from tipscope.sources import messages as MS
from tipscope.sources import snapshots as SN
from tipscope.sources.tables import merge_rows
from tipscope.streaming import audit as AU
from tipscope.streaming import streams as ST
from tipscope.streaming import windows as SW

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

WATCH_AS_OF = datetime(1998, 6, 30, 12)


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so the last bits of a sum's order do not show."""
    return df.select(*[
        F.round(F.col(name), places).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes
    ])


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return engine_table(spark, sf, "DAILY_PRICES")


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return engine_table(spark, sf, "SYMBOLS")


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    return engine_table(spark, sf, "CHANNEL_MENTIONS")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return engine_table(spark, sf, "CHANNEL_MESSAGES")


def stored_for_resolver(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Messages and symbols written once: the resolver reads both several times, and each time the
    part table behind them would be collected and broadcast again."""
    return materialize(messages(spark, sf), "messages"), materialize(symbols(spark, sf), "symbols")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return engine_table(spark, sf, "DOCUMENT_MESSAGES")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return engine_table(spark, sf, "ORDER_SCORES")


def features(spark: SparkSession, sf: str, only: list[str] | None = None, **options) -> DataFrame:
    return FE.market_features(prices(spark, sf), symbols(spark, sf), only=only, **options)


# --- sources -------------------------------------------------------------------------------

def _raw_daily_rows(spark, sf):
    """Text fields with blanks, placeholders and bad dates, from the line items."""
    li = driver_table(spark, sf, "lineitem")
    text = {
        "SYMBOL": F.concat(F.lit("  S"), F.col("l_suppkey").cast("string"), F.lit(" ")),
        "SERIES": F.when(F.col("l_linenumber") == 7, " ").when(
            F.col("l_suppkey") % 10 == 0, " SM").otherwise("EQ"),
        "DATE1": F.when(F.col("l_linenumber") == 6, "not a date").otherwise(
            F.concat(F.lit(" "), F.date_format("l_shipdate", "dd-MMM-yyyy"))),
        "PREV_CLOSE": F.lit("-"),
        "CLOSE_PRICE": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        "TTL_TRD_QNTY": F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".0")),
        "NO_OF_TRADES": F.concat(F.lit(" "), F.col("l_linenumber").cast("string")),
        "DELIV_QTY": F.when(F.col("l_returnflag") == "N", "-").otherwise(
            F.col("l_quantity").cast("int").cast("string")),
        "DELIV_PER": F.when(F.col("l_returnflag") == "N", "").otherwise("12.5"),
    }
    return li.select(*[
        text.get(name, F.lit("1e2")).alias(name) for name in XF.DAILY_COLUMNS])


def _daily_totals(typed):
    return typed.groupBy("exchange", "symbol", "series", "trade_date", "is_sme").agg(
        F.count("*").alias("n_rows"), F.count("prev_close").alias("n_prev"),
        F.sum(F.col("close").cast("decimal(18,2)")).cast("double").alias("sum_close"),
        F.sum("total_traded_qty").alias("sum_qty"), F.sum("num_trades").alias("sum_trades"),
        F.sum("deliv_qty").alias("sum_deliv"), F.count("deliv_pct").alias("n_deliv_pct"),
        F.max("avg_price").alias("avg_price"))


@query
def typed_daily_rows(spark, sf):
    """Raw text rows to typed price rows, by security and date."""
    raw = _raw_daily_rows(spark, sf).withColumn("source_file", F.lit("driver"))
    return _daily_totals(XF.type_daily_rows(raw))


@query
def daily_files(spark, sf):
    """The same rows through CSV files."""
    folder = scratch_path(spark, "daily-files")
    _raw_daily_rows(spark, sf).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return _daily_totals(XF.read_daily_prices(spark, folder))


def _monthly_files(spark, sf):
    """Price rows with the first day of their month as date, and the number of that month."""
    li = driver_table(spark, sf, "lineitem")
    text = {
        "SYMBOL": F.concat_ws("-", "l_orderkey", "l_linenumber"), "SERIES": F.lit("EQ"),
        "CLOSE_PRICE": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        "TTL_TRD_QNTY": F.col("l_quantity").cast("int").cast("string"),
    }
    first = F.trunc("l_shipdate", "month")
    return li.select(
        *[text.get(name, F.lit("-")).alias(name) for name in XF.DAILY_COLUMNS],
        first.alias("_day"), "l_orderkey", "l_linenumber",
        (F.year(first) * 12 + F.month(first) - 1).alias("_number"))


def _audited(spark, sf):
    """A file for each month through the audited stream, in three deliveries: every fifth month
    first as a copy of the month before, then right, with others repeated; then revised ones.
    Returns the stored prices and the ledger."""
    rows, folder = _monthly_files(spark, sf), scratch_path(spark, "landed")
    prices_root, ledger, state = (scratch_path(spark, n) for n in ("prices", "ledger", "state"))
    kind = F.col("_number") % 5
    echo = rows.where(kind == 3).withColumn("_file", F.add_months("_day", 1).cast("date"))
    own = rows.withColumn("_file", F.col("_day"))
    raised = (F.col("CLOSE_PRICE").cast("decimal(18,2)") + 1).cast("string")
    deliveries = [own.where(kind != 4).unionByName(echo), own.where(kind.isin(0, 4)),
                  own.where(kind == 1).withColumn("CLOSE_PRICE", raised)]
    order = ["_file", "l_orderkey", "l_linenumber", "CLOSE_PRICE", "TTL_TRD_QNTY"]
    for number, delivery in enumerate(deliveries):
        (delivery.withColumn("DATE1", F.date_format("_day", "dd-MMM-yyyy"))
         .repartition("_file").sortWithinPartitions(*order).select(*XF.DAILY_COLUMNS, "_file")
         .write.partitionBy("_file").csv(f"{folder}/load={number}", header=True))
        AU.ingest_audited(
            spark, folder, prices_root, ledger, state, files_per_batch=60,
            named_day=lambda path: F.regexp_extract(path, "_file=([0-9-]+)", 1).cast("date"),
        ).awaitTermination()
    return SN.read_snapshot(spark, prices_root), SN.read_snapshot(spark, ledger)


@query
def audited_files(spark, sf):
    """What the audit made of each month's files, and the rows that were loaded for it."""
    stored, ledger = _audited(spark, sf)
    entered = ledger.groupBy("day").agg(
        F.count("*").alias("n_files"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("valid", "nodata", "skipped")],
        F.countDistinct("sha256").alias("n_contents"))
    loaded = stored.groupBy(F.col("trade_date").alias("day")).agg(
        F.count("*").alias("n_rows"), F.sum("total_traded_qty").alias("sum_qty"),
        F.sum(F.col("close").cast("decimal(18,2)")).cast("double").alias("sum_close"))
    return entered.join(loaded, "day", "left")


@query
def file_ledger(spark, sf):
    """The ledger of the same files: verdict, size, fingerprint and date inside."""
    return _audited(spark, sf)[1].select(
        "day", "status", "note", "bytes", "internal_date",
        F.substring("sha256", 1, 12).alias("sha256_12"))


@query
def typed_symbol_master(spark, sf):
    """Two untyped masters with different columns, typed and put together."""
    key = F.col("p_partkey")
    raw = driver_table(spark, sf, "part").select(
        key, F.concat(F.lit(" SUP"), key.cast("string")).alias("SYMBOL"),
        F.concat(F.col("p_name"), F.lit(" Limited ")).alias("NAME OF COMPANY"),
        F.when(key % 9 == 0, "").when(key % 10 == 0, "ST").otherwise("EQ").alias("SERIES"),
        F.when(key % 4 == 0, "unknown").otherwise(
            F.date_format(F.date_add(F.lit("2001-01-05").cast("date"), key.cast("int")),
                          "dd-MMM-yyyy")).alias("DATE OF LISTING"),
        F.col("p_size").cast("string").alias("MARKET LOT"), F.lit("10.00").alias("FACE VALUE"))
    main = XF.type_master_rows(raw.where(key % 2 == 0).drop("p_partkey"), source_url="main")
    second = XF.type_master_rows(
        raw.where(key % 2 == 1).drop("p_partkey", "FACE VALUE"), source_url="second")
    return main.unionByName(second).drop("loaded_at")


@query
def message_intake(spark, sf):
    """Recent posts with text that are no commands, with request validity."""
    convs = driver_table(spark, sf, "conversations")
    landed = convs.select(
        F.when(F.col("conv_id") % 5 == 0, "mail").otherwise("telegram").alias("source"),
        F.col("conv_id").alias("channel_id"), F.col("turn").alias("message_id"),
        F.when(F.col("turn") == 3, " /START ").when(F.col("turn") == 4, "")
        .otherwise(F.col("text")).alias("text"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 200).cast("int"))
        .cast("timestamp").alias("posted_at"))
    recent = MS.drop_commands(
        MS.recent_messages(landed, now=F.lit("2024-07-01").cast("timestamp"), days=90))
    return recent.select(*MESSAGE_KEY, "posted_at", F.length("text").alias("n_chars"),
                         MS.request_is_valid().alias("accepted"))


@query
def chat_updates(spark, sf):
    """JSON chat updates: new or edited message, with chat id and text."""
    convs = driver_table(spark, sf, "conversations")
    body = F.struct(F.struct(F.col("conv_id").alias("id")).alias("chat"), F.col("text"))
    update = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(body.alias("message"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(body.alias("edited_message"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.col("turn").alias("update_id"))))
        .otherwise(F.to_json(F.struct(F.struct(F.col("text")).alias("message"))))
    )
    return MS.parse_updates(convs.select(update.alias("update")))


def _fetches(spark, sf):
    """One pretended download per order date."""
    orders = driver_table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    n, key = F.count("*"), F.min("o_orderkey")
    return orders.groupBy(day.alias("day")).agg(n.alias("n"), key.alias("k")).select(
        "day",
        F.when(F.col("k") % 11 == 0, 404).when(F.col("k") % 13 == 0, 503)
        .when(F.col("k") % 17 == 0, None).otherwise(200).alias("http_code"),
        (F.col("n") * 100).alias("bytes"),
        C.internal_date_text(F.when(F.col("k") % 7 == 0, F.date_sub("day", 1))
                             .otherwise(F.col("day"))).alias("internal_date"),
        (F.col("k") % 19 == 0).alias("cached"))


def _calendar(spark, sf):
    span = driver_table(spark, sf, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return C.classify_days(days, _fetches(spark, sf))


@query
def file_calendar(spark, sf):
    return _calendar(spark, sf)


@query
def ingest_status_totals(spark, sf):
    return C.status_totals(_calendar(spark, sf))


@query
def default_ranges(spark, sf):
    """The two-year range that ends at each order date."""
    days = driver_table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("range_end")).distinct()
    start, end = C.default_range("range_end")
    return days.select(start.alias("range_start"), end.alias("range_end"))


@query
def upsert_latest(spark, sf):
    """Stored order rows replaced by a second load that overlaps them, with repeats."""
    orders = driver_table(spark, sf, "orders")
    base = orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice",
                         "o_orderkey")
    # Two overlapping loads that together hold every order.
    stored = L.latest_version(base.where("o_orderkey % 3 <> 0"), ["o_custkey", "day"],
                              "o_orderkey")
    return merge_rows(stored, base.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"),
                      ["o_custkey", "day"], order_by="o_totalprice")


@query
def snapshot_upsert(spark, sf):
    """The same loads through a stored table that changes in one step, by months; the second one
    twice, as after a failure. Read by version."""
    orders = driver_table(spark, sf, "orders")
    base = orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice",
                         "o_orderkey")
    root, keys = scratch_path(spark, "snapshots"), ["o_custkey", "day"]
    first = SN.load_snapshot(base.where("o_orderkey % 3 <> 0"), root, keys, month_of="day",
                             order_by="o_orderkey")
    news = base.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
    numbers = [SN.load_snapshot(news, root, keys, month_of="day", order_by="o_totalprice",
                                note=("load", "2")) for _ in range(2)]
    out = SN.read_snapshot(spark, root, first).withColumn("version", F.lit(1))
    for number in sorted(set(numbers)):
        out = out.unionByName(SN.read_snapshot(spark, root, number).withColumn(
            "version", F.lit(number)))
    return out


@query
def serving_store(spark, sf):
    stored = materialize(features(spark, sf), "features")
    return rounded(L.serving_features(stored, 90))


@query
def store_summary(spark, sf):
    stored = materialize(features(spark, sf).select("trade_date"), "feature-dates")
    return L.store_summary(L.serving_features(stored, 90))


# --- market features and labels --------------------------------------------------------------

@query
def daily_prices(spark, sf):
    return rounded(prices(spark, sf), 8)


@query
def market_features(spark, sf):
    return rounded(features(spark, sf))


@query
def refreshed_features(spark, sf):
    """Stored features after three loads of prices: histories with days missing and wrong closes,
    then the missing and the corrected days with changed listing dates, then the newest months."""
    table, master = materialize(prices(spark, sf), "prices"), symbols(spark, sf)
    stored, built = scratch_path(spark, "price-store"), scratch_path(spark, "feature-store")
    newest, tenth = F.col("trade_date") >= "1998-06-01", F.dayofyear("trade_date") % 120
    loads = [
        table.where(~newest & (tenth != 7)).withColumn(
            "close", F.when(tenth == 11, F.col("close") + 9.0).otherwise(F.col("close"))),
        table.where(~newest & tenth.isin(7, 11)), table.where(newest),
    ]
    listings = [master.withColumn("date_of_listing", F.when(
        F.col("symbol").endswith("7"), F.lit(None)).otherwise(F.col("date_of_listing"))),
        master, master]
    for rows, listed in zip(loads, listings):
        SN.load_snapshot(rows, stored, SESSION_KEY, month_of="trade_date")
        FS.refresh_features(spark, stored, built, listed)
    return rounded(SN.read_snapshot(spark, built))


@query
def runup(spark, sf):
    return rounded(features(spark, sf, ["runup_5d", "runup_10d", "runup_20d"]))


@query
def volume_zscore(spark, sf):
    return rounded(features(spark, sf, ["volume_zscore_60d"]))


@query
def delivery_trend(spark, sf):
    return rounded(features(spark, sf, ["delivery_pct", "delivery_pct_trend_10d"]))


@query
def upper_circuit_count(spark, sf):
    return features(spark, sf, ["upper_circuit_count_10d"])


@query
def median_turnover_bucket(spark, sf):
    return rounded(features(spark, sf, ["trailing_median_turnover_20d", "liquidity_bucket"]))


@query
def listing_age(spark, sf):
    return features(spark, sf, ["days_since_listing", "is_sme"])


@query
def latest_features(spark, sf):
    return rounded(FE.newest_features(prices(spark, sf), symbols(spark, sf)))


@query
def forward_label(spark, sf):
    return forward_labels(prices(spark, sf))


@query
def labeled_dataset(spark, sf):
    return rounded(D.labeled_dataset(prices(spark, sf), symbols(spark, sf)))


@query
def joined_dataset(spark, sf):
    """The labelled dataset by a key join of separately computed features and labels."""
    return rounded(D.join_labels(features(spark, sf), forward_labels(prices(spark, sf))))


# --- coordination ------------------------------------------------------------------------------

@query
def burst_stats(spark, sf):
    return rounded(B.burst_stats(mentions(spark, sf), WATCH_AS_OF))


@query
def burst_stats_latest(spark, sf):
    """As of the newest mention, with other window settings."""
    return rounded(B.burst_stats(mentions(spark, sf), window_hours=60, baseline_days=40,
                                 step_hours=36))


@query
def burst_history(spark, sf):
    return rounded(B.burst_history(mentions(spark, sf)))


def crowded(spark: SparkSession, sf: str) -> DataFrame:
    return engine_table(spark, sf, "CROWDED_MENTIONS")


@query
def bursts_as_posted(spark, sf):
    """Burst statistics of each ticker at the time of each of its mentions."""
    named = crowded(spark, sf)
    return rounded(AO.bursts_as_of(named.withColumnRenamed("posted_at", "as_of"), named))


@query
def crowded_watchlist(spark, sf):
    """The most unusual bursts where many channels meet, as of the newest mention."""
    return rounded(B.watchlist(crowded(spark, sf), datetime(1998, 3, 1), limit=1000))


@query
def features_as_posted(spark, sf):
    """The newest session before each mention's day, with its features."""
    asked = crowded(spark, sf).select("ticker", F.to_date("posted_at").alias("day"))
    return rounded(AO.features_as_of(asked, features(spark, sf, [*S.FACTOR_COLUMNS])).select(
        "ticker", "day", *SESSION_KEY, *S.FACTOR_COLUMNS))


@query
def watchlist(spark, sf):
    return rounded(B.watchlist(mentions(spark, sf), WATCH_AS_OF, limit=25))


@query
def channel_windows_stream(spark, sf):
    """Distinct channels per ticker and sliding 48 h window, from a file stream; the windows that
    the watermark has not passed at its end are counted in a batch."""
    source, root, state = (scratch_path(spark, n) for n in ("mentions", "windows", "stream-state"))
    mentions(spark, sf).select("ticker", "channel_id", "posted_at").write.parquet(source)
    stream = spark.readStream.schema("ticker string, channel_id string, posted_at timestamp"
                                     ).parquet(source)
    # Windows in files, not in a state store: that would hold each channel of every window in memory.
    SW.run_channel_windows(stream, root, state).awaitTermination()
    return SW.closed_windows(spark, root).unionByName(
        SW.open_windows(spark, root).groupBy("ticker", "window_end").agg(
            F.count("*").alias("n_channels")))


@query
def late_channel_windows(spark, sf):
    """The same windows from a stream of three micro-batches in which every seventh channel comes
    long late: windows written, windows still open, and rows for windows already written."""
    tagged = mentions(spark, sf).select("ticker", "channel_id", "posted_at")
    files, root, state = (scratch_path(spark, n) for n in ("late", "late-windows", "stream-state"))
    day = F.to_date("posted_at")
    part = F.when(F.col("channel_id").cast("int") % 7 == 0, 2).when(day < "1995-01-01", 0).when(
        day < "1997-01-01", 1).otherwise(2)
    for k in range(3):
        tagged.where(part == k).write.mode("append").parquet(files)
        stream = spark.readStream.schema("ticker string, channel_id string, posted_at timestamp"
                                         ).parquet(files)
        SW.run_channel_windows(stream, root, state).awaitTermination()
    counted = F.count("*").alias("n")
    return (
        SW.closed_windows(spark, root).select(
            F.lit("closed").alias("kind"), "ticker", "window_end", F.col("n_channels").alias("n"))
        .unionByName(SW.open_windows(spark, root).groupBy(
            F.lit("open").alias("kind"), "ticker", "window_end").agg(counted))
        .unionByName(SW.late_rows(spark, root).groupBy(
            F.lit("late").alias("kind"), "ticker", "window_end").agg(counted)))


@query
def stream_watchlist(spark, sf):
    """The five most unusual bursts of each closed window of a stream of crowded mentions."""
    table = crowded(spark, sf)
    source, root, out, state = (scratch_path(spark, n) for n in (
        "crowded", "crowded-windows", "stream-watchlist", "stream-state"))
    table.select("channel_id", "ticker", "posted_at").write.parquet(source)
    stream = spark.readStream.schema(
        "channel_id string, ticker string, posted_at timestamp").parquet(source)
    baseline = B.burst_stats(table, datetime(1998, 3, 1)).select(
        "ticker", "baseline_mean", "baseline_std")
    ST.run_stored_watchlist(stream, materialize(baseline, "baseline"), root, out, state,
                            limit=5).awaitTermination()
    return rounded(spark.read.schema(
        "ticker string, window_end timestamp, n_channels bigint, z double").parquet(out)
        .drop("batch"))


# --- messages ------------------------------------------------------------------------------------

@query
def stream_tags(spark, sf):
    """Messages as JSON files in three deliveries, some sent twice, also over the end of a delivery:
    each tagged once."""
    sent, box, out, state = messages(spark, sf), *(
        scratch_path(spark, n) for n in ("box", "tags", "stream-state"))
    ends = ["1992-01-01", "1994-05-01", "1996-08-01", "2100-01-01"]
    at, again = F.col("posted_at"), F.col("message_id").cast("bigint") % 5 == 0
    for start, end in zip(ends, ends[1:]):
        # What the last two hours brought comes once more at the head of the next delivery.
        part = sent.where((at >= F.lit(start).cast("timestamp") - F.expr("INTERVAL 2 HOURS"))
                          & (at < F.lit(end).cast("timestamp")))
        part.unionByName(part.where(again)).write.mode("append").json(box)
        ST.run_tagging(ST.stream_messages(spark, box), symbols(spark, sf), out, state
                       ).awaitTermination()
    return spark.read.parquet(out).select(*MESSAGE_KEY, "ticker", *X.TIP_COLUMNS)


def _tip_table(df: DataFrame) -> DataFrame:
    return X.with_tip_columns(df).select(*MESSAGE_KEY, *X.TIP_COLUMNS)


@query
def tip_columns(spark, sf):
    return _tip_table(messages(spark, sf))


@query
def document_tip_columns(spark, sf):
    """The same columns over long texts, whole."""
    return _tip_table(documents(spark, sf))


@query
def red_flags(spark, sf):
    tips = _tip_table(messages(spark, sf))
    return tips.select(
        *MESSAGE_KEY, R.red_flag_score().alias("red_flag_score"),
        F.array_join(F.transform(R.red_flags(), lambda f: f["code"]), ",").alias("codes"))


@query
def advice_words_in_reasons(spark, sf):
    """Rendered reasons that read as advice: none."""
    scored = _risk_scores(spark, sf)
    reasons = scored.select(F.explode("contributions").alias("c"))
    return reasons.agg(
        F.count_if(R.reads_as_advice(F.col("c.reason"))).alias("n_advice"),
        F.count("*").alias("n_reasons"))


@query
def resolve_exact(spark, sf):
    return RS.exact_hits(messages(spark, sf), RS.clean_master(symbols(spark, sf))).select(
        *MESSAGE_KEY, F.col("exact").alias("ticker"))


@query
def resolve_alias(spark, sf):
    return messages(spark, sf).select(
        *MESSAGE_KEY, RS.alias_symbol("text").alias("ticker")).where("ticker IS NOT NULL")


@query
def resolve_fuzzy(spark, sf):
    asked = X.with_sorted_name(messages(spark, sf), "text", "query").select("query").distinct()
    queries = materialize(asked, "queries").where("query <> ''")
    return rounded(RS.fuzzy_matches(queries, RS.clean_master(symbols(spark, sf))))


@query
def resolve_tickers(spark, sf):
    return rounded(RS.resolve(*stored_for_resolver(spark, sf)).select(
        *MESSAGE_KEY, "ticker", "ticker_score", "ticker_method", "ticker_name"))


@query
def tag_mentions(spark, sf):
    return RS.tag_mentions(*stored_for_resolver(spark, sf))


@query
def resolver_accuracy(spark, sf):
    """Share of full-name, swapped and misspelt messages that resolve as expected."""
    posted, master = stored_for_resolver(spark, sf)
    expected = posted.select(
        *MESSAGE_KEY, F.when(
            (F.col("message_id").cast("bigint") % 8).isin(0, 1, 7),
            F.regexp_extract("text", "(SUP[0-9]{5})", 1)).alias("expected"))
    known = master.select(F.col("symbol").alias("expected"), F.lit(1).alias("known"))
    truth = expected.join(known, "expected", "left").select(
        *MESSAGE_KEY, F.when(F.col("known") == 1, F.col("expected")).alias("expected"))
    resolved = RS.tag_mentions(posted, master)
    return rounded(RS.accuracy(resolved.join(truth, MESSAGE_KEY)))


@query
def resolver_hits_by_kind(spark, sf):
    """For each kind of message: resolved to what it means, to something else, or not at all."""
    meant = engine_table(spark, sf, "MEANT_TICKERS")
    resolved = RS.tag_mentions(*stored_for_resolver(spark, sf))
    right = F.col("ticker").eqNullSafe(F.col("expected"))
    wrong = F.col("ticker").isNotNull() & ~right
    return resolved.join(meant, "message_id").groupBy("kind").agg(
        F.count("*").alias("n_cases"), F.count_if(right).alias("right"),
        F.count_if(wrong).alias("wrong"), F.count_if(~right & ~wrong).alias("missed"))


@query
def name_similarity(spark, sf):
    """Token-sorted subsequence ratio of part names with their neighbour in key order."""
    part = driver_table(spark, sf, "part")
    both = part.withColumn("_typed", F.concat("p_name", F.lit(" "), "p_type"))
    a = X.with_sorted_name(both, "_typed", "a").select(F.col("p_partkey").alias("k"), "a")
    b = X.with_sorted_name(part, "p_name", "b").select(
        (F.col("p_partkey") + 1).alias("k"), "b")
    # Few bytes, much work: a broadcast join would leave the ratios to the tasks of the scan.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rounded(a.join(b, "k").repartition(tasks, "k").select(
        "k", "a", "b", subsequence_ratio("a", "b").alias("ratio")))


# --- scores ----------------------------------------------------------------------------------------

def _market_side(spark, sf):
    """Newest features with a stand-in probability, so scores can be checked in SQL."""
    latest = FE.newest_features(prices(spark, sf), symbols(spark, sf))
    p = F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), F.coalesce(F.col("runup_20d") / 2.0 + 0.25, F.lit(0.0))))
    return latest.withColumn("susceptibility", F.bround(p, 4))


def _risk_scores(spark, sf):
    tips = materialize(
        P.parse_tips(messages(spark, sf), symbols(spark, sf)).drop("raw_text"), "tips")
    named = tips.where("ticker IS NOT NULL").select("ticker", "channel_id", "posted_at")
    return P.score_tips(tips, _market_side(spark, sf), B.burst_stats(named, WATCH_AS_OF))


@query
def risk_scores(spark, sf):
    return rounded(_risk_scores(spark, sf).select(
        *MESSAGE_KEY, "value", "band", "confidence", "ticker", "model_susceptibility",
        "message_red_flag_score",
        F.array_join(F.transform("contributions", lambda c: c["code"]), ",").alias("drivers"),
        F.array_join("notes", "|").alias("notes")))


@query
def score_replies(spark, sf):
    """Both text layouts of message-only scores (no market data, model or mentions)."""
    scored = P.score_tips(P.parse_tips(messages(spark, sf)))
    return scored.select(*MESSAGE_KEY, S.chat_reply().alias("reply"),
                         S.text_report().alias("report"))


def _crowded_tips(spark, sf):
    """Messages with the ticker and time of the crowded mention that has their key."""
    parsed = P.parse_tips(messages(spark, sf)).drop("tip_id", "raw_text", "ticker", "posted_at")
    stored = materialize(parsed.join(
        crowded(spark, sf).select(*MESSAGE_KEY, "ticker", "posted_at"), MESSAGE_KEY), "tips")
    return stored.withColumn("tip_id", P.tip_id())  # six times as many bytes as all the rest


def _wide_probability(table: DataFrame) -> DataFrame:
    """A stand-in probability that reaches from 0 to 1."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(
        F.col("runup_20d") * 4.0 + 0.5, F.lit(0.0))))
    return table.withColumn("susceptibility", F.bround(p, 4))


def _explained(scored: DataFrame) -> DataFrame:
    drivers = F.transform("contributions", lambda c: F.concat(
        c["code"], F.lit("="), F.format_string("%.1f", c["impact"])))
    return rounded(scored.select(
        *MESSAGE_KEY, "value", "band", "confidence", "ticker", "model_susceptibility",
        "message_red_flag_score", F.array_join(drivers, ",").alias("drivers"),
        S.chat_reply().alias("reply"), S.text_report().alias("report")))


@query
def explained_scores(spark, sf):
    """Full scores with both layouts where channels meet: bursts as of one time, market factors of
    the newest session, all bands."""
    tips = _crowded_tips(spark, sf)
    market = _wide_probability(FE.newest_features(prices(spark, sf), symbols(spark, sf)))
    return _explained(P.score_tips(tips, market, B.burst_stats(crowded(spark, sf),
                                                               datetime(1998, 3, 1))))


@query
def explained_scores_as_posted(spark, sf):
    """The same by what was known when each message was posted."""
    tips = _crowded_tips(spark, sf)
    span = AO.days_asked(tips.select("ticker", F.col("posted_at").alias("day")))
    market = _wide_probability(features(spark, sf, [*S.FACTOR_COLUMNS], span=span))
    return _explained(P.score_tips_as_posted(tips, market, crowded(spark, sf)))


@query
def model_risk_scores(spark, sf):
    """Scores with a trained model end to end."""
    model = _trained(spark, sf)[1]
    tagged = materialize(RS.tag_mentions(messages(spark, sf), symbols(spark, sf)), "mentions")
    return P.score_messages(
        messages(spark, sf), symbols(spark, sf), features(spark, sf), model, tagged,
        as_of=WATCH_AS_OF
    ).select(*MESSAGE_KEY, "value", "band", "confidence", "ticker", "model_susceptibility")


# --- dataset, metrics and model ------------------------------------------------------------------------

def _dataset(spark, sf):
    return D.labeled_dataset(prices(spark, sf), symbols(spark, sf))


@query
def temporal_split_counts(spark, sf):
    dataset = materialize(_dataset(spark, sf).select("trade_date", LABEL_COLUMN), "dataset")
    return D.temporal_split(dataset).groupBy("split").agg(
        F.count("*").alias("n"), F.sum(LABEL_COLUMN).alias("positives"),
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query
def date_quantiles(spark, sf):
    orders = driver_table(spark, sf, "orders")
    parts = [
        D.date_quantile(orders, q, "o_orderdate").select(F.lit(q).alias("q"), "day")
        for q in (0.1, 0.5, 0.75)
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def class_weights(spark, sf):
    return rounded(D.class_weights(scores(spark, sf), "y"))


@query
def dataset_counts(spark, sf):
    return rounded(M.dataset_counts(scores(spark, sf)))


@query
def average_precision(spark, sf):
    return rounded(M.ranking_metrics(scores(spark, sf)).select(
        "n", "positives", "base_rate", "average_precision", "lift_over_base"))


@query
def roc_auc(spark, sf):
    return rounded(M.ranking_metrics(scores(spark, sf)).select("roc_auc"))


@query
def brier(spark, sf):
    return rounded(M.brier_score(scores(spark, sf)))


@query
def calibration_table(spark, sf):
    return rounded(M.calibration_table(scores(spark, sf)))


@query
def score_distribution(spark, sf):
    return rounded(M.score_distribution(scores(spark, sf)))


def _split(spark, sf):
    return materialize(D.temporal_split(materialize(_dataset(spark, sf), "dataset")), "split")


@lru_cache(maxsize=4)
def _trained(spark, sf):
    """The split of an input and the default model, fitted once for all queries of a session."""
    split = _split(spark, sf)
    return split, ML.fit(split)


@query
def model_scores(spark, sf):
    """Calibrated probability of every symbol's newest features."""
    latest = FE.newest_features(prices(spark, sf), symbols(spark, sf))
    return ML.score_latest(_trained(spark, sf)[1], latest).select(*SESSION_KEY, "susceptibility")


@query
def model_report(spark, sf):
    """Headline metrics of a model that passed the gate."""
    split, model = _trained(spark, sf)
    return ML.headline(model, split)[1]


@query
def permutation_importance(spark, sf):
    split, model = _trained(spark, sf)
    return ML.permutation_importance(model, split.where("split = 'test'").drop("split"))
