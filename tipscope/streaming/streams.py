"""Incremental runs of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tipscope.operators.bursts import is_burst
from tipscope.operators.resolve import alias_symbol, clean_master, exact_hits, symbol_names
from tipscope.functions.text import TIP_COLUMNS, ticker_tokens, with_tip_columns
from tipscope.schemas import CHANNEL_MESSAGES, MESSAGE_KEY, SESSION_KEY
from tipscope.session import materialize, release
from tipscope.sources.exchange_files import DAILY_COLUMNS, text_schema, type_daily_rows
from tipscope.sources.tables import upsert
from tipscope.streaming.windows import run_channel_windows

LATENESS = "2 hours"
WINDOW, STEP = "48 hours", "24 hours"


def stream_daily_files(spark: SparkSession, directory: str) -> DataFrame:
    """New daily price files as typed rows. Files must have the standard column order."""
    raw = (
        spark.readStream.options(header=True, ignoreLeadingWhiteSpace=True,
                                 ignoreTrailingWhiteSpace=True, enforceSchema=False)
        .schema(text_schema(list(DAILY_COLUMNS))).csv(directory)
    )
    return type_daily_rows(raw.withColumn("source_file", F.col("_metadata.file_name")))


def stream_messages(spark: SparkSession, directory: str) -> DataFrame:
    """New message files (JSON lines) as message rows with text."""
    return (
        spark.readStream.schema(CHANNEL_MESSAGES).json(directory)
        .where(F.col("text") != "")
    )


def deduplicate(messages: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drop repeated message keys; state older than the watermark is forgotten."""
    return messages.withWatermark("posted_at", lateness).dropDuplicatesWithinWatermark(
        MESSAGE_KEY)


def run_upsert(stream: DataFrame, path: str, keys: list[str], checkpoint: str, *,
               month_of: str | None = None, order_by: str | None = None,
               every: str | None = None) -> StreamingQuery:
    """Upsert each micro-batch into a stored table; by default all that is there, then stop.

    A batch that is replayed after a failure replaces its own rows.
    """
    writer = stream.writeStream.foreachBatch(
        lambda batch, _: upsert(batch, path, keys, month_of=month_of, order_by=order_by)
    ).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def ingest_daily_files(spark: SparkSession, directory: str, path: str,
                       checkpoint: str) -> StreamingQuery:
    return run_upsert(stream_daily_files(spark, directory), path, SESSION_KEY, checkpoint,
                      month_of="trade_date", order_by="source_file")


def tag_stream(messages: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tip columns and ticker (exact and nickname stages) of streamed messages.

    One stateless pass: the symbols named by a message are looked up by a stream-static join on
    its tokens one by one, so a message with two known tickers yields two candidate rows; they
    are settled per message by ``settle_tags`` inside the micro-batch. The fuzzy stage needs
    the distinct texts of a batch and runs with the batch resolver.
    """
    names = symbol_names(clean_master(symbols)).select(F.col("symbol").alias("_token"))
    # A message's own row has a key of its own, which no token equals: one key for all of them would
    # gather the stream in one task.
    own = F.concat(F.lit(" "), F.concat_ws("\x1f", *MESSAGE_KEY))
    tokens = F.concat(F.array(own), ticker_tokens("text"))
    return (
        with_tip_columns(messages).withColumn("_token", F.explode(tokens))
        .join(names.withColumn("_known", F.lit(True)), "_token", "left")
        .where(F.col("_known") | F.col("_token").startswith(" "))
        .withColumn("_exact", F.when(F.col("_known"), F.col("_token")))
        .select(*MESSAGE_KEY, "text", "posted_at", "_exact",
                alias_symbol("text").alias("_alias"), *TIP_COLUMNS)
    )


def settle_tags(batch: DataFrame) -> DataFrame:
    """One row per message of a tagged micro-batch: a single known token, else the nickname."""
    kept = [c for c in batch.columns if c not in {*MESSAGE_KEY, "_exact"}]
    found = batch.groupBy(*MESSAGE_KEY).agg(
        F.count("_exact").alias("_hits"), F.min("_exact").alias("_exact"),
        F.any_value(F.struct(*kept)).alias("_row"))
    return found.select(
        *MESSAGE_KEY, "_row.*", F.when(F.col("_hits") == 1, F.col("_exact")).alias("_exact"),
    ).withColumn("ticker", F.coalesce("_exact", "_alias")).drop("_exact", "_alias")


def tag_batch(batch: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tip columns and ticker of a stored micro-batch, one row per message.

    Symbols are looked up for the bare tokens, by the join that holds with hot ones; texts and tip
    columns meet the few known tokens by message key.
    """
    master = clean_master(symbols).select("symbol", F.lit("").alias("name"))
    exact = exact_hits(batch, master).select(
        *[F.col(k).alias(f"_{k}") for k in MESSAGE_KEY], F.col("exact").alias("_exact"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in MESSAGE_KEY]
    return (
        with_tip_columns(batch).select(
            *MESSAGE_KEY, "text", "posted_at", alias_symbol("text").alias("_alias"), *TIP_COLUMNS)
        .join(exact, same, "left").withColumn("ticker", F.coalesce("_exact", "_alias"))
        .select(*MESSAGE_KEY, "text", "posted_at", *TIP_COLUMNS, "ticker")
    )


def run_tagging(messages: DataFrame, symbols: DataFrame, path: str, checkpoint: str, *,
                lateness: str = LATENESS, every: str | None = None) -> StreamingQuery:
    """Write the tagged messages of a stream, each message key once, under ``path``.

    By default all that is there, then stop. Every micro-batch has a folder of its own, so a batch
    that is replayed after a failure replaces its own rows.
    """
    def publish(batch: DataFrame, number: int) -> None:
        arrived = materialize(batch, "arrived")
        tag_batch(arrived, symbols).write.mode("overwrite").parquet(f"{path}/batch={number}")
        release(arrived)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        deduplicate(messages, lateness).writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def sliding_channels(mentions: DataFrame, *, lateness: str = LATENESS,
                     window: str = WINDOW, step: str = STEP) -> DataFrame:
    """Distinct channels per ticker and sliding window ``(start, end]``.

    The one-microsecond offset turns Spark's ``[start, end)`` windows around. Repeats are
    dropped per (ticker, window, channel) before counting, so the state of a hot ticker spreads
    over all tasks and the count per window is one number. The watermark ends both states.
    """
    return (
        mentions.where(F.col("ticker").isNotNull()).withWatermark("posted_at", lateness)
        .select("ticker", "channel_id",
                F.window("posted_at", window, step, "1 microsecond").alias("w"))
        .dropDuplicates(["ticker", "channel_id", "w"])
        .groupBy("ticker", "w").agg(F.count("*").alias("n_channels"))
        .select("ticker",
                (F.col("w.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("window_end"),
                "n_channels")
    )


def open_channels(mentions: DataFrame, *, lateness: str = LATENESS, window: str = WINDOW,
                  step: str = STEP) -> DataFrame:
    """Counts of the windows that a finished stream over the same mentions has left open.

    A batch frame of all mentions the stream has read. Only those that can lie in an open window
    are counted: the ones after the final watermark, less one window. Together with what
    ``sliding_channels`` has written this is every window, each once.
    """
    known = mentions.where(F.col("ticker").isNotNull())
    # The stream's watermark: the newest time less the lateness, in whole milliseconds.
    mark = F.date_trunc("millisecond", F.max("posted_at") - F.expr(f"INTERVAL {lateness}"))
    watermark = F.lit(known.agg(mark).first()[0]).cast("timestamp")
    recent = known.where(F.col("posted_at") >= watermark - F.expr(f"INTERVAL {window}"))
    end = F.col("window_end") + F.expr("INTERVAL 1 MICROSECOND")
    return sliding_channels(recent, lateness=lateness, window=window, step=step).where(
        end > watermark)


def rank_bursts(windows: DataFrame, baseline: DataFrame, limit: int = 25) -> DataFrame:
    """The ``limit`` most unusual bursts of each window end, against a stored baseline.

    ``baseline``: ``ticker, baseline_mean, baseline_std``. A ticker without one has mean 0. A
    micro-batch may close several window ends (a backlog); each is ranked by itself.
    """
    mean = F.coalesce(F.col("baseline_mean"), F.lit(0.0))
    std = F.coalesce(F.col("baseline_std"), F.lit(0.0))
    n = F.col("n_channels")
    z = F.when(std > 1e-9, (n - mean) / F.nullif(std, F.lit(0.0))).when(
        n > mean, F.lit(float("inf"))).otherwise(0.0)
    scored = windows.join(baseline, "ticker", "left").withColumn("z", z)
    rank = F.when(F.col("z") == float("inf"), F.lit(1e9)).otherwise(F.col("z"))
    order = Window.partitionBy("window_end").orderBy(rank.desc(), F.desc("n_channels"), "ticker")
    return (
        scored.where(is_burst(n, F.col("z")))
        .withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit)
        .select("ticker", "window_end", "n_channels", "z")
    )


def run_watchlist(windows: DataFrame, baseline: DataFrame, path: str, checkpoint: str,
                  limit: int = 25) -> StreamingQuery:
    """Write the ranked bursts of every micro-batch's closed windows."""
    return (
        windows.writeStream.outputMode("append").foreachBatch(_publish(baseline, path, limit))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_stored_watchlist(mentions: DataFrame, baseline: DataFrame, root: str, path: str,
                         checkpoint: str, limit: int = 25) -> StreamingQuery:
    """The same from a stream of mentions whose windows are kept in files under ``root``: a state store
    would hold each channel of every open window in memory."""
    return run_channel_windows(mentions, root, checkpoint, past=True,
                               then=_publish(baseline, path, limit))


def _publish(baseline: DataFrame, path: str, limit: int):
    def publish(batch: DataFrame, number: int) -> None:
        rank_bursts(batch, baseline, limit).write.mode("overwrite").parquet(
            f"{path}/batch={number}")
    return publish
