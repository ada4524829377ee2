"""Sliding windows of a stream that lose nothing: written windows, open windows and late rows.

A micro-batch adds its rows to the windows that are open, writes those that the watermark has passed,
and keeps what comes for a window already written as late rows. Open windows are stored by their end,
so a batch rewrites only the ends it touches. One version file (see ``sources.snapshots``) names the
batch, the watermark and the open windows: until it is in place the batch has not happened, after it
a replay changes nothing. At any time written and open windows and late rows together hold each
row's every window.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tipscope.session import materialize, release
from tipscope.sources import snapshots as S

_HOUR = 3_600_000_000  # microseconds
OPEN = "ticker string, channel_id string"
CLOSED = "ticker string, window_end timestamp, n_channels bigint"
LATE = "ticker string, channel_id string, posted_at timestamp, window_end timestamp"


def window_ends(posted: Column, window: int, step: int) -> Column:
    """Ends (microseconds, whole steps) of the windows ``(end - window, end]`` with a time in them."""
    rest = F.pmod(posted, F.lit(step))
    first = posted - rest + F.when(rest > 0, step).otherwise(0)
    after = F.filter(F.transform(F.sequence(F.lit(0), F.lit(-(-window // step))),
                                 lambda k: first + k * F.lit(step)),
                     lambda end: end - window < posted)
    return after


def _batch(rows: DataFrame, number: int, root: str, lateness: int, window: int, step: int) -> None:
    spark = rows.sparkSession
    before = S.read_version(spark, root)
    if before and int(before.notes["batch"]) >= number:
        return  # a replay of what is committed
    known = rows.where(F.col("ticker").isNotNull() & F.col("posted_at").isNotNull()).select(
        "ticker", "channel_id", F.unix_micros("posted_at").alias("at"))
    placed = materialize(known.withColumn("end", F.explode(window_ends(F.col("at"), window, step))),
                         "placed")
    newest = placed.agg(F.max("at")).first()[0]
    mark = int(before.notes["watermark"]) if before else None
    last = max(x for x in (mark, newest and newest - lateness, -(1 << 62)) if x is not None)

    refused = F.col("end") <= (mark if mark is not None else -(1 << 62))
    late = placed.where(refused).select(
        "ticker", "channel_id", F.timestamp_micros("at").alias("posted_at"),
        F.timestamp_micros("end").alias("window_end"))
    late.write.mode("overwrite").parquet(f"{root}/late/batch={number}")

    folders = dict(before.months) if before else {}
    taken = placed.where(~refused).select("end", "ticker", "channel_id")
    touched = {r["end"] for r in taken.select("end").distinct().collect()}  # whole steps of time
    # Windows are stored by their end: what the batch touches or closes is read, nothing else.
    read = {e for e in map(int, folders) if e in touched or e <= last}
    stored = [spark.read.schema(OPEN).parquet(f"{root}/{folders[str(e)]}").withColumn(
        "end", F.lit(e).cast("bigint")) for e in sorted(read)]
    merged = taken
    for part in stored:
        merged = merged.unionByName(part)
    merged = materialize(merged.distinct(), "windows")
    closed = merged.where(F.col("end") <= last).groupBy("ticker", "end").agg(
        F.count("*").alias("n_channels")).select(
        "ticker", F.timestamp_micros("end").alias("window_end"), "n_channels")
    closed.write.mode("overwrite").parquet(f"{root}/closed/batch={number}")

    load = f"loads/{uuid.uuid4().hex}"
    merged.where(F.col("end") > last).write.partitionBy("end").parquet(f"{root}/{load}")
    folders = {e: f for e, f in folders.items() if int(e) > last}
    folders |= {str(e): f"{load}/end={e}" for e in touched if e > last}
    S.commit(spark, root, S.Version(
        before.number + 1 if before else 1, "", folders,
        {"batch": str(number), "watermark": str(last)}))
    release(placed, merged)


def run_channel_windows(mentions: DataFrame, root: str, checkpoint: str, *,
                        lateness_hours: float = 2, window_hours: int = 48,
                        step_hours: int = 24, past: bool = False,
                        then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the windows of a stream of mentions (ticker, channel_id, posted_at) under ``root``.

    Runs over all that is there, then stops. Rows without a ticker or time count nowhere. With ``past``
    a window that ends on the watermark stays open until it is past it. ``then`` gets the windows that
    each micro-batch has closed, and its number, once they are written; again if the batch is replayed.
    """
    home = root.rstrip("/")
    sizes = [int(h * _HOUR) for h in (lateness_hours, window_hours, step_hours)]
    sizes[0] += past  # whole microseconds

    def each(rows: DataFrame, number: int) -> None:
        _batch(rows, number, home, *sizes)
        if then is not None:
            then(rows.sparkSession.read.schema(CLOSED).parquet(f"{home}/closed/batch={number}"),
                 number)

    return mentions.writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _committed(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    version = S.read_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{root.rstrip('/')}/{kind}")
    return rows.where(F.col("batch") <= int(version.notes["batch"])).drop("batch")


def closed_windows(spark: SparkSession, root: str) -> DataFrame:
    """(ticker, window_end, n_channels) of the windows that the watermark has passed."""
    return _committed(spark, root, "closed", CLOSED)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows that came for a window already written, once for each such window."""
    return _committed(spark, root, "late", LATE)


def open_windows(spark: SparkSession, root: str) -> DataFrame:
    """(ticker, window_end, channel_id) of the windows that are still open."""
    version = S.read_version(spark, root)
    out = spark.createDataFrame([], "ticker string, window_end timestamp, channel_id string")
    for end, folder in sorted((version.months if version else {}).items()):
        rows = spark.read.schema(OPEN).parquet(f"{root.rstrip('/')}/{folder}")
        out = out.unionByName(rows.select(
            "ticker", F.timestamp_micros(F.lit(int(end))).alias("window_end"), "channel_id"))
    return out
