"""Which calendar days have a valid price file, and the log of that decision."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def internal_date_text(day: Column | str) -> Column:
    """The date as the files spell it, e.g. ``14-Aug-2026``."""
    return F.date_format(day, "dd-MMM-yyyy")


def default_range(end: Column | str) -> tuple[Column, Column]:
    """Two years back to ``end``; 29 February falls back to the 28th."""
    end = F.col(end) if isinstance(end, str) else end
    return F.add_months(end, -24), end


def line_date(line: Column | str) -> Column:
    """Third field of a line of a price file, without blanks and quotes; NULL if it has fewer."""
    fields = F.split(F.col(line) if isinstance(line, str) else line, ",")
    return F.when(F.size(fields) >= 3, F.trim(F.regexp_replace(
        F.try_element_at(fields, F.lit(3)), '^\\s*"|"\\s*$', "")))


def first_data_dates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, internal_date): third field of each file's first line after the header.

    A file with only a header has NULL. Only the lines of a file's first split are ranked, and
    the rank filter drops all but two lines per file before anything is shuffled.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"), "value",
    ).where(F.col("_start") == 0)
    first = Window.partitionBy("source_file").orderBy("_line")
    return (
        lines.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= 2)
        .groupBy("source_file").agg(
            F.max(F.when(F.col("_rank") == 2, line_date("value"))).alias("internal_date"))
    )


def calendar_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))


def classify_days(days: DataFrame, fetches: DataFrame) -> DataFrame:
    """Status of every day: ``valid``, ``nodata``, ``skipped`` or ``error``, with a note.

    ``fetches`` has at most one row per day: ``day, http_code, bytes, internal_date, cached``.
    A weekend or a 404 is a closed day. A 200 whose file carries another date is a stale copy
    and also counts as closed. Any other outcome, also none at all, is an error to retry.
    """
    joined = days.join(fetches, "day", "left")
    code = F.col("http_code")
    matches = F.col("internal_date").eqNullSafe(internal_date_text("day"))
    weekend = F.weekday("day") >= 5
    cached = F.coalesce(F.col("cached"), F.lit(False))
    answered = ~cached & ~weekend
    return joined.select(
        "day",
        F.when(cached, "skipped").when(weekend, "nodata").when(code == 404, "nodata")
        .when(code.isNull() | (code != 200), "error").when(matches, "valid")
        .otherwise("nodata").alias("status"),
        F.when(answered, code).alias("http_code"),
        F.when(answered, F.coalesce(F.col("bytes"), F.lit(0))).otherwise(0).alias("bytes"),
        F.when(answered & (code == 200), F.col("internal_date")).alias("internal_date"),
        F.when(cached, "already cached").when(weekend, "weekend")
        .when(code == 404, "404 holiday").when(code.isNull(), "request failed")
        .when(code != 200, "unexpected status").when(matches, None)
        .otherwise("stale/echoed content").alias("note"),
    )


def file_fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Size and first 12 hex digits of the SHA-256 of each landed file."""
    return (
        spark.read.format("binaryFile").load(paths)
        .select(F.element_at(F.split("path", "/"), -1).alias("source_file"),
                F.col("length").alias("bytes"),
                F.substring(F.sha2("content", 256), 1, 12).alias("sha256_12"))
    )


def manifest_rows(classified: DataFrame, fingerprints: DataFrame,
                  url_pattern: str = "") -> DataFrame:
    """Log rows of the resolved days; only valid files carry a fingerprint.

    Landed files are named after their day. ``url_pattern`` may hold ``{ddMMyyyy}``.
    """
    before, _, after = url_pattern.partition("{ddMMyyyy}")
    url = F.concat(F.lit(before), F.date_format("day", "ddMMyyyy"), F.lit(after))
    prints = fingerprints.select(
        F.to_date(F.substring("source_file", 1, 10)).alias("day"), "sha256_12")
    return (
        classified.where(F.col("status") != "skipped").join(prints, "day", "left")
        .select(
            F.col("day").alias("date"),
            F.when(F.col("note") == "weekend", "(skipped-weekend)").otherwise(url).alias("url"),
            F.col("http_code").cast("int").alias("http_code"),
            F.col("bytes").cast("bigint").alias("bytes"), "status", "internal_date",
            F.when(F.col("status") == "valid", F.col("sha256_12")).alias("sha256_12"),
            F.current_timestamp().alias("retrieved_at_utc"))
    )


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def status_totals(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count("*").alias("n_days"))
