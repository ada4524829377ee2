"""Daily price files that are audited before they are loaded, with a ledger of every file.

A landed file counts only when the date inside it is the day it is named after: servers answer for a
closed day with the file of another one. Each micro-batch judges its files against the ledger, loads
the rows of the valid ones, and enters all of them with fingerprint, in-file date and verdict. Both
tables are stored tables that change in one step and note the batch, so a batch that is replayed
after a failure is judged and counted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tipscope.operators.latest import latest_version
from tipscope.schemas import SESSION_KEY
from tipscope.session import materialize, release
from tipscope.sources import snapshots as S
from tipscope.sources.calendar import internal_date_text, line_date
from tipscope.sources.exchange_files import DAILY_COLUMNS, read_text_csv, type_daily_rows

LANDED = "path string, modificationTime timestamp, length bigint, content binary"
FILES_PER_BATCH = 1000
LEDGER_KEY = ["path", "day"]
NO_DAY, NO_COLUMNS = "no day in the name", "columns are missing"
STALE, KNOWN = "stale/echoed content", "already loaded"


def day_of_name(path: Column) -> Column:
    """The day a file is named after, e.g. ``.../2026-08-14.csv``; NULL if it is none."""
    return F.substring(F.element_at(F.split(path, "/"), -1), 1, 10).try_cast("date")


def stream_landed(spark: SparkSession, directory: str, *, files_per_batch: int = FILES_PER_BATCH,
                  named_day: Callable[[Column], Column] = day_of_name) -> DataFrame:
    """Facts of new files: path, day, modified, bytes, sha256, header, internal_date.

    A file is one day of one exchange; a task holds its bytes (2 GB at most) while it hashes them.
    Files of no bytes give no row, as with every file reader of Spark, and stay out of the ledger.
    """
    landed = (
        spark.readStream.format("binaryFile").schema(LANDED)
        .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)
        .load(directory)
    )
    # A cast and not a decoder: bytes that are no UTF-8 are left to the reader of the rows.
    lines = F.split(F.col("content").cast("string"), "\r?\n", 3)
    return landed.withColumn("_lines", lines).select(
        "path", named_day(F.col("path")).alias("day"),
        F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.try_element_at("_lines", F.lit(1)).alias("header"),
        line_date(F.try_element_at("_lines", F.lit(2))).alias("internal_date"))


def judge_files(files: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Add ``status`` and ``note`` to the facts of new files.

    ``error``: no day in the name, or columns missing. ``nodata``: the file carries another date
    than its day, or none (stale copy, empty file). ``skipped``: the content that counts for its day
    already. ``valid``: all others, also a revision of a day. Files of a day are taken in order of
    modification time and path, after all files of the ledger. Files that the ledger has under the
    same path with the same content come out no more.
    """
    plain = F.regexp_replace("header", '["\\r\\ufeff]', "")
    names = F.transform(F.split(plain, ","), lambda name: F.trim(name))
    wanted = F.array(*[F.lit(name) for name in DAILY_COLUMNS])
    fault = (
        F.when(F.col("day").isNull(), NO_DAY)
        .when(~F.col("internal_date").eqNullSafe(internal_date_text("day")), STALE)
        .when(F.size(F.array_except(wanted, names)) > 0, NO_COLUMNS)
    )
    fresh = files
    if ledger is not None:
        fresh = files.join(ledger.select("path", "sha256"), ["path", "sha256"], "left_anti")
    judged = fresh.withColumns({"_fault": fault, "_old": F.lit(False)})
    if ledger is not None:
        current = ledger.where(F.col("status") == "valid").groupBy("day").agg(
            F.max_by("sha256", F.struct("entry", "modified", "path")).alias("sha256"))
        judged = judged.unionByName(
            current.withColumn("_old", F.lit(True)), allowMissingColumns=True)
    # Few rows for each day: its files of this batch and the one that counts so far.
    in_order = Window.partitionBy("day", F.col("_fault").isNull()).orderBy(
        F.desc("_old"), "modified", "path")
    same = F.col("sha256").eqNullSafe(F.col("_before"))
    return (
        judged.withColumn("_before", F.lag("sha256").over(in_order)).where(~F.col("_old"))
        .withColumn("note", F.coalesce("_fault", F.when(same, KNOWN)))
        .withColumn("status", F.when(F.col("note") == KNOWN, "skipped").when(
            F.col("note") == STALE, "nodata").when(F.col("note").isNotNull(), "error")
            .otherwise("valid"))
        .drop("_fault", "_old", "_before")
    )


def _one_form(path: Column) -> Column:
    """Paths as the two readers spell them, alike: not escaped, one slash behind the scheme."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^([A-Za-z0-9]+):/+", "$1:/")


def _rows_of_valid(spark: SparkSession, judged: DataFrame, exchange: str) -> DataFrame | None:
    """Typed rows of a batch's valid files; of rows with one key the last file's."""
    # At most one batch's files, which ``files_per_batch`` bounds.
    valid = judged.where(F.col("status") == "valid").select("header", "path").collect()
    layouts: dict[str, list[str]] = {}
    for row in valid:
        layouts.setdefault(row["header"], []).append(row["path"])
    if not layouts:
        return None
    rows = None
    for paths in layouts.values():
        raw = read_text_csv(spark, sorted(paths)).select(
            *DAILY_COLUMNS, F.col("_metadata.file_name").alias("source_file"),
            _one_form(F.col("_metadata.file_path")).alias("_path"))
        typed = type_daily_rows(raw.withColumn(
            "source_file", F.concat_ws("\n", "source_file", "_path")), exchange=exchange)
        rows = typed if rows is None else rows.unionByName(typed)
    both = F.split("source_file", "\n")
    placed = judged.select(_one_form(F.replace("path", F.lit("%"), F.lit("%25"))).alias("_path"),
                           F.struct("modified", "path").alias("_place"))
    rows = rows.withColumns({"_path": both[1], "source_file": both[0]}).join(placed, "_path")
    return latest_version(rows.drop("_path"), SESSION_KEY, "_place").drop("_place")


def load_audited(batch: DataFrame, number: int, prices_root: str, ledger_root: str,
                 stream: str, *, exchange: str = "NSE") -> None:
    """Judge one micro-batch, load its valid files, enter all files; once, however often called."""
    spark = batch.sparkSession
    name = f"batch of {stream}"
    version = S.read_version(spark, ledger_root)
    if version and int(version.notes.get(name, -1)) >= number:
        return
    files = materialize(batch, "landed")
    ledger = None
    if version:
        # Only what the ledger knows of the batch's months: a bounded list.
        months = files.select(F.coalesce(F.date_format("day", "yyyy-MM"), F.lit(S.WHOLE)).alias(
            "m")).distinct().collect()
        ledger = S.version_rows(spark, ledger_root, version,
                                [r["m"] for r in months if r["m"] in version.months])
    judged = materialize(judge_files(files, ledger), "judged")
    rows = _rows_of_valid(spark, judged, exchange)
    if rows is not None:
        S.load_snapshot(rows, prices_root, SESSION_KEY, month_of="trade_date",
                        note=(name, str(number)))
    # Counts on where the ledger stands, also when a stream starts over with batch 0.
    entry = version.number + 1 if version else 1
    entered = judged.drop("header").withColumn("entry", F.lit(entry).cast("bigint"))
    S.load_snapshot(entered, ledger_root, LEDGER_KEY, month_of="day", note=(name, str(number)))
    release(files, judged)


def ingest_audited(spark: SparkSession, directory: str, prices_root: str, ledger_root: str,
                   checkpoint: str, *, files_per_batch: int = FILES_PER_BATCH,
                   named_day: Callable[[Column], Column] = day_of_name, exchange: str = "NSE",
                   every: str | None = None) -> StreamingQuery:
    """Audit and load new files; by default all that are there, then stop.

    Prices are read with ``read_snapshot(spark, prices_root)``, the ledger with
    ``read_snapshot(spark, ledger_root)``. A stream that starts over with a new ``checkpoint`` reads
    all files again and changes nothing that the ledger has.
    """
    facts = stream_landed(spark, directory, files_per_batch=files_per_batch, named_day=named_day)

    def load(batch: DataFrame, number: int) -> None:
        load_audited(batch, number, prices_root, ledger_root, checkpoint, exchange=exchange)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (facts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())
