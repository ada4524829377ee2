"""Stored tables that change in one step.

A table is a folder of immutable load folders and numbered version files. A version names, for each
calendar month, the folder that holds its rows. Loading writes new folders for the months it touches
and then puts the next version file in place; that one rename is the commit. Until it happens readers
see the old version whole, after it the new one, wherever a writer dies. Two writers of one version
cannot both win: the second finds the name taken, reads again and merges again. A reader that keeps a
version number reads the same rows however often the table is loaded, until old versions are removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tipscope.operators.latest import latest_version
from tipscope.session import materialize, release
from tipscope.sources.tables import merge_rows

#: Rows without a date, and tables without months, are kept under this name.
WHOLE = "all"
ATTEMPTS = 20


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


# Single files -----------------------------------------------------------------------------------

def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(place)


def put_file(spark: SparkSession, path: str, text: str, *, replace: bool) -> None:
    """Write a small file whole or not at all: under another name, then renamed.

    Without ``replace`` an existing file is left as it is and ``VersionTaken`` is raised.
    """
    files, place = _file_system(spark, path)
    beside = place.suffix(f".{uuid.uuid4().hex}.tmp")
    out = files.create(beside, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if replace else kinds.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        place.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(beside, place, options)
    except Exception as error:
        files.delete(beside, False)
        if "FileAlreadyExists" in str(error):
            raise VersionTaken(path) from None
        raise


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None when there is none."""
    files, place = _file_system(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens when there is none."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


# Versions ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Version:
    """Months and their folders, the columns, and what the loads have noted by name."""

    number: int
    schema: str
    months: dict[str, str]
    notes: dict[str, str] = field(default_factory=dict)


def _version_file(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/versions/{number:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    files, place = _file_system(spark, f"{root.rstrip('/')}/versions")
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """A committed version, by default the newest; None for a table that was never loaded."""
    if number is None:
        known = versions(spark, root)
        if not known:
            return None
        number = known[-1]
    text = read_file(spark, _version_file(root, number))
    if text is None:
        raise ValueError(f"{root}: no version {number}")
    return Version(number, **json.loads(text))


def version_rows(spark: SparkSession, root: str, version: Version,
                 months: list[str]) -> DataFrame:
    """The rows of some months of a version; other months are not read."""
    schema = StructType.fromJson(json.loads(version.schema))
    folders = [f"{root.rstrip('/')}/{version.months[m]}" for m in months]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """All rows of a version, by default of the newest; None for a table never loaded."""
    version = read_version(spark, root, number)
    return version and version_rows(spark, root, version, sorted(version.months))


def commit(spark: SparkSession, root: str, version: Version) -> None:
    """Make a version readable. Raises ``VersionTaken`` when its number is in use."""
    body = {"schema": version.schema, "months": version.months, "notes": version.notes}
    put_file(spark, _version_file(root, version.number), json.dumps(body, sort_keys=True),
             replace=False)


def _write_months(rows: DataFrame, root: str) -> str:
    """Rows with a ``_month`` in a new load folder; its name."""
    load = f"loads/{uuid.uuid4().hex}"
    rows.write.partitionBy("_month").parquet(f"{root.rstrip('/')}/{load}")
    return load


def load_snapshot(incoming: DataFrame, root: str, keys: list[str], *, month_of: str | None = None,
                  order_by: str | None = None, note: tuple[str, str] | None = None,
                  replace: bool = False) -> int:
    """Insert or replace rows by key and commit; returns the number of the version that has them.

    ``month_of`` is a date column of the key: only months that the new rows touch are read and
    written again. Among incoming rows of one key the highest ``order_by`` wins. A ``note`` (name,
    value) is kept with the version; a load whose note is there already changes nothing, so a
    load that is repeated after a failure counts once. ``replace`` puts the rows in place of
    all rows that there were.
    Defined cases: no rows commit an unchanged version (its first has no months); rows without a
    date share one folder; null key columns are values like others.
    """
    spark = incoming.sparkSession
    columns = incoming.columns
    month = F.coalesce(F.date_format(month_of, "yyyy-MM"), F.lit(WHOLE)) if month_of else F.lit(
        WHOLE)
    new = materialize(incoming.withColumn("_month", month), "incoming")
    # The months of a calendar: a bounded list.
    touched = sorted(r["_month"] for r in new.select("_month").distinct().collect())
    schema = incoming.schema.json()
    try:
        for _ in range(ATTEMPTS):
            before = read_version(spark, root)
            if before and note and before.notes.get(note[0]) == note[1]:
                return before.number
            known = {} if before is None or replace else before.months
            again = [m for m in touched if m in known]
            if again:
                stored = version_rows(spark, root, before, again).select(*columns).withColumn(
                    "_month", month)
                merged = merge_rows(stored, new, keys, order_by)
            else:
                merged = latest_version(
                    new.withColumn("_seq", F.col(order_by) if order_by else F.lit("")),
                    keys, "_seq").drop("_seq")
            months = dict(known)
            if touched:
                load = _write_months(merged, root)
                months |= {m: f"{load}/_month={m}" for m in touched}
            notes = dict(before.notes if before else {}) | dict([note] if note else [])
            number = before.number + 1 if before else 1
            try:
                commit(spark, root, Version(number, schema, months, notes))
                return number
            except VersionTaken:
                continue
        raise VersionTaken(f"{root}: {ATTEMPTS} attempts lost to other writers")
    finally:
        release(new)


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all versions but the newest ``keep``, and load folders that none of those names and
    that no writer may still be about to commit; returns how many load folders went.

    Version files go first, so no reader finds a version without its rows. Folders of a load that
    was never committed go as well: run this while nobody writes.
    """
    known = versions(spark, root)
    kept, old = known[-keep:], known[:-keep]
    files, base = _file_system(spark, root.rstrip("/"))
    path = spark._jvm.org.apache.hadoop.fs.Path
    for number in old:
        files.delete(path(_version_file(root, number)), False)
    used = {folder.split("/")[1] for number in kept
            for folder in read_version(spark, root, number).months.values()}
    loads = path(base, "loads")
    gone = [status.getPath() for status in files.listStatus(loads)
            if status.getPath().getName() not in used] if files.exists(loads) else []
    for folder in gone:
        files.delete(folder, True)
    return len(gone)
