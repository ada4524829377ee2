"""Stored market features that follow the stored prices.

``refresh_features`` compares the newest version of the stored prices with the one the features were
built from and computes only the sessions that a changed price row can reach: its own month and the
``LOOK_BACK`` sessions after it, from prices of the ``LOOK_BACK`` sessions before it. Which months
these are follows from stored facts, one row for each security and month (sessions, first flag,
listing date), so prices of other months are never read. A day's load of all securities thus reads
the last few months, whatever the length of the histories.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipscope.operators.features import (
    LOOK_BACK, MIN_HISTORY, REQUIRED_COLUMNS, finish_features, with_features,
)
from tipscope.operators.sessions import block_window, cut_blocks
from tipscope.schemas import SECURITY_KEY, SESSION_KEY, require_columns
from tipscope.session import materialize, release
from tipscope.sources import snapshots as S

BUILT = "built"


@dataclass(frozen=True)
class Refresh:
    """The features' version, the months of prices that were put through the windows, and whether
    all sessions were computed again."""

    version: int
    months_read: list[str]
    rebuilt: bool


def _prices(spark: SparkSession, root: str, version: S.Version, months: list[str]) -> DataFrame:
    """Price rows with a whole key, and their month. Others have no session and no features."""
    rows = S.version_rows(spark, root, version, months)
    require_columns(rows, [*SECURITY_KEY, *REQUIRED_COLUMNS], "stored prices")
    if "is_sme" not in rows.columns:
        rows = rows.withColumn("is_sme", F.lit(False))
    return (
        rows.select(*SECURITY_KEY, *REQUIRED_COLUMNS, "is_sme").dropna(subset=SESSION_KEY)
        .withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    )


def _facts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SECURITY_KEY, "month").agg(
        F.count("*").alias("n"), F.min_by("is_sme", "trade_date").alias("month_sme"))


def _listed(facts: DataFrame, symbols: DataFrame | None) -> DataFrame:
    if symbols is None:
        return facts.withColumn("date_of_listing", F.lit(None).cast("date"))
    listed = symbols.groupBy(*SECURITY_KEY).agg(F.max("date_of_listing").alias("date_of_listing"))
    return facts.join(listed, SECURITY_KEY, "left")


def _totals(facts: DataFrame, prefix: str) -> DataFrame:
    return facts.groupBy(*SECURITY_KEY).agg(
        F.sum("n").alias(f"{prefix}sessions"),
        F.min_by("month_sme", "month").alias(f"{prefix}sme"),
        F.max("date_of_listing").alias(f"{prefix}listing"))


def _differing(now: DataFrame, then: DataFrame) -> DataFrame:
    """Sessions whose row is new, changed or gone: the key, month and ``gone``."""
    key = [*SESSION_KEY, "month"]

    def side(rows: DataFrame, name: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in key]
        return rows.select(*key, F.struct(*rest).alias(name))

    both = side(now, "_now").join(side(then, "_then"), key, "full")
    return both.where(~F.col("_now").eqNullSafe(F.col("_then"))).select(
        *key, F.col("_now").isNull().alias("gone"))


def _whole_histories(facts: DataFrame, before: DataFrame, min_history: int) -> DataFrame:
    """Securities all of whose sessions change: new ones, those that now reach the shortest
    history, and those with another listing date or another flag on their first row."""
    joined = _totals(facts, "").join(_totals(before, "old_"), SECURITY_KEY, "left")
    return joined.where(
        F.col("old_sessions").isNull()
        | ((F.col("old_sessions") < min_history) & (F.col("sessions") >= min_history))
        | ~F.col("sme").eqNullSafe(F.col("old_sme"))
        | ~F.col("listing").eqNullSafe(F.col("old_listing"))
    ).select(*SECURITY_KEY, F.lit(True).alias("whole"))


def _needed(facts: DataFrame, affected: DataFrame, min_history: int) -> DataFrame:
    """(security, month) parts to read, with the sessions before each and the range to compute.

    ``affected``: a security with the first and last month that changed, or ``whole``. A history
    is a short list of months here, so the running sums go over months and not over sessions.
    """
    security = Window.partitionBy(*SECURITY_KEY)
    months = security.orderBy("month")
    runs = facts.withColumns({
        "_through": F.sum("n").over(months), "sessions": F.sum("n").over(security),
        "first_is_sme": F.first("month_sme").over(months),
    }).withColumn("_before", F.col("_through") - F.col("n"))
    whole = F.coalesce("whole", F.lit(False))
    ranged = runs.join(affected, SECURITY_KEY).where(F.col("sessions") >= min_history).withColumns({
        "_from": F.when(whole, 1).otherwise(F.min(F.when(
            F.col("month") >= F.col("lo"), F.col("_before"))).over(security) + 1),
        "_until": F.when(whole, F.col("sessions")).otherwise(F.max(F.when(
            F.col("month") <= F.col("hi"), F.col("_through"))).over(security) + LOOK_BACK),
    })
    return ranged.where(
        (F.col("_through") >= F.col("_from") - LOOK_BACK) & (F.col("_before") < F.col("_until"))
    ).select(*SECURITY_KEY, "month", "_before", "_from", "_until", "sessions", "first_is_sme",
             "date_of_listing")


def _features_of(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Features of the sessions in the ranges of ``needed``, from the months it names."""
    in_month = Window.partitionBy(*SECURITY_KEY, "month").orderBy("trade_date")
    numbered = (
        rows.withColumn("_rank", F.row_number().over(in_month))
        .join(needed, [*SECURITY_KEY, "month"])
        .withColumn("session", F.col("_before") + F.col("_rank"))
        .where(F.col("session").between(F.col("_from") - LOOK_BACK, F.col("_until")))
        .drop("_rank", "_before", "month")
    )
    windowed = with_features(cut_blocks(numbered, back=LOOK_BACK), block_window())
    return finish_features(windowed.where(
        ~F.col("is_copy") & (F.col("session") >= F.col("_from"))))


def refresh_features(spark: SparkSession, prices_root: str, features_root: str,
                     symbols: DataFrame | None = None, *,
                     min_history: int = MIN_HISTORY) -> Refresh:
    """Bring the stored features up to the newest version of the stored prices.

    ``prices_root`` is a table of ``load_snapshot`` with the session key and ``month_of`` its trade
    date. The features are ``market_features`` of all stored prices, in a table of the same kind,
    committed in one step together with the price version they stand for: a refresh that dies
    leaves the old features and is simply run again. Two refreshes at once are safe; what an older
    one puts over a newer one is corrected by the next.

    Defined cases: unchanged prices and listing dates commit nothing; another listing date, another
    flag on a first row, or reaching ``min_history`` computes a security's whole history again;
    removed price rows, another ``min_history``, and a price version that has been dropped since
    compute everything again; prices without rows give a table without rows; rows with a null in
    the session key have no features.
    """
    target = S.read_version(spark, prices_root)
    if target is None:
        raise ValueError(f"{prices_root}: no stored prices")
    state = S.read_version(spark, features_root)
    built = json.loads(state.notes[BUILT]) if state else None
    old = None
    if built and built["min_history"] == min_history and built["prices"] in S.versions(
            spark, prices_root):
        old = S.read_version(spark, prices_root, built["prices"])
        if not set(old.months) <= set(target.months):
            old = None

    changed = sorted(m for m in target.months if old is None or old.months.get(m) != target.months[m])
    now = _prices(spark, prices_root, target, changed)
    scratch: list[DataFrame] = []
    spans = None
    if old is not None:
        then = _prices(spark, prices_root, old, [m for m in changed if m in old.months])
        spans = materialize(_differing(now, then).groupBy(*SECURITY_KEY).agg(
            F.min("month").alias("lo"), F.max("month").alias("hi"),
            F.max("gone").alias("gone")), "changed-sessions")
        scratch.append(spans)
        if spans.where("gone").limit(1).count():
            old, spans, changed = None, None, sorted(target.months)
            now = _prices(spark, prices_root, target, changed)

    place = f"facts/{uuid.uuid4().hex}"
    facts = _facts(now)
    before = None
    if old is not None:
        before = spark.read.parquet(f"{features_root.rstrip('/')}/{built['facts']}")
        facts = facts.unionByName(
            before.where(~F.col("month").isin(changed)).select(facts.columns) if changed
            else before.select(facts.columns))
    facts = _listed(facts, symbols)
    facts.write.parquet(f"{features_root.rstrip('/')}/{place}")
    facts = spark.read.schema(facts.schema).parquet(f"{features_root.rstrip('/')}/{place}")

    if old is None:
        affected = facts.select(*SECURITY_KEY).distinct().select(
            *SECURITY_KEY, F.lit(True).alias("whole"), F.lit("").alias("lo"), F.lit("").alias("hi"))
    else:
        affected = _whole_histories(facts, before, min_history).join(
            spans.drop("gone"), SECURITY_KEY, "full")
    needed = materialize(_needed(facts, affected, min_history), "needed-months")
    scratch.append(needed)
    # The months of a calendar: a bounded list.
    months = sorted(r["month"] for r in needed.select("month").distinct().collect())
    if old is not None and not months and old.number == target.number:
        S.remove(spark, f"{features_root.rstrip('/')}/{place}")
        release(*scratch)
        return Refresh(state.number, [], False)

    features = _features_of(_prices(spark, prices_root, target, months), needed)
    note = json.dumps({"prices": target.number, "facts": place, "min_history": min_history})
    number = S.load_snapshot(features, features_root, SESSION_KEY, month_of="trade_date",
                             note=(BUILT, note), replace=old is None)
    release(*scratch)
    if built:
        S.remove(spark, f"{features_root.rstrip('/')}/{built['facts']}")
    return Refresh(number, months, old is None)
