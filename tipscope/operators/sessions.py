"""Per-security windows that do not depend on how long one security's history is.

A window partitioned by security alone puts a whole history into one task. Every frame used
here reaches at most a fixed number of sessions back or ahead, so a history can be cut into
blocks of consecutive sessions, each with copies of the neighbouring sessions its frames need.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.schemas import SECURITY_KEY
from tipscope.session import materialize

BLOCK_SESSIONS = 512


def number_sessions(prices: DataFrame, symbols: DataFrame | None = None, *,
                    span: tuple[date, date] | None = None) -> DataFrame:
    """Add ``session`` (1, 2, ... in date order) and per-security facts.

    Adds ``sessions`` (length of the history), ``first_is_sme`` (flag of the earliest row) and
    ``date_of_listing``. Ranks are taken inside (security, calendar year), which the table key
    bounds to 366 rows, and shifted by the sizes of the earlier years. The table of year sizes
    has one row per security and year; the symbol master is joined to that table and not to
    the prices, so the price rows are never shuffled on the bare security.

    The rows are stored before they are ranked: the year sizes and the ranks read that table, so what
    ``prices`` stands for is computed once, and the ranked rows meet the year sizes where they are.
    This runs a job while the plan is built.

    With a ``span`` of days rows from its end on are left out (sessions and facts still count them), and
    ``earlier`` is added: sessions in the calendar years before its first day's.
    """
    year_key = [*SECURITY_KEY, "_year"]
    in_year = Window.partitionBy(*year_key).orderBy("trade_date")
    stored = materialize(prices, "prices").withColumn("_year", F.year("trade_date"))
    asked = stored if span is None else stored.where(F.col("trade_date") < F.lit(span[1]))
    ranked = asked.withColumn("_rank", F.row_number().over(in_year))
    years = stored.groupBy(*year_key).agg(
        F.count("*").alias("_in_year"),
        F.min_by("is_sme", "trade_date").alias("_year_sme"),
    )
    whole = Window.partitionBy(*SECURITY_KEY)
    ordered = whole.orderBy("_year")
    offsets = years.select(
        *year_key,
        F.coalesce(
            F.sum("_in_year").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_in_year").over(whole).alias("sessions"),
        F.first("_year_sme").over(
            ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ).alias("first_is_sme"),
        *([] if span is None else [F.coalesce(F.sum(F.when(
            F.col("_year") < span[0].year, F.col("_in_year"))).over(whole), F.lit(0)
        ).alias("earlier")]),
    )
    if symbols is None:
        offsets = offsets.withColumn("date_of_listing", F.lit(None).cast("date"))
    else:
        listed = symbols.groupBy(*SECURITY_KEY).agg(
            F.max("date_of_listing").alias("date_of_listing"))
        offsets = offsets.join(listed, SECURITY_KEY, "left")
    return (
        # One row for each security and year: broadcast when its measured size allows.
        ranked.join(offsets, year_key)
        .withColumn("session", F.col("_before") + F.col("_rank"))
        .drop("_rank", "_before", "_year")
    )


def cut_blocks(numbered: DataFrame, *, back: int = 0, ahead: int = 0,
               block: int = BLOCK_SESSIONS) -> DataFrame:
    """Assign rows to blocks and add the copies that neighbouring blocks look at.

    Adds ``block`` and ``is_copy``. ``back`` and ``ahead`` are the farthest distances any frame
    reaches; both must fit in one block, so a row has at most one copy on either side.
    """
    if max(back, ahead) > block:
        raise ValueError("a frame must not reach over more than one block")
    own = F.floor((F.col("session") - 1) / block).cast("bigint")
    place = F.pmod(F.col("session") - 1, F.lit(block))

    def at(number: Column, is_copy: bool) -> Column:
        return F.struct(number.alias("block"), F.lit(is_copy).alias("is_copy"))

    homes = [at(own, False)]
    if back:
        homes.append(F.when(
            (place >= block - back) & (F.col("sessions") > (own + 1) * block),
            at(own + 1, True)))
    if ahead:
        homes.append(F.when((place < ahead) & (own > 0), at(own - 1, True)))
    return (
        numbered.withColumn("_home", F.explode(F.filter(F.array(*homes), F.isnotnull)))
        .select("*", "_home.block", "_home.is_copy").drop("_home")
    )


def block_window() -> Window:
    return Window.partitionBy(*SECURITY_KEY, "block").orderBy("session")
