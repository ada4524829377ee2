"""Typed values out of untyped text fields. What cannot be parsed becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space plus the no-break space that spreadsheets leave behind.
_BLANKS = " \t\r\n\x0b\x0c "
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# A cast that fails raises and catches an error for each row, which costs more than all the rest of a
# row; so casts are only tried on texts that can pass (blanks: those that a cast itself strips).
_WHOLE = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"
# The series codes of the small-company segment.
SME_SERIES = ("SM", "ST")


def clean(col: Column | str) -> Column:
    """Strip white space at both ends; a blank field is missing."""
    text = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(_BLANKS))
    return F.when(text != "", text)


def clean_all(df: DataFrame) -> DataFrame:
    """``clean`` on every (string) column."""
    return df.select(*[clean(F.col(f"`{name}`")).alias(name) for name in df.columns])


def keep(col: Column) -> Column:
    return col


def to_double(col: Column) -> Column:
    """Decimal text (cleaned) to DOUBLE. Placeholders such as ``-`` give NULL, never NaN."""
    return F.when(col.rlike(_NUMBER), col.try_cast("double"))


def to_long(col: Column) -> Column:
    """Whole-number text (cleaned), also written as ``1.0``, to BIGINT."""
    number = to_double(col)
    return F.coalesce(F.when(col.rlike(_WHOLE), col.try_cast("bigint")),
                      F.when(number == F.floor(number), number.try_cast("bigint")))


def to_date(col: Column) -> Column:
    """Dates (cleaned) such as ``14-Aug-2026``."""
    return F.try_to_date(col, "d-MMM-yyyy")


def is_sme_series(series: Column | str) -> Column:
    series = F.col(series) if isinstance(series, str) else series
    return F.coalesce(series.isin(*SME_SERIES), F.lit(False))


def finite(col: Column | str) -> Column:
    """NaN and infinities are missing values."""
    number = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
