"""An equi-join that stays balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.session import materialize

# A key is hot when it holds more than this share of the rows, so at most 1 / share keys are.
# A hot key is dealt over as many buckets as it holds shares, so a bucket holds about one share.
HOT_SHARE = 1.0 / 1000.0


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n_rows) of the rows that have a key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))


def hot_keys(counts: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """(key, salts) of keys with more than ``share`` of the keyed rows: at most 1 / share rows."""
    total = counts.select(F.coalesce(F.sum("n_rows"), F.lit(0))).scalar()
    limit = total * F.lit(share)
    return counts.where(F.col("n_rows") > limit).select(
        key, F.ceil(F.col("n_rows") / limit).cast("int").alias("_salts"))


def skew_join(big: DataFrame, small: DataFrame, key: str, *, spread_by: list[str | Column],
              how: str = "left", counts: DataFrame | None = None,
              share: float = HOT_SHARE) -> DataFrame:
    """Join ("left" or "inner") ``big`` with ``small`` (at most one row per key) on one key column.

    Rows of a hot key are dealt over buckets by a hash of ``spread_by`` (columns that tell the
    rows apart) and the one matching row of ``small`` is copied to each bucket. All other keys
    keep one bucket, so ``small`` grows by at most ``2 / share`` rows. Rows without a key cannot
    match: they never enter the join and are added after it. The list of hot keys is bounded by
    ``1 / share``, which is why it may be broadcast; ``small`` itself is left to the optimizer,
    which broadcasts it only when its measured size allows. ``counts`` may pass in known
    ``key_counts`` of ``big``.
    """
    counts = key_counts(big, key) if counts is None else counts
    hot = F.broadcast(hot_keys(counts, key, share))
    salt = F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
    left = (
        big.where(F.col(key).isNotNull()).join(hot, key, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    )
    right = (
        small.where(F.col(key).isNotNull()).join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(
            F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    )
    joined = left.join(right, [key, "_salt"], how).drop("_salt")
    if how == "inner":
        return joined
    return joined.unionByName(big.where(F.col(key).isNull()), allowMissingColumns=True)


#: A lookup table is broadcast when it is stored in no more rows and bytes than these.
LOOKUP_ROWS, LOOKUP_BYTES = 100_000, 8 << 20


def lookup_join(big: DataFrame, small: DataFrame, key: str, *, spread_by: list[str | Column],
                how: str = "left", counts: DataFrame | None = None,
                rows: int = LOOKUP_ROWS) -> DataFrame:
    """The same join for a ``small`` side that is usually a lookup table.

    ``small`` is stored, so that its plan runs once, and measured. Within the bounds it is broadcast:
    ``big`` is then read once and not shuffled, and no key is hot. Beyond them ``skew_join`` takes
    over.
    """
    stored = materialize(small.where(F.col(key).isNotNull()), "lookup")
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= LOOKUP_BYTES and stored.count() <= rows:
        return big.join(F.broadcast(stored), key, how)
    return skew_join(big, stored, key, spread_by=spread_by, how=how, counts=counts)
