"""Replace-on-key maintenance of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipscope.operators.latest import latest_version, serving_features, store_summary
from tipscope.session import shared_dir


def merge_rows(stored: DataFrame, incoming: DataFrame, keys: list[str],
               order_by: str | None = None) -> DataFrame:
    """Stored rows with incoming ones put in their place by key.

    Among incoming rows of one key the highest ``order_by`` wins (for files: the last name).
    """
    order = F.col(order_by) if order_by else F.lit("")
    kind = dict(incoming.dtypes)[order_by] if order_by else "string"
    both = stored.withColumn("_seq", F.struct(
        F.lit(0).alias("load"), F.lit(None).cast(kind).alias("at")))
    new = incoming.select(*stored.columns).withColumn("_seq", F.struct(
        F.lit(1).alias("load"), order.alias("at")))
    return latest_version(both.unionByName(new), keys, "_seq").drop("_seq")


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def upsert(incoming: DataFrame, path: str, keys: list[str], *, month_of: str | None = None,
           order_by: str | None = None) -> None:
    """Insert or replace rows of the Parquet table at ``path``. Loading twice changes nothing.

    With ``month_of`` (a date column of the key) the table is partitioned by calendar month and
    only months the new rows touch are read and written again. The merged rows go through a
    reliable checkpoint first, so the files being replaced are no longer needed when the
    replacement is written.
    """
    spark = incoming.sparkSession
    shared_dir(spark)
    if month_of:
        incoming = incoming.withColumn("month", F.date_format(month_of, "yyyy-MM"))
    stored = _stored(spark, path, incoming)
    if stored is None:
        merged = latest_version(
            incoming.withColumn("_seq", F.col(order_by) if order_by else F.lit("")),
            keys, "_seq").drop("_seq")
    else:
        if month_of:
            months = [r["month"] for r in incoming.select("month").distinct().collect()]
            stored = stored.where(F.col("month").isin(*months))
        merged = merge_rows(stored, incoming, keys, order_by)
    merged = merged.checkpoint()
    writer = merged.write.mode("overwrite")
    if month_of:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("month")
    writer.parquet(path)


def build_serving_store(symbols: DataFrame, features: DataFrame, root: str,
                        sessions: int = 90) -> DataFrame:
    """Write all symbols and the newest sessions' features; return the summary row."""
    spark = features.sparkSession
    root = root.rstrip("/")
    symbols.write.mode("overwrite").parquet(f"{root}/symbols")
    serving_features(features, sessions).write.mode("overwrite").parquet(
        f"{root}/market_features")
    n_symbols = spark.read.parquet(f"{root}/symbols").agg(F.count("*")).scalar()
    return store_summary(spark.read.parquet(f"{root}/market_features")).withColumn(
        "n_symbols", n_symbols)
