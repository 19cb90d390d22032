"""Readers for the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinwell.sources.session import cut


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, cut to `columns` when given; a column that is missing raises at once."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} has no column {', '.join(missing)}")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with at least one partition for each core, for stages whose work is in Python.

    Large tables have more splits than that and are left as they are; a small file of
    one split is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Up to so many repeated keys are broadcast, by count; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def first_delivery(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that was delivered first by `order`.

    Only keys and times are shuffled, to find the keys that occur more than once; the
    rows themselves are filtered where they are. Of rows of one key that tie in `order`
    the one of the least content stays, one of equal rows; only those rows are shuffled. Rows with a null key all stay.
    """
    times = df.groupBy(*keys, order).agg(F.count("*").alias("_n")).groupBy(*keys)
    times = times.agg(F.min(F.struct(F.col(order).alias("at"), "_n")).alias("_first"), F.sum("_n").alias("_all"))
    known = F.lit(True)
    for key in keys:
        known &= F.col(key).isNotNull()
    repeated = cut(times.where("_all > 1").where(known).select(*keys, "_first"))
    small = repeated.count() <= BROADCAST_KEYS
    held = lambda rows: F.broadcast(rows) if small else rows
    first = F.col("_first").isNull() | F.col(order).eqNullSafe(F.col("_first.at"))
    rows = df.join(held(repeated), keys, "left").where(first)
    if repeated.where("_first._n > 1").isEmpty():
        return rows.select(*df.columns)
    tied = F.coalesce(F.col("_first._n") > 1, F.lit(False))
    least = F.min(F.struct(*(F.col(c) for c in df.columns))).alias("_row")
    return rows.where(~tied).select(*df.columns).unionByName(rows.where(tied).groupBy(*keys).agg(least).select("_row.*"))
