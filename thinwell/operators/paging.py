"""Shards and strided page sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thinwell.plans.config import SelectionConfig


def sharded(df: DataFrame, shards: int, key: str = "id", name: str = "shard") -> DataFrame:
    """`df` with its shard, the remainder of the key; rows with a null key belong to none and are dropped."""
    return df.where(F.col(key).isNotNull()).withColumn(name, F.pmod(F.col(key), F.lit(shards)).cast("int"))


def strided_pages(df: DataFrame, config: SelectionConfig, shard: str = "shard", limited: bool = True) -> DataFrame:
    """The rows that paged sampling keeps, with `position` in their shard and `page`.

    Of each page the offsets 0, s, 2s, ... are kept, s being the stride. With
    `limited`, reading stops after the pages that total_samples allows. Rows of a
    shard are ordered by id; a shard that ends inside a page keeps what it reached.
    """
    order = Window.partitionBy(shard).orderBy(config.id_column)
    rows = df.withColumn("position", F.row_number().over(order) - 1).withColumn("page", F.floor(F.col("position") / config.page_rows).cast("int"))
    rows = rows.where(F.col("position") % config.stride == 0)
    return rows.where(F.col("page") < config.pages_per_shard) if limited else rows


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that depends on key and seed alone."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def rank_rows(df: DataFrame, world: int, rank: int, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """The rows of one of `world` readers in one epoch: disjoint, together all rows, dealt anew each epoch."""
    if not 0 <= rank < world:
        raise ValueError("rank must lie below world")
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed + epoch)), F.lit(world)) == rank)


def shard_stats(df: DataFrame, config: SelectionConfig, valid: str = "valid", shard: str = "shard") -> DataFrame:
    """Per shard its rows, the kept ones, the pages they lie on, and of the kept ones those that are not `valid`."""
    rows = df.groupBy(shard).agg(F.count("*").alias("n_rows"))
    kept = strided_pages(df, config, shard, limited=False)
    kept = kept.groupBy(shard).agg(F.count("*").alias("kept"), F.countDistinct("page").alias("pages"), F.count_if(~F.col(valid)).alias("skipped"))
    return rows.join(kept, shard).select(shard, "n_rows", "kept", "pages", "skipped")
