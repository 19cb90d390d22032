"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinwell.sources.session import cut


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """`df` with positions 0, 1, ... in the order of `order`, as a bigint column `name`.

    Range partitions are sorted and written once; only the number of rows in each
    partition reaches the driver. `order` should be total, or ties fall anywhere.
    Number narrow rows and join wide ones back by their key.
    """
    parts = cut(df.orderBy(*order)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    offset, offsets = 0, []
    for row in sorted(parts.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        offsets.append((row["_part"], offset))
        offset += row["count"]
    before = df.sparkSession.createDataFrame(offsets, "_part int, _before bigint")
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def batched(df: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """`df` with its `position` in order and its `batch` of `size` rows."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    return numbered(df, *order).withColumn("batch", F.floor(F.col("position") / size))
