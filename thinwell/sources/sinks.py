"""Sinks: numbered Parquet shards, selections and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinwell.operators.numbering import batched


def write_selection(selected: DataFrame, path: str) -> None:
    """Ids and vectors of a selection side by side, sorted by id."""
    selected.select("id", "embedding").orderBy("id").write.mode("overwrite").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions as JSON lines; null columns are left out of a line."""
    predictions.write.mode("overwrite").json(path)


def _rename(spark: SparkSession, folder: str, names: dict[int, str]) -> None:
    """Moves the one file of each batch folder to its name; renames only, no data passes the driver."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith("batch="):
            continue
        for part in files.listStatus(status.getPath()):
            if part.getPath().getName().endswith(".parquet"):
                files.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(root, names[int(name.partition("=")[2])]))
        files.delete(status.getPath(), True)


def write_shards(rows: DataFrame, path: str, size: int, *order: str) -> int:
    """Rows in the order of `order` as train-00000-of-00012.parquet and so on, `size` rows each; returns the number of shards.

    The rows themselves are numbered, so repeated and null keys lose and multiply nothing; nulls come first,
    ties in any order. An empty table writes no shard.
    """
    placed = batched(rows, size, *order)
    last = placed.agg(F.max("batch")).first()[0]
    shards = 0 if last is None else last + 1
    if shards:
        placed.repartition("batch").sortWithinPartitions("batch", "position").drop("position").write.mode("overwrite").partitionBy("batch").parquet(path)
        _rename(rows.sparkSession, path, {i: f"train-{i:05d}-of-{shards:05d}.parquet" for i in range(shards)})
    return shards
