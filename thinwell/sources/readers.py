"""Further sources: image files, row access, row batches."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, image (bytes and path) of the files under `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.struct(F.col("content").alias("bytes"), "path").alias("image"))


def row_at(df: DataFrame, key: str, value) -> dict | None:
    """The row of one key as a dict, or None; the predicate reaches the scan."""
    row = df.where(F.col(key) == value).first()
    return None if row is None else row.asDict(recursive=True)


def row_count(df: DataFrame) -> int:
    """The number of rows, as the length of the row wrapper."""
    return df.count()


def generated(spark: SparkSession, make, schema: str, parts: int = 1) -> DataFrame:
    """Rows that `make(part)` yields, one call for each of `parts` partitions."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(frames):
        for frame in frames:
            for part in frame["id"].tolist():
                rows = iter(make(part))
                while some := list(itertools.islice(rows, 1_000)):
                    yield pd.DataFrame(some, columns=names)

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)
