"""A bounded running coreset over a stream of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thinwell.operators.selection import greedy_kcenter, unit_vectors


class RunningCoreset:
    """A coreset of at most `k` vectors in versions under `path`; every micro-batch is merged into it.

    Old members may leave for new ones. A version is named after its batch, so a
    batch that is run again after a failure starts from the version before it and
    gives the same result.
    """

    def __init__(self, path: str, k: int):
        self.path, self.k = path.rstrip("/"), k

    def _versions(self, spark: SparkSession) -> list[int]:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        done = [s.getPath() for s in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().partition("=")[2]) for p in done)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The newest version (id, embedding), or the newest before a batch; None where there is none."""
        versions = [v for v in self._versions(spark) if before is None or v < before]
        return spark.read.parquet(f"{self.path}/version={versions[-1]}") if versions else None

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merges one micro-batch of raw vectors (id, embedding)."""
        new = unit_vectors(batch)
        held = self.read(batch.sparkSession, number)
        pool = new if held is None else held.unionByName(new.join(held.select("id"), "id", "left_anti"))
        picked = greedy_kcenter(pool, self.k).select("id", "embedding")
        picked.orderBy("id").write.mode("overwrite").parquet(f"{self.path}/version={number}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts the merging of all rows of `stream` (id, embedding) that are there, and ends."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, late: str, window: str, *by: str) -> DataFrame:
    """by..., starts, n: events of each window of `time`, once the watermark `late` has passed it."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return grouped.select(*by, F.col("window.start").alias("starts"), "n")
