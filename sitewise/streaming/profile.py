"""Profiles that grow with a stream: windowed counts, and mergeable partials kept batch by batch.

An extension: the batch operators need none of it. All partials are sums, so a batch that is replayed
after a failure must replace its earlier self; it is written under its batch number for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import descriptive as ds
from sitewise.operators import federation as fed


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts by window and key; rows later than ``late`` behind the watermark drop."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("window_start"), *keys, "cnt")


def session_counts(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each key: start, end and events."""
    return stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("cnt")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "cnt")


class IncrementalProfile:
    """Numeric partials by site and column of a stream, one folder per batch; ``current`` merges them."""

    def __init__(self, path: str, node: str, columns: list[str]):
        self.path, self.node, self.columns = path, node, columns

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: writes the partials of a batch, replacing those of a replay."""
        fed.numeric_partials(ds.melt(batch, F.col(self.node), self.columns)).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def current(self, spark: SparkSession) -> DataFrame:
        return fed.pooled_numeric(spark.read.parquet(self.path).select("node_id", "column_name", "n", "mean", "variance", "min", "max"))

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
