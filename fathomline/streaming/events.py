"""Incremental ingestion of preference events with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.upsert import replace_group


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def label_windows(stream: DataFrame, time: str, label: str, *, late: str = "3 days", window: str = "1 day") -> DataFrame:
    """Events per label and window; rows later than the look-back are dropped, repeated events count once within it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window(time, window), label).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


class SessionSink:
    """Sink for ``foreachBatch``: the events of a session are replaced as a whole, and a batch that comes again changes nothing.

    Each batch writes a new version of the table; the pointer is the highest complete version."""

    def __init__(self, spark: SparkSession, root: str, key: list[str]) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def table(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.root}/v={found[-1]}") if found else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number in self.versions():
            return
        stored = self.table()
        merged = batch if stored is None else replace_group(stored, batch, self.key)
        merged.write.mode("overwrite").parquet(f"{self.root}/v={number}")


def run_available(stream: DataFrame, sink, checkpoint: str) -> None:
    """Take in what is there, then stop; a rerun goes on from the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
