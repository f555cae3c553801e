"""Windowed counts over a stream: an extension, as the evaluations themselves are batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = "2 hours") -> DataFrame:
    """Rows and total value of each event type and time window; with a watermark on streams."""
    t = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming and late:
        t = t.withWatermark("at", late)
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return t.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(spark: SparkSession, folder: str, pattern: str, out: str, width: str = "1 hour") -> DataFrame:
    """Run the windows over all files that are there (AvailableNow) in batches, each update written once by its batch id; the
    last update of a window counts."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch_id={number}")

    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    q = windowed(stream, width).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/data")
    return got.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v")).select("w", "event_type", "v.n", "v.total")
