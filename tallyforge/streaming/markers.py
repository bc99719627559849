"""Incremental reading: marker-gated micro-batches, upserts of their rows, and throughput by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import MARKER, prediction_csv


def marker_stream(spark: SparkSession, path: str) -> DataFrame:
    """Markers as they appear; a shard without one stays unseen."""
    return spark.readStream.schema(MARKER).option("multiLine", True).option("pathGlobFilter", "shard_*.done").json(path)


def merge(state: DataFrame | None, rows: DataFrame, keys: tuple[str, ...] = ("tar_path", "member"), order: str = "shard") -> DataFrame:
    """Upsert: the row of the latest marker wins; running it again changes nothing."""
    both = rows if state is None else state.unionByName(rows, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return both.withColumn("_place", place).where("_place = 1").drop("_place")


def sync(spark: SparkSession, markers_path: str, table_path: str, checkpoint: str):
    """Reads the predictions of new markers into a table by shard; a shard whose marker comes again, or a batch that is
    repeated, replaces the shard's rows, so no row is doubled."""

    def write(batch: DataFrame, batch_id: int) -> None:
        name = F.substring_index("output_csv", "/", -1)
        marks = batch.where("output_csv IS NOT NULL").groupBy(name.alias("_name")).agg(F.max("shard").alias("shard"), F.max("output_csv").alias("output_csv"))
        paths = [r["output_csv"] for r in marks.select("output_csv").collect()]  # one for each marker of the batch
        if paths:
            rows = prediction_csv(spark, paths).drop("shard").withColumn("_name", F.substring_index("source_prediction_csv", "/", -1))
            rows = rows.join(F.broadcast(marks.select("_name", "shard")), "_name").drop("_name")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(table_path)

    return marker_stream(spark, markers_path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throughput(events: DataFrame, time: str = "ts", minutes: int = 30) -> DataFrame:
    """Rows by window of event time; late rows beyond the watermark are left out."""
    return events.withWatermark(time, "1 hour").groupBy(F.window(time, f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "n")
