"""Hopping windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hopping(stream: DataFrame, keys: list[str], time: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    """keys, start, n, total of each window; times without a zone are read in the session's. State of a window is dropped once the watermark (`late` behind) has passed its end."""
    got = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(*keys, F.window(time, size, slide).alias("w"))
    return got.agg(F.count(value).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def run_available(updates: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Run an aggregated stream over all there is at the time, and return the last state of each key.

    Every micro-batch writes its updates to a folder of its own number, so a batch that is run again replaces itself.
    """
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")
    query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rest = [c for c in updates.columns if c not in keys]
    rows = updates.sparkSession.read.parquet(f"{path}/updates")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parquet*")
