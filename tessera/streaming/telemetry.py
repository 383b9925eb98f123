"""Incremental runs: telemetry windows and idempotent merges of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; on a stream, rows later than ``late`` are dropped and windows closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def append_new(batch: DataFrame, path: str, keys: list[str], parts: int = 64) -> int:
    """Adds the rows whose keys the table lacks, once each; a replayed batch adds nothing.

    The table is dealt by a hash of the keys into ``parts`` folders, and only those that the batch touches are read.
    """
    spark = batch.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fresh = batch.dropDuplicates(keys).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        touched = [r["_part"] for r in fresh.select("_part").distinct().collect()]  # at most parts
        fresh = fresh.join(spark.read.parquet(path).where(F.col("_part").isin(touched)).select(*keys), keys, "left_anti")
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.partitionBy("_part").mode("append").parquet(path)
    fresh.unpersist()
    return n


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The table that append_new keeps."""
    return spark.read.parquet(path).drop("_part")


def merge_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A started query that merges each micro-batch by append_new and stops when the source is read."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
