"""Incremental forms of the batch operators. Every query runs with ``availableNow`` and a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """A Parquet table as a stream of its files; a single file is found in its folder by name."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Zoneless timestamps as instants in the session's zone: watermarks take no others."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def daily_counts(stream: DataFrame, time: str, by: str, late: str = "1 day") -> DataFrame:
    """(day, by, n) per day; rows later than ``late`` are dropped in append mode."""
    counted = event_time(stream, time).withWatermark(time, late).groupBy(F.window(time, "1 day"), by).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), by, "n")


def first_of_key(stream: DataFrame, time: str, key: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it."""
    return event_time(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def run_available(stream: DataFrame, mode: str = "append", partition_by: list[str] | None = None) -> DataFrame:
    """Runs the stream over what is there, into a Parquet table of the shared folder, and reads that.

    Complete mode replaces the table batch by batch, so its last batch is the result.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", out)
        writer = writer.partitionBy(*partition_by) if partition_by else writer
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def append_landing(source: DataFrame, target: str, checkpoint: str) -> None:
    """Appends what is new in a landing stream to a Parquet table; files seen before are not read again."""
    source.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", checkpoint).format("parquet").start(target).awaitTermination()
