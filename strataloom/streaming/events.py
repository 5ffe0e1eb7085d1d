"""The scan log as a stream: counts in windows of event time, with a watermark for late records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def log_stream(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """A stream of the Parquet files of that name in a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{file}").schema).option("pathGlobFilter", file).parquet(folder)


def windowed(stream: DataFrame, keys: list[str], time: str = "ts", window: str = "1 day", late: str = "2 days", value: str = "value") -> DataFrame:
    """(keys, start, records, total) of tumbling windows; records later than ``late`` behind the newest are dropped by the watermark."""
    # Zone-less times stand for UTC, whatever the zone of the session.
    at = F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{time}` as timestamp_ntz)))")
    start = F.expr("timestampadd(MICROSECOND, unix_micros(window.start), timestamp_ntz'1970-01-01 00:00:00')")
    grouped = stream.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", window), *keys)
    return grouped.agg(F.count("*").alias("records"), F.sum(value).alias("total")).select(*keys, start.alias("start"), "records", "total")


def drained(stream: DataFrame, window_key: list[str], base: str | None = None) -> DataFrame:
    """All that a stream has now, as a table: each batch writes the rows it changed, the last state of each key counts.

    Batches go to a folder each, so that one that is run again after a loss replaces its own files. With a ``base`` from a
    call before, the stream goes on where that one ended.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in window_key]
    rows = spark.read.option("basePath", f"{base}/out").schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").parquet(f"{base}/out")
    return rows.groupBy(*window_key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*window_key, "s.*")
