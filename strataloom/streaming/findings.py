"""State per finding and per series on a live scan log: what recurs, and what fell since the record before.

Records come in the order of the log. Each key has a small state (three numbers, or the last record). A batch of the log meets the
states of the batches before it in a join and writes those that it changed to a folder of its own in the shared storage, with the
offsets of the log checkpointed beside them; so no key is worked on by itself, a stream that is stopped or lost goes on where it was, and
a batch that is run again replaces its own files. The operators of ``series`` say the same of a log that is at rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def _states(spark: SparkSession, base: str, keys: list[str], schema: str, before: int | None = None) -> DataFrame:
    """The last state of each key, of the batches ``before`` that one or of all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = spark.read.option("basePath", f"{base}/out").schema(f"{schema}, batch bigint").parquet(f"{base}/out")
    else:
        rows = spark.createDataFrame([], f"{schema}, batch bigint")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")


def _merged(rows: DataFrame, keys: list[str], schema: str, merge: Callable[[DataFrame], DataFrame], base: str | None) -> DataFrame:
    """The states after all that a stream has now. ``merge``: from the rows of a batch, each with the state of its key as ``state`` (null if it has none), to the states they change."""
    base = base or f"{shared_dir(rows.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        known = _states(batch.sparkSession, base, keys, schema, n)
        rest = [c for c in known.columns if c not in keys]
        known = known.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*rest).alias("state"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        merge(batch.join(known.hint("merge"), same, "left").drop(*[f"_{k}" for k in keys])).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return _states(rows.sparkSession, base, keys, schema)


def presence(log: DataFrame, base: str | None = None) -> DataFrame:
    """(series, finding, seen, last, returned) of all records that a stream (series, scan, findings array<string>) has by now.

    Of a finding of a series: scans it stood in, the last of them, and how often it came back after a scan without it.
    ``scan`` is the place of a record in its series' log, from 1 on without gaps; a record that comes twice counts once.
    With ``base``, a folder in the shared storage, the state is kept there and the next call goes on from it.
    """
    keys = ["series", "finding"]
    rows = log.select(F.col("series").cast("string").alias("series"), F.explode("findings").alias("finding"), F.col("scan").cast("long").alias("scan"))

    def merge(met: DataFrame) -> DataFrame:
        # A record at or before the last one that was seen comes again and tells nothing.
        new = met.filter(F.col("state").isNull() | (F.col("scan") > F.col("state.last"))).distinct()
        before = F.coalesce(F.lag("scan").over(Window.partitionBy(*keys).orderBy("scan")), "state.last", F.col("scan") - 1)
        steps = new.withColumn("step", F.col("scan") - before)
        known = lambda c: F.coalesce(F.max(f"state.{c}"), F.lit(0))  # noqa: E731  the same for all rows of a key
        return steps.groupBy(*keys).agg((known("seen") + F.count("*")).alias("seen"), F.max("scan").alias("last"), (known("returned") + F.count_if(F.col("step") > 1)).alias("returned"))

    return _merged(rows, keys, "series string, finding string, seen long, last long, returned long", merge, base)


def latest(log: DataFrame, base: str | None = None) -> DataFrame:
    """(series, name, place, before, value, records) of all records that a stream (series, name, place, value) has by now: the last record of each key and the value before it.

    ``place``: a string that sorts as the log is ordered; records at or before the last one that was seen are ignored. Of several at one
    place the least value counts.
    """
    keys = ["series", "name"]
    rows = log.select(F.col("series").cast("string").alias("series"), F.col("name").cast("string").alias("name"), F.col("place").cast("string").alias("place"), F.col("value").cast("double").alias("value"))

    def merge(met: DataFrame) -> DataFrame:
        new = met.filter(F.col("state").isNull() | (F.col("place") > F.col("state.place"))).groupBy(*keys, "place").agg(F.min("value").alias("value"), F.first("state").alias("state"))
        behind = new.withColumn("before", F.lag(F.struct("value")).over(Window.partitionBy(*keys).orderBy("place")))
        last = behind.groupBy(*keys).agg(F.max_by(F.struct("place", "value", "before", "state"), "place").alias("x"), F.count("*").alias("n"))
        before = F.when(F.col("x.before").isNotNull(), F.col("x.before.value")).otherwise(F.col("x.state.value"))
        return last.select(*keys, "x.place", before.alias("before"), "x.value", (F.coalesce("x.state.records", F.lit(0)) + F.col("n")).alias("records"))

    return _merged(rows, keys, "series string, name string, place string, before double, value double, records long", merge, base)


def live_recurrence(found: DataFrame, last_scans: DataFrame, returns: int = 0) -> DataFrame:
    """(series, finding, seen, cleared, returned) from the states of findings and (series, last) of the series: as ``series.recurrence`` has them.

    ``returns``: only findings that came back so often at least; with 2, those that escalate.
    """
    ends = last_scans.select("series", F.col("last").alias("_end"))
    gone = (F.col("last") < F.col("_end")).cast("long")
    return found.filter(F.col("returned") >= returns).join(ends, "series").select("series", "finding", "seen", (F.col("returned") + gone).alias("cleared"), "returned")


def live_ratchet(states: DataFrame, drop: float = 0.05) -> DataFrame:
    """(series, name, before, after): the keys whose last value fell by more than ``drop``."""
    return states.filter(F.col("before") - F.col("value") > drop).select("series", "name", "before", F.col("value").alias("after"))
