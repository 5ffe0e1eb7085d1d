"""Sequences of scans: comparable segments, trends, recurrence, ratchets. Order is the order of the log, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(scans: DataFrame, by: list[str], order: list[str], key: list[str]) -> DataFrame:
    """``segment`` from 0 on: a new one begins wherever the key differs from the scan before; coming back to an old key is new too. Nulls are equal to nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    opens = F.when(F.row_number().over(w) == 1, 0).when(same, 0).otherwise(1)
    return scans.withColumn("_new", opens).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def velocity(scans: DataFrame, by: list[str], order: list[str], fingerprints: str) -> DataFrame:
    """(by, scans, introduced, cleared): sums over consecutive scans of what came and what went."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(fingerprints).over(w)
    steps = scans.select(*by, F.when(before.isNotNull(), F.size(F.array_except(fingerprints, before))).otherwise(0).alias("i"), F.when(before.isNotNull(), F.size(F.array_except(before, F.col(fingerprints)))).otherwise(0).alias("c"))
    return steps.groupBy(*by).agg(F.count("*").alias("scans"), F.sum("i").alias("introduced"), F.sum("c").alias("cleared"))


def stable(scans: DataFrame, by: list[str], scan: str, fingerprints: str) -> DataFrame:
    """(by, fingerprint): findings that stand in every scan, by counting."""
    total = scans.groupBy(*by).agg(F.countDistinct(scan).alias("n"))
    each = scans.select(*by, scan, F.explode(fingerprints).alias("fingerprint")).groupBy(*by, "fingerprint").agg(F.countDistinct(scan).alias("k"))
    return each.join(total, by).filter("k = n").select(*by, "fingerprint")


def trajectory(scans: DataFrame, by: list[str], order: list[str], estimate: str, low: str, high: str) -> DataFrame:
    """(by, first, last, verdict): improved, worsened, or indistinguishable where the intervals overlap; unknown under two scans or without an estimate."""
    place = F.struct(*order)
    ends = scans.groupBy(*by).agg(F.count("*").alias("n"), *[f(F.col(c), place).alias(f"{p}_{a}") for p, f in (("first", F.min_by), ("last", F.max_by)) for a, c in (("e", estimate), ("l", low), ("h", high))])
    verdict = F.when((F.col("n") < 2) | F.col("first_e").isNull() | F.col("last_e").isNull(), "unknown").when((F.col("first_l") <= F.col("last_h")) & (F.col("last_l") <= F.col("first_h")), "indistinguishable").when(F.col("last_e") > F.col("first_e"), "improved").otherwise("worsened")
    return ends.select(*by, F.col("first_e").alias("first"), F.col("last_e").alias("last"), verdict.alias("verdict"))


def growth(scans: DataFrame, by: list[str], order: list[str], population: str, findings: str, least: float = 0.05) -> DataFrame:
    """(by, verdict): whether the population grew by more than ``least``, and whether the rate of findings rose."""
    place = F.struct(*order)
    ends = scans.groupBy(*by).agg(F.min_by(population, place).alias("p0"), F.max_by(population, place).alias("p1"), F.min_by(findings, place).alias("f0"), F.max_by(findings, place).alias("f1"))
    grew, worse = F.col("p1") > F.col("p0") * (1 + least), F.col("f1") / F.nullif("p1", F.lit(0)) > F.col("f0") / F.nullif("p0", F.lit(0))
    verdict = F.when(worse.isNull(), "unknown").when(grew & worse, "growing, worse").when(grew, "growing, holding").when(worse, "steady, worse").otherwise("steady, holding")
    return ends.select(*by, verdict.alias("verdict"))


def movement(runs: DataFrame, by: list[str], order: list[str], value: str, tolerance: float = 0.05) -> DataFrame:
    """``moved`` against the run before in the same segment, and its verdict."""
    moved = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return runs.withColumn("moved", moved).withColumn("verdict", F.when(F.col("moved").isNull(), "first").when(F.abs("moved") < tolerance, "within").when(F.col("moved") > 0, "up").otherwise("down"))


def ratchet(scores: DataFrame, by: list[str], order: list[str], name: str, value: str, drop: float = 0.05) -> DataFrame:
    """(by, name, before, after): values that fell by more than ``drop`` between the last two rows of a name."""
    w = Window.partitionBy(*by, name).orderBy(*[F.desc(c) for c in order])
    last = scores.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    pair = last.groupBy(*by, name).agg(F.max(F.when(F.col("_r") == 2, F.col(value))).alias("before"), F.max(F.when(F.col("_r") == 1, F.col(value))).alias("after"))
    return pair.filter(F.col("before") - F.col("after") > drop)


def recurrence(presence: DataFrame, scans: DataFrame, by: list[str], scan: str, finding: str) -> DataFrame:
    """(by, finding, seen, cleared, returned): ``presence`` (by, scan, finding) rows against all ``scans`` (by, scan) of a segment.

    Only changes are looked at: a finding is cleared where the next scan is not the next one it stands in, and returned
    where it stands again after that.
    """
    numbered = scans.select(*by, scan).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(scan)))
    last = numbered.groupBy(*by).agg(F.max("_n").alias("_last"))
    here = presence.select(*by, scan, finding).distinct().join(numbered, [*by, scan]).join(last, by)
    w = Window.partitionBy(*by, finding).orderBy("_n")
    gap = here.withColumn("_next", F.lead("_n").over(w))
    return gap.groupBy(*by, finding).agg(F.count("*").alias("seen"), F.count_if(F.coalesce("_next", F.col("_last") + 1) > F.col("_n") + 1).alias("_gaps"), F.count_if(F.col("_next") > F.col("_n") + 1).alias("returned"), F.max(F.when(F.col("_next").isNull() & (F.col("_n") < F.col("_last")), 1).otherwise(0)).alias("_gone")).select(*by, finding, "seen", (F.col("returned") + F.col("_gone")).alias("cleared"), "returned")


def compact(records: DataFrame, by: list[str], order: list[str], keep: int) -> DataFrame:
    """Both ends and evenly stepped rows between them, about ``keep`` in all."""
    w = Window.partitionBy(*by)
    placed = records.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.ceil((F.col("_n") - 1) / (keep - 1)))
    return placed.filter((F.col("_r") % step == 0) | (F.col("_r") == F.col("_n") - 1)).drop("_r", "_n")


def runs(points: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, run, n, first, last): a series cut at its nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    cut = points.withColumn("run", F.sum(F.col(value).isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(value).isNotNull())
    return cut.groupBy(*by, "run").agg(F.count("*").alias("n"), F.min_by(value, F.struct(*order)).alias("first"), F.max_by(value, F.struct(*order)).alias("last"))


def one_per_class(items: DataFrame, cls: str, order: list[Column], paths: str, limit: int | None = None) -> DataFrame:
    """The first item of each class and the class's number of distinct paths."""
    first = items.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy(*order))).filter("_r = 1").drop("_r")
    out = first.join(items.groupBy(cls).agg(F.countDistinct(paths).alias("class_paths")), cls)
    return out.orderBy(*order).limit(limit) if limit else out
