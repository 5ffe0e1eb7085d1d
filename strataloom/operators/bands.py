"""Bands, corroboration of measurements, and criteria joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status(value: Column, warn: float, fail: float) -> Column:
    """ok, warn or fail: strictly above a limit. Null stays null: not measured is not zero."""
    return F.when(value.isNull(), None).when(value > fail, "fail").when(value > warn, "warn").otherwise("ok")


def band(value: Column, warn: float, fail: float) -> Column:
    """Pressure 0, .25, .5, .75 or 1 by the edges .6 warn, warn, fail and fail plus the distance of the two (1 at least); null stays null."""
    last = fail + max(fail - warn, 1)
    return F.when(value.isNull(), None).when(value <= 0.6 * warn, 0.0).when(value <= warn, 0.25).when(value <= fail, 0.5).when(value <= last, 0.75).otherwise(1.0)


def reversed_band(value: Column, warn: float, fail: float) -> Column:
    """The same for measures of which less is worse: edges warn, the middle, fail and fail less their distance."""
    return F.when(value.isNull(), None).when(value >= warn, 0.0).when(value >= (warn + fail) / 2, 0.25).when(value >= fail, 0.5).when(value >= fail - (warn - fail), 0.75).otherwise(1.0)


def pressure(units: DataFrame, by: list[str], limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean over the units of ``by`` of the worst band of a unit's measures; nulls of a unit are skipped, a unit of nulls alone is none."""
    worst = [band(F.col(c), *x) for c, x in limits.items()]
    worst_of = F.greatest(*worst) if len(worst) > 1 else worst[0]
    return units.withColumn("_b", worst_of).groupBy(*by).agg(F.avg("_b").alias("pressure"), F.count("_b").alias("units"))


def counts_by_role(units: DataFrame, by: list[str], is_test: Column, measures: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(by, role, units, <m>_fail, <m>_warn, <m>_pressure for each measure): all units of a group, its production and its test units, in one pass.

    ``measures``: name to (column, limit that warns, limit that fails). Roles are grouping sets, so each unit is
    counted on both levels before the shuffle; a group without tests has no row for them. What was not measured counts in ``units`` alone; a unit whose role is null is production.
    """
    rows = units.withColumn("_test", F.coalesce(is_test, F.lit(False)))
    out = [F.count("*").alias("units")]
    for name, (column, warn, fail) in measures.items():
        value = F.col(column)
        out += [F.count_if(status(value, warn, fail) == "fail").alias(f"{name}_fail"), F.count_if(status(value, warn, fail) == "warn").alias(f"{name}_warn"), F.avg(band(value, warn, fail)).alias(f"{name}_pressure")]
    keys = [F.col(c) for c in by]
    both = rows.groupingSets([keys, [*keys, F.col("_test")]], *keys, F.col("_test")).agg(F.grouping("_test").alias("_level"), *out)
    role = F.when(F.col("_level") == 1, "all").when(F.col("_test"), "test").otherwise("production")
    return both.withColumn("role", role).select(*by, "role", *[c for c in both.columns if c not in (*by, "_test", "_level")])


def corroborate(measurements: DataFrame) -> DataFrame:
    """(concept, unit, value, low, high, n_tools) from (concept, unit, tool, value, seq).

    A tool that reports a unit more than once is ambiguous there: its readings stay apart, as ``unit@tool#n``.
    """
    w = Window.partitionBy("concept", "unit", "tool")
    named = measurements.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("seq")))
    unit = F.when(F.col("n") > 1, F.concat(F.col("unit").cast("string"), F.lit("@"), F.col("tool").cast("string"), F.lit("#"), F.col("k").cast("string"))).otherwise(F.col("unit").cast("string"))
    return named.withColumn("unit", unit).groupBy("concept", "unit").agg(F.avg("value").alias("value"), F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("tool").alias("n_tools"))


def agreement(combined: DataFrame) -> DataFrame:
    """(concept, units, single, spread): mean relative spread over the units that more than one tool reports."""
    spread = (F.col("high") - F.col("low")) / F.coalesce(F.nullif(F.abs("value"), F.lit(0.0)), F.lit(1.0))
    return combined.groupBy("concept").agg(F.count("*").alias("units"), F.count_if(F.col("n_tools") == 1).alias("single"), F.avg(F.when(F.col("n_tools") > 1, spread)).alias("spread"))


def index_quantiles(values: DataFrame, by: str, value: str) -> DataFrame:
    """Upper median and 90th percentile by index into the sorted values (no interpolation), by ranks instead of lists."""
    w = Window.partitionBy(by).orderBy(value)
    ranked = values.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("_v"), (F.row_number().over(w) - 1).alias("_r"), F.count("*").over(Window.partitionBy(by)).alias("_n"))
    at = lambda q: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * q), F.col("_v")))
    return ranked.groupBy(by).agg(at(F.lit(0.5)).alias("median"), at(F.lit(0.9)).alias("p90"), F.max("_v").alias("largest"))


def complete_criteria(units: DataFrame, built_in: DataFrame, keys: list[str], criteria: list[str]) -> DataFrame:
    """Each criterion from ``units``, else from ``built_in``; units that still miss one are left out."""
    right = built_in.select(*keys, *[F.col(c).alias(f"_{c}") for c in criteria])
    joined = units.join(right, keys, "left")
    return joined.select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in criteria]).dropna("any", subset=criteria)


def touched(ranges: DataFrame, changed: DataFrame, width: int = 64) -> DataFrame:
    """Ranges (path, start, lines) that hold a changed (path, line): a range join by blocks of ``width`` lines."""
    cut = ranges.withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.greatest("lines", F.lit(1)) - 1) / width))))
    lines = changed.select(F.col("path").alias("_p"), F.col("line").alias("_l"), F.floor(F.col("line") / width).alias("_lk")).distinct()
    hit = (cut["path"] == lines["_p"]) & (cut["_k"] == lines["_lk"]) & (lines["_l"] >= cut["start"]) & (lines["_l"] < cut["start"] + cut["lines"])
    return cut.join(lines, hit, "left_semi").drop("_k").distinct()


def breaches(units: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """(keys, criterion, value, allowed): one row for each limit that a unit exceeds."""
    found = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value"), F.lit(float(m)).alias("allowed")) for c, m in limits.items()])
    return units.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*").filter("value > allowed")
