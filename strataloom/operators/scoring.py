"""Weighted roll-ups with states: measured, unknown, not applicable. Unknown is priced, never zero; not applicable leaves both sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories, their aspects and weights; letter floors; default curve constant and prices.
CATEGORIES = {
    "modularity": {"file_size": 0.35, "duplication": 0.25, "change_coupling": 0.25, "churn_hotspots": 0.15},
    "reusability": {"duplication": 0.30, "near_duplication": 0.30, "idiom_consistency": 0.25, "file_size": 0.15},
    "analyzability": {"declaration_size": 0.30, "documentation": 0.20, "dead_code": 0.15, "risk_patterns": 0.15, "churn_hotspots": 0.10, "knowledge_concentration": 0.10},
    "modifiability": {"change_coupling": 0.25, "duplication": 0.20, "churn_hotspots": 0.15, "risk_patterns": 0.15, "knowledge_concentration": 0.10, "policy_gates": 0.10, "file_size": 0.05},
    "testability": {"test_presence": 0.40, "declaration_size": 0.24, "test_effectiveness": 0.20, "policy_gates": 0.16},
}
LETTERS = ((4.8, "A+"), (4.5, "A"), (4.0, "B"), (3.0, "C"), (2.0, "D"))
CURVE, UNKNOWN = 4.35, 4.0
#: Halves are rounded up, whatever the order in which doubles were summed.
HALF = 1e-9


def curve(normalized: Column, constant: float = CURVE) -> Column:
    """5c / (p + c), held between 0 and 5; null stays null."""
    return F.when(normalized.isNull(), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(5.0), 5 * constant / (normalized + constant))))


def steps(rate: Column, ladder: list[tuple[float, float]], floor: float) -> Column:
    """Score of the first ceiling that the rate does not exceed, else ``floor``; null stays null."""
    out = F.when(rate.isNull(), None)
    for ceiling, score in ladder:
        out = out.when(rate <= ceiling, score)
    return out.otherwise(floor)


def rollup(aspects: DataFrame, by: list[str], weights: dict[str, dict[str, float]] = CATEGORIES, price: float = UNKNOWN, low: float = 0.0, high: float = 5.0) -> DataFrame:
    """(by, category, score, low, high) from (by, aspect, score, state): weighted means, unknown priced at ``price``, ``low`` and ``high``."""
    spark = aspects.sparkSession
    table = spark.createDataFrame([(c, a, w) for c, own in weights.items() for a, w in own.items()], "category string, aspect string, weight double")
    joined = aspects.filter("state <> 'not_applicable'").join(F.broadcast(table), "aspect")  # as many rows as the fixed weights
    value = lambda p: F.round(F.sum(F.col("weight") * F.when(F.col("state") == "measured", F.col("score")).otherwise(p)) / F.sum("weight") + HALF, 4)
    return joined.groupBy(*by, "category").agg(value(price).alias("score"), value(low).alias("low"), value(high).alias("high"))


def overall(categories: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the rounded categories, and its bounds."""
    return categories.groupBy(*by).agg(*[F.round(F.avg(c) + HALF, 4).alias(c) for c in ("score", "low", "high")])


def letter(score: Column, readings: list[tuple[Column, float, float]] = ()) -> Column:
    """Letter of a score; A+ and A need every reading under its ceiling for that letter, an unmeasured one fails all."""
    out = F.when(score.isNull(), None)
    for floor, name in LETTERS:
        passed = score >= floor
        if name in ("A+", "A"):
            for reading, top, second in readings:
                passed = passed & (F.coalesce(reading.cast("double"), F.lit(float("inf"))) <= (top if name == "A+" else second))
        out = out.when(passed, name)
    return out.otherwise("F")


def counterfactual(aspects: DataFrame, by: list[str], cleared: float = 5.0) -> DataFrame:
    """(by, aspect, delta): what the overall score gains if one aspect were clean. Scenario rows go through the same roll-up at once."""
    known = sorted({a for own in CATEGORIES.values() for a in own})
    names = aspects.sparkSession.createDataFrame([(x,) for x in known], "scenario string").join(aspects.select(F.col("aspect").alias("scenario")), "scenario", "left_semi")
    base = overall(rollup(aspects, by), by).select(*by, F.col("score").alias("_base"))
    scenarios = aspects.crossJoin(F.broadcast(names))  # the fixed few aspects that have weights
    own = F.col("aspect") == F.col("scenario")
    changed = scenarios.withColumn("score", F.when(own, cleared).otherwise(F.col("score"))).withColumn("state", F.when(own & (F.col("state") != "not_applicable"), "measured").otherwise(F.col("state")))
    scored = overall(rollup(changed, [*by, "scenario"]), [*by, "scenario"])
    return scored.join(base, by).select(*by, F.col("scenario").alias("aspect"), F.round(F.col("score") - F.col("_base"), 4).alias("delta"))
