"""The whole scorer over one summary row for each project: aspects, categories, overall score with its bounds, and a gated letter.

Every step is a column expression, so any number of projects and scenarios is scored in one pass without a shuffle.
Null is "could not look": it is priced, and never counts as a clean reading.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import CATEGORIES, HALF, LETTERS, UNKNOWN, curve, steps

# Medians of the corpus, step functions (up to ceiling, score; last: beyond), caps, and ceilings of A+ and A.
REFERENCES = {"file_size": 0.0871, "declaration_size": 0.0944, "duplication": 0.2973, "risk_patterns": 0.0249, "policy_gates": 0.05}
LADDERS = {
    "history": ([(0.0, 5.0), (0.02, 4.5), (0.05, 4.0), (0.10, 3.0), (0.20, 2.0)], 1.0),
    "test_presence": ([(0.0, 0.0), (0.05, 1.5), (0.10, 2.5), (0.20, 3.5), (0.30, 4.5)], 5.0),
    "knowledge_concentration": ([(0.2, 5.0), (0.4, 4.0), (0.6, 3.0), (0.8, 2.0)], 1.0),
    "dead_code": ([(0.0, 5.0), (0.001, 4.5), (0.005, 3.5), (0.015, 2.5)], 1.5),
    "near_duplication": ([(0.0, 5.0), (0.005, 4.5), (0.01, 4.0), (0.02, 3.0), (0.05, 2.0)], 1.0),
    "idiom_consistency": ([(0, 5.0), (1, 3.5), (2, 2.5)], 1.5),
}
UNTESTED_CAP, UNPAIRED_CAP = 2.0, 4.0
CEILINGS = {"file_fail": (0.0, 0.005), "decl_fail": (0.0, 0.005), "file_warn": (0.02, 0.05), "decl_warn": (0.02, 0.05), "duplication": (0.0, 0.02), "risk": (0.0, 0.02), "gates": (0.0, 0.0)}
FLOORS = {"files": 20, "declarations": 139, "production_declarations": 53}
PILLARS = {"readability": ["declaration_size", "documentation", "idiom_consistency"], "maintainability": ["file_size", "duplication", "near_duplication", "change_coupling", "churn_hotspots", "dead_code", "knowledge_concentration"], "testability": ["test_presence", "policy_gates"]}


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _share(count: str, of: str, read: Callable[[str], Column] = _c) -> Column:
    return F.when(read(of) > 0, read(count) / read(of))


def displayed(value: Column) -> Column:
    """The one rounding: from 0 to 5, one decimal; null stays null, which greatest and least would pass over."""
    return F.when(value.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), value)) + HALF, 1))


def _pressure(name: str, read: Callable[[str], Column]) -> Column:
    if name == "file_size":
        return read("file_band_pressure")
    if name == "declaration_size":
        return read("declaration_band_pressure")
    return _share({"duplication": "duplicate_blocks", "risk_patterns": "risk_findings", "policy_gates": "gate_failures"}[name], "files", read)


def pressures(read: Callable[[str], Column] = _c) -> dict[str, Column]:
    return {name: _pressure(name, read) for name in REFERENCES}


def _documentation() -> Column:
    extras = F.col("has_changelog").cast("int") + F.col("has_docs").cast("int")
    return F.when(F.col("has_readme").isNull() | extras.isNull(), None).when(F.col("has_readme"), F.lit(3.0) + extras).otherwise(F.when(extras > 0, 1.5).otherwise(0.5))


def _test_presence(read: Callable[[str], Column]) -> Column:
    share = F.when(read("declarations") > 0, (read("declarations") - read("production_declarations")) / read("declarations"))
    return F.when(read("test_files") == 0, 0.0).when(read("test_files").isNotNull(), steps(share, *LADDERS["test_presence"]))


#: Each aspect by what it reads; only those that are asked for become expressions.
ASPECTS: dict[str, Callable] = {name: lambda read, name=name: displayed(curve(_pressure(name, read) / REFERENCES[name])) for name in REFERENCES} | {
    "change_coupling": lambda read: steps(_share("coupled_pairs", "files_changed", read), *LADDERS["history"]),
    "churn_hotspots": lambda read: steps(_share("hotspots", "files_changed", read), *LADDERS["history"]),
    "knowledge_concentration": lambda read: steps(_share("single_author_files", "settled_files", read), *LADDERS["knowledge_concentration"]),
    "test_presence": _test_presence,
    "dead_code": lambda read: steps(_share("dead_declarations", "production_declarations", read), *LADDERS["dead_code"]),
    "near_duplication": lambda read: steps(_share("near_duplicates", "production_declarations", read), *LADDERS["near_duplication"]),
    "idiom_consistency": lambda read: steps(read("divergent_concerns"), *LADDERS["idiom_consistency"]),
    "documentation": lambda read: _documentation(),
    "test_effectiveness": lambda read: displayed(read("coverage_percent") / 20),
}


def aspects(read: Callable[[str], Column] = _c) -> dict[str, Column]:
    """The 14 aspects of a summary row, 0 to 5; null where an input is. ``read`` gives a counter by its name: the column, or what it would be."""
    return {name: make(read) for name, make in ASPECTS.items()}


def not_applicable() -> dict[str, Column]:
    """Aspects without a population: they leave both sums. Coverage is opt-in; without settled files nobody can own one."""
    return {"test_effectiveness": F.col("coverage_percent").isNull(), "knowledge_concentration": F.coalesce(_c("settled_files") == 0, F.lit(False)), "change_coupling": F.coalesce(_c("files_changed") == 0, F.lit(False)), "churn_hotspots": F.coalesce(_c("files_changed") == 0, F.lit(False))}


def weights(category: str, absent: dict[str, Column] | None = None) -> dict[str, Column]:
    """Weights of a category's aspects: 0 for those without a population."""
    absent = absent or not_applicable()
    return {a: F.when(absent[a], 0.0).otherwise(w) if a in absent else F.lit(w) for a, w in CATEGORIES[category].items()}


def partial_sums(price: float) -> dict[str, tuple[Column, Column]]:
    """(sum of weighted aspects, sum of weights) of each category, over a_<aspect>."""
    zero, absent, out = F.lit(0.0), not_applicable(), {}
    known = {a: F.coalesce(F.col(f"a_{a}"), F.lit(price)) for a in ASPECTS}
    for c in CATEGORIES:
        own = weights(c, absent)
        out[c] = sum((known[a] * w for a, w in own.items()), zero), sum(own.values(), zero)
    return out


def testability_cap(price: float) -> Column:
    """What testability may reach where there are no tests, or a hotspot has none; null where no cap holds."""
    untested = F.when(_c("test_files").isNull(), price <= 0.0).otherwise(_c("test_files") == 0)
    return F.when(untested, UNTESTED_CAP).when(F.coalesce(F.col("unpaired_hotspot"), F.lit(False)), UNPAIRED_CAP)


def category(name: str, value: Column, price: float) -> Column:
    """The displayed score of a category from its weighted mean, under the caps of testability."""
    return displayed(F.least(value, testability_cap(price)) if name == "testability" else value)


def _categories(price: float) -> dict[str, Column]:
    return {c: category(c, of / total, price) for c, (of, total) in partial_sums(price).items()}


def _overall(categories: dict[str, Column]) -> Column:
    return displayed(sum(categories.values(), F.lit(0.0)) / len(categories))


def readings() -> dict[str, Column]:
    """What the letters A+ and A are gated on; a reading that is missing is infinite and fails every ceiling."""
    rate = lambda count, of: F.when(_c(of) > 0, _c(count) / _c(of)).when(_c(of) == 0, F.when(_c(count).isNotNull(), 0.0))
    found = {"file_fail": rate("file_failures", "files"), "decl_fail": rate("declaration_failures", "declarations"), "file_warn": rate("file_warnings", "files"), "decl_warn": rate("declaration_warnings", "declarations"), "duplication": pressures()["duplication"], "risk": pressures()["risk_patterns"], "gates": _c("gate_failures")}
    return {k: F.coalesce(v, F.lit(float("inf"))) for k, v in found.items()}


def grade(score: Column) -> Column:
    """Letter of a score; A+ falls to A, and A to B, where a reading exceeds its ceiling."""
    def holds(level: int) -> Column:
        out = F.lit(True)
        for name, value in readings().items():
            out = out & (value <= CEILINGS[name][level])
        return out

    out = F.when(score.isNull(), None).when((score >= LETTERS[0][0]) & holds(0), "A+").when((score >= LETTERS[1][0]) & holds(1), "A")
    for floor, name in LETTERS[2:]:
        out = out.when(score >= floor, name)
    return out.otherwise("F")


def blockers(level: int = 1) -> Column:
    """The readings that exceed the ceiling of A+ (0) or A (1), in order of their names."""
    return F.array_sort(F.filter(F.array(*[F.when(v > CEILINGS[k][level], k) for k, v in readings().items()]), lambda x: x.isNotNull()))


def cap_reason() -> Column:
    """Why a card cannot have more than a B: "no tests", else the unmeasured aspects that apply, else null. Over a_<aspect> and the summary's columns."""
    absent = not_applicable()
    missing = F.array_sort(F.filter(F.array(*[F.when(F.col(f"a_{a}").isNull() & ~absent.get(a, F.lit(False)), a) for a in ASPECTS]), lambda x: x.isNotNull()))
    return F.when(_c("test_files") == 0, "no tests").when(F.size(missing) > 0, F.concat(F.lit("unmeasured: "), F.array_join(missing, ", ")))


def scorecard(summary: DataFrame) -> DataFrame:
    """``summary`` with a_<aspect>, c_<category>, overall, low, high, grade and blockers.

    The bounds price what is unknown at 0 and 5 in the same roll-up; the letter is that of the lower bound. No card
    without tests, or with an aspect that applies but nobody measured, gets more than a B; ``capped`` names why (no tests first).
    """
    own = summary.select("*", *[v.alias(f"a_{k}") for k, v in aspects().items()])
    # Bounds are columns before the letter reads them: each roll-up is one expression, not one for each comparison.
    point = own.select("*", *[v.alias(f"c_{k}") for k, v in _categories(UNKNOWN).items()])
    bounds = point.select("*", _overall({c: F.col(f"c_{c}") for c in CATEGORIES}).alias("overall"), _overall(_categories(0.0)).alias("low"), _overall(_categories(5.0)).alias("high"), cap_reason().alias("capped"))
    letter = bounds.withColumn("_letter", grade(F.col("low")))
    held = F.when(F.col("capped").isNotNull() & F.col("_letter").startswith("A"), "B").otherwise(F.col("_letter"))
    return letter.select(*point.columns, "overall", "low", "high", held.alias("grade"), "capped", blockers().alias("blockers"))


def widened(low: Column, high: Column, other: Column, spread: Column, single: Column) -> tuple[Column, Column]:
    """Bounds that also hold another source's score, half the mean spread of sources, and 0.1 for a concept of a single source."""
    more = F.coalesce(spread, F.lit(0.0)) * 0.5 + F.when(single, 0.1).otherwise(0.0)
    return displayed(F.least(low, F.coalesce(other, low)) - more), displayed(F.greatest(high, F.coalesce(other, high)) + more)


def pillars(cards: DataFrame, practice: Column) -> DataFrame:
    """For each pillar the mean of its measured aspects (two decimals) and a posture by score (3.5) and practice level (3)."""
    def mean(names: list[str]) -> Column:
        known = F.filter(F.array(*[F.col(f"a_{a}") for a in names]), lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known) + HALF, 2))

    def posture(score: Column) -> Column:
        good, ready = score >= 3.5, practice >= 3
        return F.when(score.isNull(), "unmeasured").when(good & ready, "sustained").when(good, "unguarded").when(ready, "recovering").otherwise("exposed")

    out = cards
    for name, own in PILLARS.items():
        out = out.withColumn(f"p_{name}", mean(own)).withColumn(f"posture_{name}", posture(F.col(f"p_{name}")))
    return out


def thin_populations() -> Column:
    """Names of the populations under their floor, for which a score says little."""
    return F.array_sort(F.filter(F.array(*[F.when(F.coalesce(_c(k), F.lit(0.0)) < v, k) for k, v in FLOORS.items()]), lambda x: x.isNotNull()))


def economics(changes: Column, rate: Column, hours: tuple[float, ...] = (0.25, 1.0, 2.0), months: int = 12) -> dict[str, Column]:
    """What extra hours a change cost over a horizon, for a low, a base and a high guess."""
    return {name: F.round(changes * h * rate * months / 12 + HALF, 2) for name, h in zip(("low", "base", "high"), hours)}
