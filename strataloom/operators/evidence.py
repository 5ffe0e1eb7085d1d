"""What was covered, agreed on, overlaid, withheld or broken: set operations on tables of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covered_by_all(df: DataFrame, group: str, item: str) -> DataFrame:
    """(item): what every group has. Relational division by counts, with no set held in a row."""
    total = df.agg(F.count_distinct(group).alias("_all"))
    return df.groupBy(item).agg(F.count_distinct(group).alias("_n")).join(total, F.col("_n") == F.col("_all")).select(item)


def missing_from(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, missing): how many of all items each group lacks."""
    total = df.agg(F.count_distinct(item).alias("_all"))
    return df.groupBy(group).agg(F.count_distinct(item).alias("_n")).join(F.broadcast(total)).select(group, (F.col("_all") - F.col("_n")).alias("missing"))  # one row


def unresolved(references: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are referred to and defined nowhere; null keys refer to nothing."""
    return references.select(key).filter(F.col(key).isNotNull()).distinct().join(definitions.select(key), key, "left_anti")


def unread(df: DataFrame, read: DataFrame, key: str, by: str) -> DataFrame:
    """(by, unread) of the rows of ``df`` whose key is not in ``read``, the most frequent first."""
    return df.join(read.select(key), key, "left_anti").groupBy(by).agg(F.count("*").alias("unread")).orderBy(F.desc("unread"), by)


def last_write(df: DataFrame, unit: str, concept: str, value: str, seq: str, concepts: list[str]) -> DataFrame:
    """One row per unit and one column per concept: the value of the highest ``seq``; null where none was measured."""
    def last(name: str) -> Column:
        own = F.col(concept) == name
        return F.max_by(F.when(own, F.col(value)), F.when(own, F.col(seq))).alias(name)

    return df.groupBy(unit).agg(*[last(name) for name in concepts])


def refused(df: DataFrame, group: str, concept: str, concepts: list[str]) -> DataFrame:
    """(group): groups that lack one of the concepts altogether, for which no pressure may be given."""
    found = F.count_distinct(F.when(F.col(concept).isin(concepts), F.col(concept)))
    return df.groupBy(group).agg(found.alias("_n")).filter(F.col("_n") < len(concepts)).select(group)


def fix_breadth(commits: DataFrame, group: str, order: list[Column], is_fix: Column, files: str, last: int = 300, broad: int = 5, least: int = 5) -> DataFrame:
    """(group, fixes, median_files, broad_share) of the fixes among the last commits of each group; groups with fewer than ``least`` go.

    The rank filter is pushed below the shuffle, so a group sends ``last`` rows from each task at most.
    """
    ranked = commits.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rank") <= last)
    out = ranked.filter(is_fix).groupBy(group).agg(F.count("*").alias("fixes"), F.median(files).alias("median_files"), F.round(F.avg((F.col(files) > broad).cast("double")) + 1e-9, 6).alias("broad_share"))
    return out.filter(F.col("fixes") >= least)


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """(by, compared, agreed, rate) of two measurers' values of the same units; ``by`` is a column of ``a``."""
    both = a.join(b.select(*keys, F.col(value).alias("_other")), keys)
    out = both.groupBy(by).agg(F.count("*").alias("compared"), F.count_if(F.col(value) == F.col("_other")).alias("agreed"))
    return out.withColumn("rate", F.round(F.col("agreed") / F.col("compared") + 1e-9, 6))


def histogram(df: DataFrame, value: str, floors: dict[str, float]) -> DataFrame:
    """(severity, n): each row counts for the highest floor that it reaches; rows below all count as ``none``."""
    severity = F.lit("none")
    for name, floor in sorted(floors.items(), key=lambda x: x[1]):
        severity = F.when(F.col(value) >= floor, F.lit(name)).otherwise(severity)
    return df.groupBy(severity.alias("severity")).agg(F.count("*").alias("n"))


def mixed_versions(df: DataFrame, tool: str, version: str) -> DataFrame:
    """(tool, versions): tools seen in more than one version, whose rows don't compare."""
    return df.groupBy(tool).agg(F.count_distinct(version).alias("versions")).filter("versions > 1")


def concerns(imports: DataFrame, dimension: DataFrame, own: DataFrame, unit: str, package: str, concern: str) -> DataFrame:
    """(unit, concern, packages): the concerns that a unit's imports stand for, its own packages left out."""
    return imports.select(unit, package).join(own.select(package), package, "left_anti").join(dimension.select(package, concern), package).groupBy(unit, concern).agg(F.count_distinct(package).alias("packages"))


def runnable(tools: DataFrame, inventory: DataFrame, tool: str, languages: str, language: str, files: str) -> DataFrame:
    """(tool, files, reason): files each tool could read, matched by an equi-join on the languages it names."""
    wanted = tools.select(tool, F.explode_outer(F.array_distinct(languages)).alias(language))
    out = wanted.join(inventory.groupBy(language).agg(F.sum(files).alias("_n")), language, "left").groupBy(tool).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("files"))
    return out.withColumn("reason", F.when(F.col("files") > 0, F.lit("runs")).otherwise(F.lit("no file in its languages")))


def broken(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule): one row for each rule that a row meets. The rules are columns of one projection: no join with them."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))).alias("rule"))


def overlay(built_in: DataFrame, external: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, origin): the external value where there is one, else the built-in one."""
    both = built_in.select(*keys, F.col(value).alias("_own")).join(external.select(*keys, F.col(value).alias("_ext")), keys, "full")
    return both.select(*keys, F.coalesce("_ext", "_own").alias(value), F.when(F.col("_ext").isNotNull(), F.lit("external")).otherwise(F.lit("built-in")).alias("origin"))


def select_items(df: DataFrame, prefix_axes: tuple[str, ...] = ("path",), **axes) -> DataFrame:
    """Rows that equal the given value on every axis, or start with it on a prefix axis; an unknown axis raises."""
    if unknown := sorted(set(axes) - set(df.columns)):
        raise ValueError(f"unknown axis: {', '.join(unknown)}")
    tests = [F.col(k).startswith(v) if k in prefix_axes else F.col(k) == v for k, v in axes.items()]
    return df.filter(reduce(lambda x, y: x & y, tests, F.lit(True)))


def limits(df: DataFrame, keys: list[str], most: dict[str, float], touched: Column | None = None) -> DataFrame:
    """(keys, criterion, value, remaining): each criterion's budget left; below 0 where it is broken. ``touched`` limits the rows."""
    if touched is not None:
        df = df.filter(touched)
    rows = F.array(*[F.struct(F.lit(name).alias("criterion"), F.col(name).cast("double").alias("value"), (F.lit(float(m)) - F.col(name)).alias("remaining")) for name, m in most.items()])
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*").filter("value is not null")


def fingerprints(df: DataFrame, kind: str, path: str, name: str, line: str) -> DataFrame:
    """``df`` with ``fingerprint``, ``kind:path:name#ordinal``: a line that moves keeps it; the ordinal tells namesakes of a file apart."""
    ordinal = F.row_number().over(Window.partitionBy(kind, path, name).orderBy(line))
    return df.withColumn("fingerprint", F.concat(F.concat_ws(":", kind, path, name), F.lit("#"), ordinal))


def blanked(df: DataFrame, population: str, floors: dict[str, float]) -> DataFrame:
    """``df`` with each aspect null where its population is below the aspect's floor: too little to tell, which is not zero."""
    return df.withColumns({name: F.when(F.col(population) >= floor, F.col(name)) for name, floor in floors.items()})


def states(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, state): measured, zero or missing, for each of the fields."""
    def state(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.lit("missing")).when(F.col(name) == 0, F.lit("zero")).otherwise(F.lit("measured"))

    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), state(n).alias("state")) for n in fields])).alias("_s")).select(*keys, "_s.*")


def pressure(band: Column, withheld: Column, failed: Column, warned: Column, population: Column, severe: float = 1.0, warning: float = 0.3) -> Column:
    """The band's pressure where it is known; ``severe`` where it is withheld though there is a population; else failures and, at less weight, warnings per unit."""
    return F.when(band.isNotNull(), band).when(withheld & (population > 0), F.lit(severe)).when(population > 0, (failed + F.lit(warning) * warned) / population)


def capped(letter: Column, cap: Column, best: str = "B") -> Column:
    """``letter``, yet no better than ``best`` where ``cap`` holds; a missing letter stays missing."""
    return F.when(cap & ((letter < best) | letter.startswith("A")), F.lit(best)).otherwise(letter)


def sufficiency(df: DataFrame, unread_share: Column, gaps: dict[str, Column], most: float = 0.2) -> DataFrame:
    """``df`` with ``sufficiency`` and ``reasons``: insufficient from ``most`` unread on, incomplete with any gap, reasons in the given order."""
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in gaps.items()]))
    state = F.when(unread_share >= most, "insufficient").when(F.size("reasons") > 0, "incomplete").otherwise("complete")
    return df.withColumn("reasons", reasons).withColumn("sufficiency", state)


def withheld(items: DataFrame, escalated: DataFrame, key: str, is_major: Column) -> DataFrame:
    """``items`` with ``reason``: why an item is not handed on; null for those that are."""
    marks = escalated.select(key).distinct().withColumn("_escalated", F.lit(True))
    return items.join(marks, key, "left").withColumn("reason", F.when(is_major, "major").when(F.col("_escalated"), "escalated")).drop("_escalated")


def asset_directories(files: DataFrame, directory: str, suffix: str, markup: list[str], code: list[str], least: int = 2) -> DataFrame:
    """(directory) with at least ``least`` markup files, more of them than code files, and files of other suffixes beside."""
    n, m = F.count_if(F.col(suffix).isin(markup)), F.count_if(F.col(suffix).isin(code))
    out = files.groupBy(directory).agg(n.alias("_markup"), m.alias("_code"), F.count("*").alias("_all"))
    return out.filter((F.col("_markup") >= least) & (F.col("_markup") > F.col("_code")) & (F.col("_all") > F.col("_markup") + F.col("_code"))).select(directory)
