"""The whole work order: items of every kind of finding, and what the score gains by clearing one of a class, or all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scorecard
from .reports import BANDS, band
from .scoring import CATEGORIES, UNKNOWN

# Class, risk and effort (1 to 5), the counter of the summary that a cleared finding lowers, and the aspect that reads it
# (none where the pressure is that of recorded bands, or nothing of the score counts the finding).
CLASSES = [
    ("oversized-declaration", 4, 2, "declaration_failures", None),
    ("oversized-file", 3, 3, "file_failures", None),
    ("duplicate-block", 4, 4, "duplicate_blocks", "duplication"),
    ("near-duplicate", 3, 4, "near_duplicates", "near_duplication"),
    ("dead-code", 2, 1, "dead_declarations", "dead_code"),
    ("unpaired-hotspot", 4, 2, None, None),
    ("risk-pattern", 5, 1, "risk_findings", "risk_patterns"),
    ("competing-libraries", 2, 4, "divergent_concerns", "idiom_consistency"),
    ("semantic-universal", 4, 2, None, None),
    ("semantic-policy", 4, 3, None, None),
]
ITEM = ["class", "path", "line", "label", "severity", "sites"]


def _item(rows: DataFrame, cls: str, path, line, label, severity, *keep: str, sites: Column | None = None) -> DataFrame:
    """Items of one class in the common shape; findings that name no place are no work."""
    none = F.lit(None).cast("array<string>")
    out = rows.select(*keep, F.lit(cls).alias("class"), path.alias("path"), line.cast("long").alias("line"), label.alias("label"), severity.cast("double").alias("severity"), (none if sites is None else sites).alias("sites"))
    return out.filter(F.coalesce("path", F.lit("")) != "")


def _place(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def of_declarations(failing: DataFrame, *keep: str) -> DataFrame:
    """Declarations (path, name, start, lines, cyclomatic) past a limit: severity is lines and four times the complexity."""
    return _item(failing, "oversized-declaration", F.col("path"), F.col("start"), F.col("name"), F.col("lines") + 4 * F.col("cyclomatic"), *keep)


def of_files(failing: DataFrame, *keep: str) -> DataFrame:
    """Files (path, lines) past a limit."""
    return _item(failing, "oversized-file", F.col("path"), F.lit(None), F.col("path"), F.col("lines"), *keep)


def of_clones(blocks: DataFrame, *keep: str) -> DataFrame:
    """Duplicated blocks (path, line, lines, locations array<string>): the first place with all of them."""
    several = F.when(F.size("locations") > 1, F.col("locations"))
    return _item(blocks, "duplicate-block", F.col("path"), F.col("line"), F.lit("duplicated block"), F.coalesce("lines", F.lit(1)), *keep, sites=several)


def of_similar(pairs: DataFrame, *keep: str) -> DataFrame:
    """Similar bodies (left and right: path, start, name; similarity): the left one with both places."""
    both = F.array(_place(F.col("left.path"), F.col("left.start")), _place(F.col("right.path"), F.col("right.start")))
    return _item(pairs, "near-duplicate", F.col("left.path"), F.col("left.start"), F.concat(F.col("left.name"), F.lit(" is like "), F.col("right.name")), F.col("similarity"), *keep, sites=both)


def of_unused(rows: DataFrame, *keep: str) -> DataFrame:
    """Declarations (path, name, start, lines) that nothing refers to."""
    return _item(rows, "dead-code", F.col("path"), F.col("start"), F.col("name"), F.coalesce("lines", F.lit(1)), *keep)


def of_risks(rows: DataFrame, *keep: str) -> DataFrame:
    """Lines (path, line, rule) that a rule matches."""
    return _item(rows, "risk-pattern", F.col("path"), F.col("line"), F.col("rule"), F.lit(1), *keep)


def of_unpaired(rows: DataFrame, *keep: str) -> DataFrame:
    """Failing units (path, line, name, lines) without a paired test."""
    return _item(rows, "unpaired-hotspot", F.col("path"), F.col("line"), F.coalesce("name", "path"), F.coalesce("lines", F.lit(1)), *keep)


def of_idioms(rows: DataFrame, *keep: str) -> DataFrame:
    """Concerns (concern, package, files, example; a row a package): one item for each that several packages serve, at the least used package's example."""
    order = F.struct("files", "package")
    per = rows.groupBy(*keep, "concern").agg(F.count("*").alias("n"), F.min_by("example", order).alias("example"), F.max_by("package", order).alias("most"))
    return _item(per.filter("n > 1"), "competing-libraries", F.col("example"), F.lit(None), F.concat(F.col("concern"), F.lit(": converge on "), F.col("most")), F.col("n"), *keep)


def of_semantic(rows: DataFrame, *keep: str) -> DataFrame:
    """Facts (kind universal or policy, path, line, rule, message) that a type checker proved; other kinds are no work."""
    kinds = [_item(rows.filter(F.col("kind") == k), f"semantic-{k}", F.col("path"), F.col("line"), F.coalesce("message", "rule"), F.lit(1), *keep) for k in ("universal", "policy")]
    return kinds[0].unionByName(kinds[1])


def together(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def worths(items: DataFrame, cards: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, class_count, risk, effort, band, delta, class_delta) for the classes that have items.

    ``cards``: ``scorecard`` rows, one a project. ``delta`` is what the overall score gains if one finding of the class is
    cleared, ``class_delta`` if all of its items are; 0 where nothing of the score reads the class, or the score does
    not rise. Nothing is scored again: the partial sums of the categories are moved by the weights of the one aspect
    that changes. Equal to re-scoring the changed summary.
    """
    spark = items.sparkSession
    table = spark.createDataFrame([c[:3] for c in CLASSES], "class string, risk int, effort int")
    counts = items.groupBy(*by, "class").agg(F.count("*").alias("class_count"))
    sums = scorecard.partial_sums(UNKNOWN)
    own = cards.select("*", *[v[k].alias(f"_{n}_{c}") for c, v in sums.items() for k, n in enumerate(("of", "total"))])
    rows = counts.join(F.broadcast(table), "class").join(own, by)

    counted = [c for c in CLASSES if c[4]]

    def by_class(of) -> Column:
        out = F.lit(0.0)
        for cls, _, _, counter, aspect in counted:
            out = F.when(F.col("class") == cls, of(counter, aspect)).otherwise(out)
        return out

    own_weights = {c: scorecard.weights(c) for c in CATEGORIES}
    rows = rows.withColumns({f"_w_{c}": by_class(lambda _, a, w=w: w.get(a, F.lit(0.0))) for c, w in own_weights.items()})
    for name, amount in (("_one", F.lit(1.0)), ("_all", F.col("class_count").cast("double"))):

        def moved(counter: str, aspect: str, amount=amount) -> Column:
            fewer = scorecard.ASPECTS[aspect](lambda n: _fewer(n, amount) if n == counter else scorecard._c(n))
            return F.when(F.col(counter).isNotNull(), F.coalesce(fewer, F.lit(UNKNOWN)) - F.coalesce(F.col(f"a_{aspect}"), F.lit(UNKNOWN)))

        rows = rows.withColumn(name, F.coalesce(by_class(moved), F.lit(0.0)))
        rows = rows.withColumns({f"{name}_{c}": scorecard.category(c, (F.col(f"_of_{c}") + F.col(f"_w_{c}") * F.col(name)) / F.col(f"_total_{c}"), UNKNOWN) for c in CATEGORIES})
    gain = lambda name: F.round(F.greatest(F.lit(0.0), scorecard._overall({c: F.col(f"{name}_{c}") for c in CATEGORIES}) - F.col("overall")), 3)
    return rows.select(*by, "class", "class_count", "risk", "effort", band(F.col("risk"), F.col("effort")).alias("band"), gain("_one").alias("delta"), gain("_all").alias("class_delta"))


def _fewer(counter: str, amount: Column) -> Column:
    """A counter that is lower by an amount, 0 at least; null stays null."""
    return F.when(F.col(counter).isNotNull(), F.greatest(F.lit(0.0), scorecard._c(counter) - amount))


def work_order(items: DataFrame, cards: DataFrame, by: list[str], hide: tuple[str, ...] = ("reconsider",)) -> DataFrame:
    """``items`` with band, delta, class_delta, class_count, worth and place.

    ``place`` orders a project's items by band, worth of the class, severity and path; ``worth`` is the class's worth at the first
    of its items and null at the others, so that no one adds it up. Items of equal order are told apart by line and label.
    """
    rows = items.join(worths(items, cards, by), [*by, "class"]).filter(~F.col("band").isin(*hide))
    rank = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    order = [rank, F.desc("class_delta"), F.desc("severity"), F.col("path"), F.col("class"), F.asc_nulls_first("line"), F.col("label")]
    first = F.row_number().over(Window.partitionBy(*by, "class").orderBy(*order)) == 1
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("worth", F.when(first & (F.col("class_delta") > 0), F.col("class_delta")))


def combined(items: DataFrame, cards: DataFrame, by: list[str]) -> DataFrame:
    """(by, gain): what clearing all items of a project together is worth; never the sum of the classes' worths, as aspects share categories."""
    counted = [c for c in CLASSES if c[4]]
    cleared = items.groupBy(*by).agg(*[F.count_if(F.col("class") == c[0]).alias(f"_n_{c[3]}") for c in counted])
    own = cards.join(cleared, by)
    lower = {c[3]: _fewer(c[3], F.col(f"_n_{c[3]}")) for c in counted}
    changed = scorecard.aspects(lambda name: lower.get(name, scorecard._c(name)))
    after = own.select(*by, F.col("overall").alias("_before"), "test_files", "unpaired_hotspot", "coverage_percent", "settled_files", "files_changed", *[changed[a].alias(f"a_{a}") for a in changed])
    return after.select(*by, F.round(F.greatest(F.lit(0.0), scorecard._overall(scorecard._categories(UNKNOWN)) - F.col("_before")), 3).alias("gain"))
