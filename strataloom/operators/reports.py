"""Ordered lists with what stood behind their cut, work items and what they are joined to, tails and tracks of scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged, unstaged
from . import series, stats


def top(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows in an order, ``place`` from 1 on, and ``n_total``, how many there were. No task holds more than its own first ``most``."""
    total = rows.agg(F.count("*").alias("n_total"))
    first = rows.orderBy(*order).limit(most)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of ``most`` rows
    return placed.join(F.broadcast(total))


def largest_files(files: DataFrame, most: int = 25) -> DataFrame:
    """By lines; ties by the parts of the path."""
    return top(files, [F.desc("lines"), F.split("path", "/")], most)


def coupled(pairs: DataFrame, most: int = 25) -> DataFrame:
    """By joint changes, then confidence, then the pair as it is written in a list."""
    written = F.concat(F.lit("['"), "a", F.lit("', '"), "b", F.lit("']"))
    return top(pairs, [F.desc("co_changes"), F.desc("confidence"), written], most)


def clone_list(places: DataFrame, most: int = 25, locations: int = 10) -> DataFrame:
    """(block, n, lines, locations) of clones by number of places and lines; the first ``locations`` places of each.

    ``places``: (block, path, start, lines). A rank with a limit, so a block sends so many places from each task at most.
    """
    counts = places.groupBy("block").agg(F.count("*").alias("n"), F.max("lines").alias("lines"))
    best = top(counts, [F.desc("n"), F.desc("lines"), F.col("block")], most)
    rank = F.row_number().over(Window.partitionBy("block").orderBy("path", "start"))
    few = places.join(F.broadcast(best.select("block")), "block").withColumn("_r", rank).filter(F.col("_r") <= locations)
    at = few.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("path", "start"))).alias("locations"))
    return best.join(at, "block")


def rule_findings(found: DataFrame, rules: list[str], most: int = 100) -> DataFrame:
    """Findings in the order of the rules, then of files and lines."""
    return top(found, [F.array_position(F.array(*map(F.lit, rules)), F.col("rule")), F.col("path"), F.col("line")], most)


def worst_dimension(pressures: DataFrame, by: str) -> DataFrame:
    """The dimension of the highest normalised pressure of each group, if that is over 1."""
    worst = pressures.groupBy(by).agg(F.max(F.struct("pressure", "dimension")).alias("w")).filter("w.pressure > 1.0")
    return worst.select(by, "w.dimension", "w.pressure")


def normalised(pressure: Column, reference: Column) -> Column:
    """In units of the corpus's median; null where there is no such median."""
    return F.when(reference > 0, pressure / reference)


def findings_order() -> list[Column]:
    return [F.col("path"), F.col("line"), F.coalesce("rule", "message"), F.col("tool"), F.col("message")]


BANDS = ["quick-win", "major-project", "fill-in", "reconsider"]


def band(risk: Column, effort: Column, high: int = 3) -> Column:
    return F.when((risk >= high) & (effort < high), "quick-win").when((risk >= high) & (effort >= high), "major-project").when(effort < high, "fill-in").otherwise("reconsider")


def items_of_declarations(rows: DataFrame) -> DataFrame:
    """(class, path, label, severity) of declarations: lines and four times the complexity."""
    return rows.select(F.lit("oversized-declaration").alias("class"), "path", F.col("name").alias("label"), (F.col("lines") + 4 * F.col("cyclomatic")).cast("double").alias("severity"))


def items_of_files(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("oversized-file").alias("class"), "path", F.col("path").alias("label"), F.col("lines").cast("double").alias("severity"))


def items_of_findings(rows: DataFrame, cls: str) -> DataFrame:
    return rows.select(F.lit(cls).alias("class"), "path", F.col("message").alias("label"), F.lit(1.0).alias("severity"), "line")


def all_items(*parts: DataFrame) -> DataFrame:
    """Items of every kind under each other; a column that a kind lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def work_order(items: DataFrame, prices: DataFrame, hide: tuple[str, ...] = ("reconsider",)) -> DataFrame:
    """Items with band, class_worth and place: by band, worth of the class, severity, path. The worth of a class stands at its first item alone.

    ``prices``: (class, risk, effort, worth), a row for each class.
    """
    rows = items.join(F.broadcast(prices), "class").withColumn("band", band(F.col("risk"), F.col("effort"))).filter(~F.col("band").isin(*hide))
    rank = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    inside = Window.partitionBy("class").orderBy(F.desc("severity"), "path", "label")
    return rows.withColumn("band_rank", rank).withColumn("class_worth", F.when(F.row_number().over(inside) == 1, F.col("worth"))).drop("risk", "effort")


def exposed(items: DataFrame, hotspots: DataFrame, returns: DataFrame, most: int = 25) -> DataFrame:
    """``items`` with exposure: ten for each return of its finding, one for each commit of its path, if that is on the list of ``most`` hotspots."""
    churn = hotspots.orderBy(F.desc("score"), "path").limit(most).select("path", F.col("commits").alias("_commits"))
    out = items.join(F.broadcast(churn), "path", "left").join(returns.select("fingerprint", F.col("returned").alias("_returned")), "fingerprint", "left")
    return out.withColumn("exposure", 10 * F.coalesce("_returned", F.lit(0)) + F.coalesce("_commits", F.lit(0))).drop("_commits", "_returned")


def policy_breaks(boundaries: DataFrame, policy: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, path, line, actual, required): places where a value of one type goes where the policy asks for another.

    ``policy``: (rule, pattern of the actual type, pattern of the required type); it is a list, so the join is a row for each rule.
    """
    table = boundaries.sparkSession.createDataFrame(policy, "rule string, a string, r string")
    both = boundaries.join(F.broadcast(table), F.rlike("actual", F.col("a")) & F.rlike("required", F.col("r")) & (F.col("actual") != F.col("required")))
    return both.select("rule", "path", "line", "actual", "required")


def unknown_paths(findings: DataFrame, tree: DataFrame) -> DataFrame:
    """Paths that findings name and the tree doesn't hold; empty and null ones name nothing."""
    return findings.filter("path is not null and path != ''").select("path").distinct().join(tree.select("path"), "path", "left_anti")


def ours(rows: DataFrame, inventory: DataFrame, told: DataFrame) -> DataFrame:
    """Readings of our own files; readings of the whole tree only of tools that were told the trees. ``told``: (tool)."""
    own = rows.filter("unit != '<tree>'").join(inventory.select("path"), "path", "left_semi")
    return own.unionByName(rows.filter("unit = '<tree>'").join(F.broadcast(told.select("tool").distinct()), "tool", "left_semi"), allowMissingColumns=True)


def changed_state(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, hash) that stand in one of two states of files alone."""
    return before.select("path", "hash").exceptAll(after.select("path", "hash")).union(after.select("path", "hash").exceptAll(before.select("path", "hash")))


def remedies(coverage: DataFrame, table: DataFrame) -> DataFrame:
    """(tool, outcome, remedy) for the tools that gave nothing."""
    return coverage.filter("outcome != 'contributed'").join(F.broadcast(table), ["tool", "outcome"], "left").select("tool", "outcome", F.coalesce("remedy", F.lit("see the tool's log")).alias("remedy"))


def inventory_counts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(provenance, n) and, of our own files, (language, n)."""
    return files.groupBy("provenance").agg(F.count("*").alias("n")), files.filter("provenance in ('first-party', 'test')").groupBy("language").agg(F.count("*").alias("n"))


def tail(scans: DataFrame, by: list[str], order: list[str], value: str, key: list[str]) -> DataFrame:
    """(by, n, first, last, direction) of the latest segment of each series."""
    cut = series.segments(scans, by, order, key)
    last = cut.groupBy(*by).agg(F.max("segment").alias("segment"))
    ends = cut.join(last, [*by, "segment"]).groupBy(*by).agg(F.count("*").alias("n"), F.min_by(value, F.struct(*order)).alias("first"), F.max_by(value, F.struct(*order)).alias("last"))
    return ends.withColumn("direction", F.when(F.col("n") < 2, "none").when(F.col("last") > F.col("first"), "up").when(F.col("last") < F.col("first"), "down").otherwise("flat"))


def trend_report(scans: DataFrame, by: list[str], order: list[str], key: list[str], value: str, found: str) -> DataFrame:
    """One row a segment: scans, first and last value, what was introduced and cleared."""
    cut = series.segments(scans, by, order, key)
    ends = cut.groupBy(*by, "segment").agg(F.min_by(value, F.struct(*order)).alias("first"), F.max_by(value, F.struct(*order)).alias("last"))
    return ends.join(series.velocity(cut, [*by, "segment"], order, found), [*by, "segment"])


def size_band(rows: DataFrame, group: str, size: str) -> DataFrame:
    """The rows whose size both groups (1 and 0) reach."""
    ends = rows.groupBy(group).agg(F.min(size).alias("lo"), F.max(size).alias("hi")).agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi"), F.count("*").alias("_n"))
    return rows.join(F.broadcast(ends)).filter((F.col("_n") == 2) & F.col(size).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_n")


#: What a finding and a track must have in common, from the strongest evidence on.
TRACK_TIERS = (("fingerprint",), ("rule", "path", "line"), ("rule", "path"))


def tracks(findings: DataFrame, by: str, tiers: tuple[tuple[str, ...], ...] = TRACK_TIERS) -> DataFrame:
    """(by, scan, track, fingerprint): findings of consecutive scans followed as tracks, each matched against every track that was ever seen.

    ``findings``: (by, scan, fingerprint, rule, path, line). The first scans of all series are matched at once, then the second
    ones, and so on; a track is as its last finding was. Tier by tier, of the findings and tracks that are left and have
    equal keys without nulls, the n-th of one side takes the n-th of the other, in the order of lines and fingerprints (nulls first). What takes
    none begins a track; tracks are numbered from 0 on in each series, those of a scan by path, line, fingerprint and rule. Repeated rows are
    findings of their own; rows without a scan are left out; a null series is one of its own; no rows give none.

    Every step is joins and windows on keys of a file, of which no side goes to all tasks by way of the driver; what a scan leaves is written, so a lost executor costs one step.
    """
    kept = ["fingerprint", "rule", "path", "line"]
    rows = findings.filter("scan is not null").select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("_by"), F.col("scan").cast("long").alias("scan"), "fingerprint", "rule", "path", F.col("line").cast("long").alias("line"))
    place = rows.select("_by", "scan").distinct().withColumn("no", F.row_number().over(Window.partitionBy("_by").orderBy("scan")))  # a row for each scan
    # Rows of a scan lie together, so that each step reads its own.
    held = staged(rows.join(place, ["_by", "scan"]).repartitionByRange("no", "_by", "path").sortWithinPartitions("no"), "findings")
    state = staged(held.limit(0).select("_by", F.lit(0).cast("long").alias("track"), *kept), "tracks")
    out = [held.limit(0).select("_by", "scan", F.lit(0).cast("long").alias("track"), "fingerprint")]

    def pairs(here: DataFrame, free: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        w = Window.partitionBy("_by", *keys)
        a = here.filter(present).withColumn("_n", F.row_number().over(w.orderBy("line", "fingerprint", "id"))).select("_by", *keys, "_n", "id")
        b = free.filter(present).withColumn("_n", F.row_number().over(w.orderBy("line", "fingerprint", "track"))).select("_by", *keys, "_n", "track")
        return a.join(b.hint("merge"), ["_by", *keys, "_n"]).select("_by", "id", "track")

    for no in range(1, (place.agg(F.max("no")).first()[0] or 0) + 1):
        ordered = stats.numbered(held.filter(F.col("no") == no).select("_by", "scan", *kept, F.struct("_by", "path", "line", "fingerprint", "rule").alias("_order")), "_order", "id").drop("_order")
        here = staged(ordered, "here")
        left, free, taken = here, state, None
        for keys in tiers:
            hit = staged(pairs(left, free, keys), "taken")
            left, free = left.join(hit.hint("merge"), ["_by", "id"], "left_anti"), free.join(hit.hint("merge"), ["_by", "track"], "left_anti")
            taken = hit if taken is None else taken.unionByName(hit)
        begun = left.select("_by", "id", F.struct("_by", "id").alias("_order"))
        begun = stats.numbered(begun, "_order", "_g")
        first = begun.groupBy("_by").agg(F.min("_g").alias("_first"))
        size = state.groupBy("_by").agg(F.count("*").alias("_size"))
        fresh = begun.join(first, "_by").join(size, "_by", "left").select("_by", "id", (F.coalesce("_size", F.lit(0)) + F.col("_g") - F.col("_first")).alias("track"))
        now = staged(here.join(taken.unionByName(fresh).hint("merge"), ["_by", "id"]).select("_by", "scan", "track", *kept), "now")
        ahead = staged(state.join(now.hint("merge"), ["_by", "track"], "left_anti").unionByName(now.drop("scan")), "tracks")
        for x in (state, here):
            unstaged(x)
        state = ahead
        out.append(now.select("_by", "scan", "track", "fingerprint"))
    whole = reduce(DataFrame.unionByName, out)
    return whole.select(F.when(F.col("_by") != "", F.expr("substring(_by, 2)")).alias("by"), "scan", "track", "fingerprint")


def escalations(followed: DataFrame, least: int = 2) -> DataFrame:
    """(by, track, returned): tracks that went and came back ``least`` times. ``followed``: ``tracks``."""
    scans = followed.select("by", "scan").distinct()
    found = series.recurrence(followed.select("by", "scan", "track").distinct(), scans, ["by"], "scan", "track")
    return found.filter(F.col("returned") >= least).select("by", "track", "returned")


def targeted(asked: DataFrame, followed: DataFrame) -> DataFrame:
    """(by, track, outcome) of the tracks a prompt named in a scan: cleared, never-cleared, cleared-then-returned."""
    later = asked.join(followed.select("by", F.col("scan").alias("seen"), "track").distinct(), ["by", "track"]).filter("seen > scan")
    after = followed.select("by", F.col("scan").alias("s")).distinct().join(asked, "by").filter("s > scan").groupBy("by", "track").agg(F.count_distinct("s").alias("scans"))
    runs = later.groupBy("by", "track").agg(F.count_distinct("seen").alias("stood"), F.max("seen").alias("last"))
    ends = followed.groupBy("by").agg(F.max("scan").alias("_end"))
    both = after.join(runs, ["by", "track"], "left").join(ends, "by")
    gone = F.coalesce("stood", F.lit(0)) < F.col("scans")
    return both.select("by", "track", F.when(~gone, "never-cleared").when(F.coalesce(F.col("last") == F.col("_end"), F.lit(False)), "cleared-then-returned").otherwise("cleared").alias("outcome"))
