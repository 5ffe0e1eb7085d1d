"""Readers of metric and ratio reports, compiler output, configurations, snapshots and tables; each takes (file, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.text import split_lines


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the files at a path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def lines_of(reports: DataFrame) -> DataFrame:
    """(file, no, line) of reports, from 1 on."""
    return reports.select("file", F.posexplode(split_lines(F.col("text"))).alias("no", "line")).withColumn("no", F.col("no") + 1)


def csv_metrics(reports: DataFrame) -> DataFrame:
    """(file, path, unit, metric, value): three measurements a row of a function table (lines in column 1, complexity 2, tokens 3, parameters 4, path 7, name 8)."""
    fields = F.from_csv("line", F.lit("a double, b double, c double, d double, e double, place string, path string, name string, f string, first bigint, last bigint"))
    rows = lines_of(reports).filter("trim(line) != ''").select("file", fields.alias("x")).filter("x.a is not null")
    return rows.select("file", "x.path", F.col("x.name").alias("unit"), F.expr("stack(3, 'lines', x.a, 'complexity', x.b, 'parameters', x.d) as (metric, value)"))


def map_metrics(reports: DataFrame, field: str, metric: str) -> DataFrame:
    """(path, metric, value) of a JSON object by path whose values hold a number under ``field``."""
    entries = reports.select(F.explode(F.map_entries(F.from_json("text", f"map<string, struct<{field}: double>>"))).alias("e"))
    return entries.select(F.col("e.key").alias("path"), F.lit(metric).alias("metric"), F.col("e.value")[field].alias("value")).filter("value is not null")


def list_metrics(reports: DataFrame, items: str, path: str, value: str, metric: str) -> DataFrame:
    """(path, metric, value) of a JSON array of objects."""
    rows = reports.select(F.explode(F.from_json(F.get_json_object("text", "$" + ("." + items if items else "")), "array<string>")).alias("i"))
    return rows.select(F.get_json_object("i", f"$.{path}").alias("path"), F.lit(metric).alias("metric"), F.get_json_object("i", f"$.{value}").try_cast("double").alias("value"))


def sectioned_metrics(reports: DataFrame, header: str, row: str, metric: str) -> DataFrame:
    """(path, unit, metric, value) of a text report whose header lines name a file for the rows below; patterns with one and two groups."""
    lines = lines_of(reports).withColumn("path", F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1)))
    filled = lines.withColumn("path", F.last("path", ignorenulls=True).over(Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)))
    return filled.filter(F.col("line").rlike(row) & F.col("path").isNotNull()).select("path", F.regexp_extract("line", row, 1).alias("unit"), F.lit(metric).alias("metric"), F.regexp_extract("line", row, 2).try_cast("double").alias("value"))


def tree_ratio(reports: DataFrame, json_path: str | None = None, pattern: str | None = None, metric: str = "ratio") -> DataFrame:
    """(unit, metric, value) of a reading of the whole tree, by a path in JSON or a pattern; none where it can't be read."""
    value = F.get_json_object("text", json_path) if json_path else F.regexp_extract("text", pattern, 1)
    return reports.select(F.lit("<tree>").alias("unit"), F.lit(metric).alias("metric"), value.try_cast("double").alias("value")).filter("value is not null")


DIAGNOSTIC = r"^([^()\n]+)\((\d+),(\d+)\): error (TS\d+): (.*)$"


def diagnostics(reports: DataFrame) -> DataFrame:
    """(code, path, line, column, actual, required, message) of a compiler's lines; the same one of several projects counts once."""
    part = lambda k: F.regexp_extract(F.trim("line"), DIAGNOSTIC, k)
    typed = lambda k: F.regexp_extract("message", r"rgument of type '([^']+)' is not assignable to parameter of type '([^']+)'|Type '([^']+)' is not assignable to type '([^']+)'", k)
    rows = lines_of(reports).filter(F.trim("line").rlike(DIAGNOSTIC)).select(part(4).alias("code"), F.regexp_replace(part(1), r"\\", "/").alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), part(5).alias("message"))
    out = rows.groupBy("code", "path", "line", "column").agg(F.min("message").alias("message"))
    return out.select("code", "path", "line", "column", F.concat(typed(1), typed(3)).alias("actual"), F.concat(typed(2), typed(4)).alias("required"), "message")


def stale(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, stale): whether a report is older than the newest of its sources. ``reports``: (file, modified), ``sources``: (modified)."""
    newest = sources.agg(F.max("modified").alias("_newest"))
    return reports.join(F.broadcast(newest)).select("file", F.coalesce(F.col("_newest") > F.col("modified"), F.lit(False)).alias("stale"))


def baseline(reports: DataFrame) -> DataFrame:
    """(fingerprint, kind, label) of a snapshot of accepted findings; a bare label that no finding has becomes one of kind ``label``."""
    shape = "struct<findings array<struct<fingerprint string, kind string, label string>>, labels array<string>>"
    x = reports.select(F.from_json("text", shape).alias("x"))
    found = x.select(F.explode("x.findings").alias("f")).select("f.fingerprint", "f.kind", "f.label")
    bare = x.select(F.explode("x.labels").alias("fingerprint")).distinct().join(found.select("fingerprint"), "fingerprint", "left_anti")
    return found.union(bare.select("fingerprint", F.lit("label"), "fingerprint"))


def commits_to_measure(log: DataFrame, recorded: DataFrame, step: int) -> DataFrame:
    """(n, commit): every ``step``-th commit of a log (n, commit), from its first on, that was not recorded yet."""
    return log.filter((F.col("n") - 1) % step == 0).join(recorded.select("commit"), "commit", "left_anti").select("n", "commit")


def changed_paths(status: DataFrame) -> DataFrame:
    """(path) that a name-status listing (line) adds, changes or renames to; deleted ones are not there to be read."""
    f = F.split("line", "\t")
    return status.filter(~F.col("line").startswith("D") & (F.size(f) >= 2)).select(F.element_at(f, -1).alias("path")).distinct()


def renames(status: DataFrame) -> DataFrame:
    """(old, new) of the renames in a name-status listing; without any, an empty map."""
    f = F.split("line", "\t")
    return status.filter(F.col("line").startswith("R") & (F.size(f) == 3)).select(f[1].alias("old"), f[2].alias("new"))


def table_rows(reports: DataFrame) -> DataFrame:
    """(file, no, table, cells) of the rows of pipe tables; a table goes as far as its lines follow each other, its rule of dashes is no row."""
    lines = lines_of(reports).withColumn("piped", F.trim("line").startswith("|"))
    w = Window.partitionBy("file").orderBy("no")
    begins = F.col("piped") & ~F.coalesce(F.lag("piped").over(w), F.lit(False))
    rows = lines.withColumn("table", F.count_if(begins).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("piped")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    return rows.select("file", "no", "table", cells.alias("cells")).filter(~F.forall("cells", lambda c: c.rlike(r"^:?-+:?$")))


def ragged_rows(rows: DataFrame) -> DataFrame:
    """(file, no, width, wanted): rows of another width than the first of their table."""
    w = Window.partitionBy("file", "table").orderBy("no")
    return rows.withColumn("width", F.size("cells")).withColumn("wanted", F.first("width").over(w)).filter("width != wanted").select("file", "no", "width", "wanted")


def delegated_pillar(reports: DataFrame, tool: str, least_version: int = 1) -> DataFrame:
    """(file, score, trusted, reason) of another tool's pillar document: its schema, name and range of scores have to hold."""
    x = F.from_json("text", "struct<schema int, tool string, score double>")
    rows = reports.select("file", x.alias("x"))
    reason = F.when(F.col("x").isNull() | F.col("x.score").isNull(), "no score").when(F.coalesce("x.schema", F.lit(0)) < least_version, "schema too old").when(~F.col("x.tool").eqNullSafe(F.lit(tool)), "another tool").when(~F.col("x.score").between(0, 5), "score out of range")
    return rows.select("file", F.col("x.score").alias("score"), reason.isNull().alias("trusted"), reason.alias("reason"))


def merged_settings(tiers: list[dict], append: tuple[str, ...] = ("exclude_additional",)) -> dict:
    """Settings of several tiers, later ones first in rank: maps merge, scalars and lists are replaced, ``append`` lists grow."""
    out: dict = {}
    for tier in tiers:
        for key, value in tier.items():
            if isinstance(value, dict) and isinstance(out.get(key), dict):
                out[key] = merged_settings([out[key], value], append)
            elif key in append:
                out[key] = [*out.get(key, []), *value]
            else:
                out[key] = value
    return out


def tightened(base: dict[str, float], changed: dict[str, float]) -> dict[str, float]:
    """Limits for changed code, which may only be tighter than those for all code."""
    loose = sorted(k for k, v in changed.items() if k not in base or v > base[k])
    if loose:
        raise ValueError(f"limits of changed code must not be looser: {', '.join(loose)}")
    return base | changed


def is_generated(head: Column, banners: list[str], comment: str = r"^\s*(//|#|/\*|\*|--|;|<!--|%|!)") -> Column:
    """Whether one of the head lines of a file (an array) is a comment with a banner that says so."""
    said = lambda line: F.lower(line).rlike("|".join(f"\\Q{b.lower()}\\E" for b in banners)) & line.rlike(comment)
    return F.exists(head, said)


def declared_reports(spark: SparkSession, path: str, newest: DataFrame) -> DataFrame:
    """(file, modified, commit_time, stale) of report files that a pipeline left: stale if the newest commit came after the file was written.

    ``newest``: a frame with ``commit_time``, of which the latest counts; without any commit nothing is stale. Times of files come
    from the listing, so nothing is read. Ties are fresh.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    last = newest.agg(F.max(F.col("commit_time").cast("timestamp")).alias("commit_time"))
    return files.join(F.broadcast(last)).withColumn("stale", F.coalesce(F.col("modified") < F.col("commit_time"), F.lit(False)))  # a single row
