"""Readers of tools' reports; all give (concept, path, line, message, tool, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SARIF = "struct<runs array<struct<tool struct<driver struct<name string>>, results array<struct<ruleId string, level string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine bigint>>>>>>>>>"
CHECKSTYLE = "struct<file array<struct<_name string, error array<struct<_line bigint, _message string, _source string, _rule string>>>>>"
# Keys that name a rule, the first one that is set counts.
RULE_KEYS = ["symbol", "rule", "code", "ruleId", "check_name", "message-id"]


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def sarif(spark: SparkSession, path: str, tool: str = "sarif") -> DataFrame:
    """Results of SARIF files with their level; a missing rule is ``unknown``, level ``warning``, line 1, path and message empty."""
    runs = _whole(spark, path).select(F.explode(F.from_json("value", SARIF)["runs"]).alias("run"))
    rows = runs.select(F.coalesce("run.tool.driver.name", F.lit(tool)).alias("tool"), F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select(F.coalesce("r.ruleId", F.lit("unknown")).alias("rule"), F.coalesce("r.level", F.lit("warning")).alias("level"), F.coalesce("r.message.text", F.lit("")).alias("message"), F.coalesce(place["artifactLocation"]["uri"], F.lit("")).alias("path"), F.coalesce(place["region"]["startLine"], F.lit(1)).alias("line"), "tool")


def refusal(text: Column) -> Column:
    """Why an XML report is not read: it declares a document type or entities, or holds over 64 MiB; null if it is."""
    return F.when(F.octet_length(text) > 64 << 20, "larger than 64 MiB").when(text.rlike("(?i)<!(DOCTYPE|ENTITY)"), "declares a document type or entities")


def refused_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the XML reports that are not read."""
    rows = _whole(spark, path).select(F.input_file_name().alias("file"), refusal(F.col("value")).alias("reason"))
    return rows.filter("reason is not null")


def checkstyle(spark: SparkSession, path: str, tool: str, concept: str) -> DataFrame:
    """Errors of Checkstyle XML. Files that ``refusal`` names a reason for give no rows here and one in ``refused_reports``."""
    safe = _whole(spark, path).filter(refusal(F.col("value")).isNull())
    rows = safe.select(F.explode(F.from_xml("value", CHECKSTYLE)["file"]).alias("f")).select("f._name", F.explode("f.error").alias("e"))
    return rows.select(F.lit(concept).alias("concept"), F.coalesce("_name", F.lit("")).alias("path"), F.nullif("e._line", F.lit(0)).alias("line"), F.coalesce("e._message", F.lit("")).alias("message"), F.lit(tool).alias("tool"), F.coalesce("e._source", "e._rule").alias("rule"))


def _row(item: Column, keys: tuple[str, str, str], tool: str, concept: str) -> list[Column]:
    at = lambda key: F.get_json_object(item, "$." + key)
    rule = F.coalesce(*[F.nullif(F.get_json_object(item, f"$['{k}']"), F.lit("")) for k in RULE_KEYS])
    return [F.lit(concept).alias("concept"), F.coalesce(at(keys[0]), F.lit("")).alias("path"), at(keys[1]).try_cast("long").alias("line"), F.coalesce(at(keys[2]), F.lit("")).alias("message"), F.lit(tool).alias("tool"), rule.alias("rule")]


def json_findings(spark: SparkSession, path: str, items: str, keys: tuple[str, str, str], tool: str, concept: str) -> DataFrame:
    """Items of the array at the dotted path ``items`` (empty: the whole document); ``keys`` are those of path, line and message."""
    rows = _whole(spark, path).select(F.explode(F.from_json(F.get_json_object("value", "$" + ("." + items if items else "")), "array<string>")).alias("item"))
    return rows.select(*_row(F.col("item"), keys, tool, concept))


def json_lines(spark: SparkSession, path: str, keys: tuple[str, str, str], tool: str, concept: str) -> DataFrame:
    """One object on each line; lines that do not begin with a brace are noise."""
    rows = spark.read.text(path).filter(F.ltrim("value").startswith("{"))
    return rows.select(*_row(F.col("value"), keys, tool, concept))


def text_findings(spark: SparkSession, path: str, tool: str, concept: str, pattern: str = r"^(.+?):(\d+):(?:\d+:)?\s*(.*)$") -> DataFrame:
    """``path:line: message`` on a line each; other lines are skipped and repeated ones count once."""
    part = lambda k: F.regexp_extract("value", pattern, k)
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern)).distinct()
    return rows.select(F.lit(concept).alias("concept"), part(1).alias("path"), part(2).cast("long").alias("line"), part(3).alias("message"), F.lit(tool).alias("tool"), F.lit(None).cast("string").alias("rule"))


def scan_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log; broken lines are skipped, ``rubric_version`` stands in for ``tool_version``, missing arrays are empty."""
    rows = spark.read.schema(f"{schema}, rubric_version string, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path).filter("_broken is null")
    filled = [F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.coalesce("rubric_version", "tool_version").alias(f.name) if f.name == "tool_version" else F.col(f.name) for f in rows.schema if f.name not in ("rubric_version", "_broken")]
    return rows.select(*filled)
