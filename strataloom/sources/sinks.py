"""Sinks: a log that is appended to, a sorted snapshot, and findings as SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bounded


def append_log(scans: DataFrame, path: str) -> None:
    """Appends records as JSON lines; each write commits whole or not at all."""
    scans.write.mode("append").option("ignoreNullFields", False).json(path)


def write_snapshot(findings: DataFrame, path: str, key: str = "fingerprint") -> None:
    """Replaces a snapshot of accepted findings; files follow each other in the order of ``key``, and so do rows in them."""
    findings.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").json(path)


def sarif_results(findings: DataFrame, *keep: str) -> DataFrame:
    """(keep, result): one SARIF result for each finding (rule, message, path, line, status); ``fail`` is an error, all else a warning."""
    region = F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(F.col("status") == "fail", "error").otherwise("warning")
    return findings.select(*keep, F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def rule_descriptors(findings: DataFrame) -> DataFrame:
    """(id, findings): the distinct rules that a SARIF run lists."""
    return findings.groupBy(F.col("rule").alias("id")).agg(F.count("*").alias("findings"))


def sarif_document(findings: DataFrame, path: str, tool: str, version: str = "2.1.0") -> str:
    """One SARIF document, the only file of the folder ``path``: results in the order of path, line and rule, rules once each. Written whole or not at all.

    Results are written by ranges and joined (``bounded.ordered_document``), so no task or row holds them all; the rules
    follow from a sorted table, one at a time. Returns the file's path.
    """
    order = [F.coalesce("path", F.lit("")).alias("_p"), F.coalesce("line", F.lit(0)).alias("_l"), F.coalesce("rule", F.lit("")).alias("_r"), F.coalesce("message", F.lit("")).alias("_m")]
    results = sarif_results(findings.select("*", *order), "_p", "_l", "_r", "_m")

    def rules():
        yield b'],"tool":{"driver":{"name":' + json.dumps(tool).encode() + b',"rules":['
        for n, r in enumerate(rule_descriptors(findings).filter("id is not null").orderBy("id").toLocalIterator()):
            yield b"," * bool(n) + json.dumps({"id": r["id"]}).encode()
        yield b"]}}}]}\n"

    return bounded.ordered_document(results, ["_p", "_l", "_r", "_m", "result"], path, "part-00000.sarif", value="result", head='{"version":' + json.dumps(version) + ',"runs":[{"results":[', foot=rules(), between=",")


def attestation(cards: DataFrame, commit: str, tool: str) -> DataFrame:
    """(commit, tool, overall, low, high, grade, digest): a record for each card, its digest over the rest."""
    rows = cards.select(F.lit(commit).alias("commit"), F.lit(tool).alias("tool"), "overall", "low", "high", "grade")
    return rows.withColumn("digest", F.sha2(F.to_json(F.struct(*rows.columns)), 256))


def coverage_document(coverage: DataFrame) -> DataFrame:
    """(outcome, tools): the tools of each outcome in the order of their names."""
    return coverage.groupBy("outcome").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
