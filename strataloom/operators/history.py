"""Commit history: churn, hotspots, change coupling, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Pairs that one task counts.
COUNTED = 2_000_000


def churn(touches: DataFrame, path: str, author: str, added: str) -> DataFrame:
    """(path, commits, added, authors): one row for each path. A path that a commit lists twice counts twice. One shuffle, pre-aggregated."""
    return touches.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("commits"), F.sum(added).alias("added"), F.countDistinct(author).alias("authors"))


def hotspots(churned: DataFrame, weights: DataFrame, limit: int | None = 25) -> DataFrame:
    """(path, commits, weight, score): commits times weight of paths with more than one commit; the top ``limit``, all for None. ``weights``: (path, weight)."""
    out = churned.filter("commits > 1").join(weights.filter("weight > 0"), "path").select("path", "commits", "weight", (F.col("commits") * F.col("weight")).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "path").limit(limit)


def coupling(touches: DataFrame, commit: str, path: str, most_files: int = 30, support: int = 5, confidence: float = 0.5) -> DataFrame:
    """(a, b, co_changes, confidence): paths that change together.

    Commits of more than ``most_files`` distinct paths are left out before anything is paired, which bounds the pairs
    of a commit, and their number says how many tasks count them; ``confidence`` is over the smaller number of commits that touch one of the two.
    """
    own = touches.select(F.col(commit).alias("commit"), F.col(path).alias("path")).distinct()
    few = own.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n") <= most_files).select("commit")
    small = own.join(few, "commit", "left_semi").groupBy("commit").agg(F.array_sort(F.collect_set("path")).alias("paths"))  # ``most_files`` paths at most
    small = staged(small, "commits")
    # Pairs are nearly all distinct on one side of a shuffle, so they are dealt to as many tasks as they need before any are counted.
    total = small.agg(F.sum(F.size("paths") * (F.size("paths") - 1) / 2)).first()[0] or 0
    parts = max(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // COUNTED) + 1)
    pairs = small.select(F.explode(F.flatten(F.transform("paths", lambda x: F.transform(F.filter("paths", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*")
    both = pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("co_changes")).filter(F.col("co_changes") >= support)
    touched = small.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    out = both.join(touched.withColumnsRenamed({"path": "a", "n": "na"}), "a").join(touched.withColumnsRenamed({"path": "b", "n": "nb"}), "b")
    out = out.withColumn("confidence", F.col("co_changes") / F.least("na", "nb")).filter(F.col("confidence") >= confidence)
    return out.select("a", "b", "co_changes", F.round("confidence", 6).alias("confidence"))


def ownership(churned: DataFrame, settled: int = 3, hot_commits: int = 5) -> DataFrame:
    """One row of counts over all paths: settled ones, those of a single author, busy ones."""
    return churned.agg(F.count("*").alias("files"), F.count_if(F.col("commits") >= settled).alias("settled"), F.count_if((F.col("commits") >= settled) & (F.col("authors") == 1)).alias("single_author"), F.count_if(F.col("commits") >= hot_commits).alias("busy"))


def window_counts(commits: DataFrame, merge: str = "is_merge") -> DataFrame:
    """(commits, non_merges): tells an empty window from one of merges only."""
    return commits.agg(F.count("*").alias("commits"), F.count_if(~F.col(merge)).alias("non_merges"))
