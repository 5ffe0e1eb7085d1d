"""Trees of text files, and what version control says about them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import is_excluded


def source_files(spark: SparkSession, root: str, suffixes: list[str], exclude: list[str] = (), only: DataFrame | None = None) -> DataFrame:
    """(path, content, modified, valid) of the files under ``root`` with one of the suffixes; ``only`` (path) keeps those named there.

    What is not valid UTF-8 is replaced by U+FFFD and ``valid`` is false; no file is left out for it. Only regular files are
    listed, and paths are those below ``root``.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    base = re.sub(r"^[\w+.-]+:(//(?=.))?", "", root).rstrip("/") + "/"
    path = F.element_at(F.split(F.col("path"), F.lit(f"\\Q{base}\\E"), 2), -1)
    own = read.select(path.alias("path"), "content", F.col("modificationTime").alias("modified"))
    own = own.filter(~F.col("path").rlike(r"(^|/)\.git/") & ~is_excluded(F.col("path"), list(exclude)))
    own = own if only is None else own.join(only.select("path").distinct(), "path", "left_semi")
    return own.withColumn("valid", F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def _renamed(path):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\{.* => (.*)\}", "$1"), r"^.* => ", ""), "//", "/")


def numstat_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_no, author, path, added, removed) of a log whose commits begin ``\\x1ecommit\\x1fauthor``; renames give the new path.

    ``-`` counts of binary files are 0, yet they are touches. Lines that are not three fields are skipped.
    """
    blocks = spark.read.option("lineSep", "\x1e").text(path).filter("trim(value) != ''").withColumn("commit_no", F.monotonically_increasing_id())
    lines = F.split("value", "\n")
    rows = blocks.select("commit_no", F.trim(F.split_part(lines[0], F.lit("\x1f"), F.lit(2))).alias("author"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line"))
    fields = F.split("line", "\t")
    count = lambda i: F.coalesce(F.expr(f"try_cast(f[{i}] as bigint)"), F.lit(0).cast("long"))
    return rows.select("commit_no", "author", fields.alias("f")).filter(F.size("f") == 3).select("commit_no", "author", _renamed(F.col("f")[2]).alias("path"), count(0).alias("added"), count(1).alias("removed"))


def diff_lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "text") -> DataFrame:
    """(id, path, side, line, text): lines that unified diffs add (+, new numbers) or remove (-, old numbers)."""
    rows = diffs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    rows = rows.withColumn("section", F.count_if(F.col("raw").startswith("diff ")).over(Window.partitionBy("id").orderBy("pos")))
    inside = Window.partitionBy("id", "section").orderBy("pos")
    rows = rows.withColumn("hunk", F.count_if(F.col("raw").startswith("@@ ")).over(inside))
    header = F.col("hunk") == 0
    whole = Window.partitionBy("id", "section")
    named = lambda mark: F.max(F.when(header & F.col("raw").startswith(mark), F.substring("raw", 7, 1 << 20))).over(whole)
    rows = rows.withColumn("new", named("+++ b/")).withColumn("old", named("--- a/")).filter("hunk > 0")
    at = Window.partitionBy("id", "section", "hunk")
    start = lambda k: F.max(F.expr(f"try_cast(nullif(regexp_extract(raw, '^@@ -([0-9]+)[^+]*[+]([0-9]+)', {k}), '') as bigint)")).over(at)
    first, so_far = F.substring("raw", 1, 1), at.orderBy("pos")
    rows = rows.withColumn("side", first).withColumn("n_new", start(2) - 1 + F.count_if(first.isin("+", " ")).over(so_far)).withColumn("n_old", start(1) - 1 + F.count_if(first.isin("-", " ")).over(so_far))
    added = F.col("side") == "+"
    return rows.filter(F.col("side").isin("+", "-")).select("id", F.when(added, F.col("new")).otherwise(F.coalesce("old", "new")).alias("path"), "side", F.when(added, F.col("n_new")).otherwise(F.col("n_old")).alias("line"), F.substring("raw", 2, 1 << 30).alias("text"))
