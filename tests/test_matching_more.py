"""Rename maps, counts by role, declared reports and remembered results on small cases."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from strataloom.operators import bands, incremental, matching
from strataloom.sources import readers


def pairs(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


def test_chains_of_renames_are_closed(spark):
    chain = [(i, f"n{i}", f"n{i + 1}") for i in range(1, 40)]
    rows = chain + [(100, "a", "b"), (101, "b", "c"), (102, "x", "a"), (103, "a", "y"), (104, "k", "l"), (105, "l", "k"), (106, None, "z"), (107, "q", "q"), (101, "b", "c"), (50, "swap", "t"), (50, "t", "swap")]
    moved = matching.rename_map(spark.createDataFrame(rows, "seq long, old string, new string"))
    # k came back to where it was; a is left by the first file and taken by another, which goes on to y
    assert pairs(moved, "old", "new") == sorted([("n1", "n40"), ("a", "c"), ("x", "y"), ("swap", "t"), ("t", "swap")], key=str)
    assert matching.rename_map(spark.createDataFrame([], "seq long, old string, new string")).count() == 0
    with pytest.raises(RuntimeError):
        matching.rename_map(spark.createDataFrame(rows, "seq long, old string, new string"), rounds=2)


def test_a_file_renamed_thrice_is_matched_in_the_last_tier(spark):
    moves = spark.createDataFrame([(1, "a.py", "b.py"), (2, "b.py", "c.py"), (3, "c.py", "d.py")], "seq long, old string, new string")
    schema = "fingerprint string, digest string, rule string, path string, line long"
    known = spark.createDataFrame([("k1", "x", "r", "a.py", 1), ("k2", "y", "r", "e.py", 5)], schema)
    now = spark.createDataFrame([("c1", "z", "r", "d.py", 90), ("c2", "y", "r", "f.py", 7)], schema)
    tiers = [["digest"], ["path", "rule", "line"], ["path", "rule"], ["path_now", "rule"]]
    got = matching.tiered_match(now.withColumn("path_now", F.col("path")), matching.at_new_paths(known, matching.rename_map(moves)), tiers)
    assert pairs(got, "current", "known", "tier") == [("c1", "k1", 4), ("c2", "k2", 1)]


def test_counts_by_role(spark):
    rows = [("p", "src/a", 10.0), ("p", "src/b", None), ("p", "tests/c", 90.0), ("q", "src/d", 60.0), ("q", None, 1.0)]
    units = spark.createDataFrame(rows, "project string, path string, lines double")
    got = bands.counts_by_role(units, ["project"], F.col("path").startswith("tests/"), {"lines": ("lines", 50, 80)})
    assert got.columns == ["project", "role", "units", "lines_fail", "lines_warn", "lines_pressure"]
    assert pairs(got, *got.columns) == sorted([("p", "all", 3, 1, 0, 0.375), ("p", "production", 2, 0, 0, 0.0), ("p", "test", 1, 1, 0, 0.75), ("q", "all", 2, 0, 1, 0.25), ("q", "production", 2, 0, 1, 0.25)], key=str)
    assert bands.counts_by_role(units.limit(0), ["project"], F.lit(False), {"lines": ("lines", 50, 80)}).count() == 0


def test_declared_reports_are_stale_after_a_commit(spark, tmp_path):
    for name, day in (("old.sarif", 1), ("same.sarif", 5), ("new.sarif", 9)):
        (tmp_path / name).write_text("{}")
        at = datetime.datetime(2024, 3, day, tzinfo=datetime.timezone.utc).timestamp()
        os.utime(tmp_path / name, (at, at))
    commits = spark.sql("select timestamp'2024-03-05 00:00:00' commit_time union all select timestamp'2024-01-01 00:00:00'")
    got = readers.declared_reports(spark, f"file://{tmp_path}", commits)
    assert {r["file"].rsplit("/", 1)[1]: r["stale"] for r in got.collect()} == {"old.sarif": True, "same.sarif": False, "new.sarif": False}
    assert not any(r["stale"] for r in readers.declared_reports(spark, f"file://{tmp_path}", commits.limit(0)).collect())


def test_results_are_remembered_by_commit_and_code(spark, tmp_path):
    store, runs = f"file://{tmp_path}/store", []

    def make():
        runs.append(1)
        return {"a": spark.range(3), "b": spark.range(len(runs)).withColumnRenamed("id", "n")}

    for commit, digest, read, made in (("c1", "d1", False, 1), ("c1", "d1", True, 1), ("c1", "d2", False, 2), ("c2", "d1", False, 3), ("c1", "d1", True, 3)):
        tables, from_store = incremental.remembered(spark, store, commit, make, digest)
        assert (from_store, len(runs), sorted(tables), tables["a"].count()) == (read, made, ["a", "b"], 3)

    def broken():
        return {"a": spark.range(3), "b": spark.range(2).select(F.expr("1 div id").alias("x"))}

    with pytest.raises(Exception, match="(?i)divi"):
        incremental.remembered(spark, store, "c3", broken, "d1")
    commits = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "commit string")
    assert pairs(incremental.missing(spark, store, commits, "d1"), "commit") == [("c3",)] and pairs(incremental.missing(spark, store, commits, "d2"), "commit") == [("c2",), ("c3",)]
    assert not incremental.remembered(spark, store, "c3", make, "d1")[1] and incremental.remembered(spark, store, "c3", make, "d1")[1]


def test_long_chains_over_few_paths_take_few_rounds(spark, monkeypatch):
    """A log of 3,000 renames among seven paths, followed by hand; blocks of a path or two give the same."""
    rows = [(i // 2, f"p{i * i % 7}", f"p{(i * 5 + i // 3) % 7}") for i in range(3000)]
    first, comes, log = {}, {}, {}
    for s, a, b in rows:
        if a != b:
            log.setdefault(s, {})[a] = min(b, log.get(s, {}).get(a, b))
    for s in sorted(log):
        for a, b in log[s].items():
            first.setdefault(a, s)
            comes.setdefault(b, s)
    want = []
    for head in [p for p in first if first[p] <= comes.get(p, first[p])]:
        end = head
        for s in sorted(log):
            end = log[s].get(end, end)
        want += [(head, end)] if end != head else []
    frame = spark.createDataFrame(rows, "seq long, old string, new string")
    written = []
    keep = matching.staged
    monkeypatch.setattr(matching, "staged", lambda df, name: written.append(keep(df, name)) or written[-1])
    assert pairs(matching.rename_map(frame), "old", "new") == sorted(want, key=str)
    assert len(written) <= 8
    monkeypatch.setattr(matching, "BLOCK_PATHS", 1)
    assert pairs(matching.rename_map(frame.coalesce(1)), "old", "new") == sorted(want, key=str)
