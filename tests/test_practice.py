"""Pairing, signals, foreign directories and states on small tables."""

from pyspark.sql import functions as F

from strataloom.audit import risk_findings
from strataloom.operators import practice


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_pairing_by_name_and_by_import(spark):
    files = spark.createDataFrame([("src/churn.py",), ("src/graph.py",), ("src/alone.py",), ("tests/test_churn.py",), ("tests/test_all.py",)], "path string")
    imports = spark.createDataFrame([("tests/test_all.py", "pkg.graph"), ("src/alone.py", "pkg.alone")], "path string, name string")
    pairs = practice.paired(files, imports)
    assert rows(pairs, "path", "paired") == [("src/alone.py", False), ("src/churn.py", True), ("src/graph.py", True)]
    graded = spark.createDataFrame([("src/alone.py", "f", "fail"), ("src/churn.py", "g", "fail")], "path string, name string, status string")
    own = spark.createDataFrame([("src/alone.py", "fail")], "path string, status string")
    assert rows(practice.unpaired_failures(own, graded, pairs), "label", "kind") == [("f", "declaration")]
    assert rows(practice.unpaired_failures(own, graded.limit(0), pairs), "label", "kind") == [("src/alone.py", "file")]


def test_signals_and_levels(spark):
    def level(*texts):
        frame = spark.createDataFrame(list(texts), "path string, text string")
        return practice.practice_level(practice.signals(frame), frame).first()["level"]

    ci = ".github/workflows/ci.yml"
    assert [level((ci, "echo")), level((ci, "ruff")), level((ci, "ruff\npytest")), level((ci, "ruff\npytest --cov-fail-under=90")), level((ci, "ruff\npytest --cov-fail-under=90\nxenon"))] == [1, 2, 3, 4, 5]
    assert level(("pyproject.toml", "ruff pytest mypy")) == 2
    frame = spark.createDataFrame([("a/b/tox.ini", "pytest"), ("z.ini", "pytest"), (ci, "nothing")], "path string, text string")
    assert rows(practice.signals(frame), "signal", "path", "runs") == [("tests", "z.ini", False)]


def test_foreign_directories(spark):
    manifests = spark.createDataFrame([("package.json", '{"scripts": {"clean": "rimraf ./dist build/ && echo", "sync-vendor": "x", "sync:dist": "y"}}'), (".gitmodules", '[submodule "x"]\n\tpath = third/x\n\turl = u\n'), ("other.json", "{}")], "path string, text string")
    assert rows(practice.foreign_directories(manifests), "directory", "evidence") == [("build", "removed"), ("dist", "removed"), ("third/x", "submodule"), ("vendor", "synced")]


def test_states_are_never_zero(spark):
    frame = spark.createDataFrame([(None, 0, 0, False), (5, 5, 5, True), (0, 0, 0, False), (3, 0, 0, False), (3, 2, 0, False), (3, 2, 1, False)], "c int, n int, t int, s boolean")
    got = [r[0] for r in frame.select(practice.history_state(F.col("c"), F.col("n"), F.col("t"), F.col("s"))).collect()]
    assert got == ["no repository", "shallow", "nothing committed", "merges only", "no scanned file touched", "measured"]
    values = spark.createDataFrame([(1.0, "x"), (None, "not applicable"), (None, "not read")], "v double, r string")
    assert [tuple(r[0]) for r in values.select(practice.evidence_state(F.col("v"), F.col("r"))).collect()] == [("measured", 1.0, None), ("not_applicable", None, "not applicable"), ("unknown", None, "not read")]


def test_asks_skips_rules_and_oracles(spark):
    changed = spark.createDataFrame([("src/a.py",), ("src/b/c.py",), ("docs/x.md",)], "path string")
    assert rows(practice.asked(changed, ["src/*.py", "docs/**"]), "path")[0] == ("docs/x.md",) and practice.asked(changed, []).count() == 0
    lines = spark.createDataFrame([("tests/test_a.py", 1, "@pytest.mark.skip"), ("src/a.py", 2, "@pytest.mark.skip"), ("tests/test_a.py", 3, "x = 1  # noqa")], "path string, line_no int, text string")
    assert rows(practice.skipped_tests(lines), "path", "line") == [("tests/test_a.py", 1)]
    assert practice.admitted(r"\bTODO\b") and not practice.admitted("(a+)+$") and not practice.admitted("(")
    before = spark.createDataFrame([("t1", 5, 0), ("t2", 5, 0), ("t3", 1, 0)], "path string, asserts int, skips int")
    after = spark.createDataFrame([("t1", 4, 0), ("t2", 5, 1), ("t3", 2, 0)], "path string, asserts int, skips int")
    assert rows(practice.new_oracles(before, after), "path") == [("t1",), ("t2",)]


def test_rules_that_backtrack_do_not_run(spark):
    rules = [("todo", r"(?i)\bTODO\b", None), ("open", "(", None), ("slow", r"(x+x+)+y|(\s*\s*\s*\s*\s*\s*)*z|(a|aa|a1)+$|((a?1?)*)*b", None), ("back", r"(\w+)=\1", (".py",))]
    good, refused = practice.admitted_rules(spark, rules)
    found = {r["rule"]: r["reason"] for r in refused.collect()}
    assert [r[0] for r in good] == ["todo", "back"] and found["open"].startswith("does not compile") and "more than 5 ms" in found["slow"]
    lines = spark.createDataFrame([("a.py", 1, "# todo x=x")], "path string, line_no int, text string")
    assert sorted(r["rule"] for r in risk_findings(lines, good).collect()) == ["back", "todo"] and risk_findings(lines, []).count() == 0
