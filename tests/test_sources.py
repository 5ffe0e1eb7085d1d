import json

from pyspark.sql import functions as F

from strataloom.functions import markers, paths
from strataloom.sources import files, findings, sinks


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_both_spellings_of_a_directory_exclude_alike(spark):
    own = ["a/build/x.py", "build", "build/x.py", "a/x.min.js", "abuild/x", None]
    for spelling in ("build/", "**/build/"):
        assert column(spark, own, lambda c: paths.is_excluded(c, [spelling])) == [True, False, True, False, False, None]
    assert column(spark, own, lambda c: paths.is_excluded(c, ["*.min.js", "build"])) == [True, True, True, True, False, None]
    assert column(spark, own[:2], lambda c: paths.is_excluded(c, [])) == [False, False]


def test_test_paths_and_the_names_they_cover(spark):
    own = ["src/a.py", "tests/a.py", "src\\Test_A.py", "a.spec.ts", "latest/a.py", "b.pf", "a_test.go"]
    assert column(spark, own, paths.is_test_path) == [False, True, True, True, False, True, True]
    assert column(spark, ["a/test_churn.py", "churn_mod.f90", "Churn.spec.ts", "_mod.py"], paths.subject_stem) == ["churn", "churn", "churn", "_mod"]
    assert column(spark, ["lib/x_pb2.py", "x_pb2.py", "gen/x.py", "tests/x.py", "x.py"], lambda c: paths.provenance(c, ["lib"], ["gen/"])) == ["vendored", "generated", "generated", "test", "first-party"]


def test_a_quoted_marker_is_only_mentioned(spark):
    own = ["x = 1  # noqa", "say `# noqa` here", "'# noqa'", "# NOSEC", "it.skip('x')", "plain", None]
    assert column(spark, own, markers.suppression) == ["noqa", None, None, "nosec", "skipped test", None, None]


def test_imports_give_root_packages(spark):
    assert column(spark, ["import Requests.api", "from .own import x", "from os.path import join", "x = 1"], lambda c: markers.imported(c, F.lit(True))) == [["requests"], [], ["os"], []]
    assert column(spark, ["import x from '@A/b/c'", "const y = require(\"ky/z\")", "import './own'"], lambda c: markers.imported(c, F.lit(False))) == [["@a/b"], ["ky"], []]


def test_files_under_a_root(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "sub/c.txt", ".git/d.py", "out/e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\n")
    only = spark.createDataFrame([("a.py",), ("out/e.py",)], "path string")
    read = lambda **o: sorted(r["path"] for r in files.source_files(spark, f"file://{tmp_path}", [".py"], ["out/"], **o).collect())
    assert read() == ["a.py", "sub/b.py"]
    assert read(only=only) == ["a.py"]


def test_numstat_log(spark, tmp_path):
    (tmp_path / "log").write_text("\x1ecommit\x1fann\n\n3\t1\tsrc/{a => b}/c.py\n-\t-\tlogo.png\nnoise\n\x1ecommit\x1fbob\n1\t0\told => new\n")
    got = [(r["author"], r["path"], r["added"], r["removed"]) for r in files.numstat_log(spark, f"file://{tmp_path}/log").collect()]
    assert sorted(got) == [("ann", "logo.png", 0, 0), ("ann", "src/b/c.py", 3, 1), ("bob", "new", 1, 0)]


def test_diff_lines_have_the_numbers_of_their_side(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3 +3,2 @@ f\n-old\n+new\n+two\n@@ -9,2 +10,2 @@\n same\n-gone\n+here\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n--- was\n"
    got = [(r["path"], r["side"], r["line"], r["text"]) for r in files.diff_lines(spark.createDataFrame([(1, diff)], "diff_id int, text string")).collect()]
    assert sorted(got) == sorted([("x", "-", 3, "old"), ("x", "+", 3, "new"), ("x", "+", 4, "two"), ("x", "-", 10, "gone"), ("x", "+", 11, "here"), ("y", "-", 1, "-- was")])


def test_reports_become_findings(spark, tmp_path):
    place = lambda name, body: ((tmp_path / name).write_text(body), f"file://{tmp_path}/{name}")[1]
    s = findings.sarif(spark, place("s", json.dumps({"runs": [{"results": [{"message": {"text": "m"}}]}, {"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "p"}, "region": {"startLine": 4}}}]}]}]})))
    assert sorted((r["tool"], r["rule"], r["level"], r["path"], r["line"]) for r in s.collect()) == [("sarif", "unknown", "warning", "", 1), ("t", "r", "warning", "p", 4)]
    xml = '<checkstyle><file name="a"><error line="0" message="m" source="s"/><error line="7" message="n"/></file></checkstyle>'
    assert sorted(((r["path"], r["line"], r["rule"]) for r in findings.checkstyle(spark, place("x", xml), "t", "c").collect()), key=lambda r: r[1] is None) == [("a", 7, None), ("a", None, "s")]
    assert findings.checkstyle(spark, place("y", "<!DOCTYPE a>" + xml), "t", "c").count() == 0
    keys = ("at.path", "line", "text")
    j = findings.json_findings(spark, place("j", '{"d": {"list": [{"at": {"path": "p"}, "line": 2, "text": "t", "code": "", "message-id": "C1"}]}}'), "d.list", keys, "t", "c")
    assert [(r["path"], r["line"], r["message"], r["rule"]) for r in j.collect()] == [("p", 2, "t", "C1")]
    assert [(r["path"], r["rule"]) for r in findings.json_lines(spark, place("l", 'noise\n {"at": {"path": "p"}, "symbol": "s"}\n'), keys, "t", "c").collect()] == [("p", "s")]
    assert [(r["path"], r["line"], r["message"]) for r in findings.text_findings(spark, place("t", "a.py:3: unused\na.py:3: unused\nsummary\n"), "t", "c").collect()] == [("a.py", 3, "unused")]


def test_log_and_snapshot_round_trip(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    for version in ("1", "2"):
        sinks.append_log(spark.createDataFrame([(version, ["x"])], "tool_version string, analyzers array<string>"), log)
    (tmp_path / "log" / "part-more.json").write_text('{"rubric_version": "0"}\n{"tool_ver\n')
    got = findings.scan_history(spark, log, "tool_version string, analyzers array<string>").collect()
    assert sorted((r["tool_version"], r["analyzers"]) for r in got) == [("0", []), ("1", ["x"]), ("2", ["x"])]
    sinks.write_snapshot(spark.createDataFrame([("b",), ("a",)], "fingerprint string"), f"file://{tmp_path}/snap")
    assert sorted(r["fingerprint"] for r in spark.read.json(f"file://{tmp_path}/snap").collect()) == ["a", "b"]
    one = sinks.sarif_results(spark.createDataFrame([("r", "m", "p", None, "fail")], "rule string, message string, path string, line long, status string")).first()["result"]
    assert json.loads(one)["level"] == "error" and json.loads(one)["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
