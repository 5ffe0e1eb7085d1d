"""Tracks of findings, escalations, targeted outcomes, readers and documents on small inputs."""

import json
import random

import pytest

from strataloom.operators import reports
from strataloom.sources import readers, sinks


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_tracks_follow_what_moves(spark):
    seen = [
        ("g", 1, "a", "r", "x.py", 10), ("g", 1, "b", "r", "x.py", 20),
        ("g", 2, "a2", "r", "x.py", 10), ("g", 2, "b", "r", "y.py", 5),  # the first is edited in place, the second moves to another file
        ("g", 3, "c", "r", "x.py", 13),  # nearest line of the same rule and path
        ("g", 4, "a2", "r", "x.py", 13), ("g", 4, "n", "q", "x.py", 13),
        ("h", 1, "a", "r", "x.py", 10),
    ]
    frame = spark.createDataFrame(seen, "repo string, scan long, fingerprint string, rule string, path string, line int")
    got = rows(reports.tracks(frame, "repo"), "by", "scan", "track", "fingerprint")
    assert got == [("g", 1, 0, "a"), ("g", 1, 1, "b"), ("g", 2, 0, "a2"), ("g", 2, 1, "b"), ("g", 3, 0, "c"), ("g", 4, 0, "a2"), ("g", 4, 2, "n"), ("h", 1, 0, "a")]
    assert reports.tracks(frame.limit(0), "repo").count() == 0


def followed(findings):
    """The same in plain Python: (series, scan, fingerprint, rule, path, line) -> rows of (by, scan, track, fingerprint)."""
    low = lambda v: (v is not None, v if v is not None else 0)  # noqa: E731  nulls first
    out = []
    for series in {f[0] for f in findings}:
        own, seen = [f for f in findings if f[0] == series], []
        for scan in sorted({f[1] for f in own}):
            here, taken = sorted((f for f in own if f[1] == scan), key=lambda f: (low(f[4]), low(f[5]), low(f[2]), low(f[3]))), {}
            for keys in ((2,), (3, 4, 5), (3, 4)):
                free = [t for t in range(len(seen)) if t not in taken.values()]
                left = [i for i in range(len(here)) if i not in taken]
                groups = {}
                for i in sorted(left, key=lambda i: (low(here[i][5]), low(here[i][2]), i)):
                    groups.setdefault(tuple(here[i][k] for k in keys), ([], []))[0].append(i)
                for t in sorted(free, key=lambda t: (low(seen[t][5]), low(seen[t][2]), t)):
                    groups.setdefault(tuple(seen[t][k] for k in keys), ([], []))[1].append(t)
                for key, (a, b) in groups.items():
                    if None not in key:
                        taken |= dict(zip(a, b))
            for i, f in enumerate(here):
                if i not in taken:
                    taken[i] = len(seen)
                    seen.append(None)
                seen[taken[i]] = f
                out.append((series, scan, taken[i], f[2]))
    return out


def test_tracks_equal_plain_python_with_nulls_and_repeats(spark):
    rng = random.Random(5)
    pick = lambda values: rng.choice(values)
    findings = [(pick(["g", "h", None]), pick([1, 2, 5]), pick(["a", "b", "c", "d", None]), pick(["r", "q"]), pick(["x.py", "y.py", None]), pick([1, 2, 3, None])) for _ in range(90)]
    frame = spark.createDataFrame([*findings, ("g", None, "a", "r", "x.py", 1)], "repo string, scan long, fingerprint string, rule string, path string, line int")
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    got = [tuple(r) for r in reports.tracks(frame.repartition(3), "repo").collect()]
    assert sorted(got, key=key) == sorted(followed(findings), key=key)


def test_what_returns_twice_escalates(spark):
    present = {0: [1, 3, 5], 1: [1, 2, 3, 4, 5], 2: [1], 3: [1, 2, 4]}
    frame = spark.createDataFrame([("g", s, t, str(t)) for t, own in present.items() for s in own], "by string, scan long, track long, fingerprint string")
    assert rows(reports.escalations(frame), "track", "returned") == [(0, 2)]
    asked = spark.createDataFrame([("g", 1, t) for t in present], "by string, scan long, track long")
    assert dict(rows(reports.targeted(asked, frame), "track", "outcome")) == {0: "cleared-then-returned", 1: "never-cleared", 2: "cleared", 3: "cleared"}


def test_ours_and_lists(spark):
    readings = spark.createDataFrame([("t", "f", "a.py"), ("t", "f", "lib/b.py"), ("t", "<tree>", None), ("u", "<tree>", None)], "tool string, unit string, path string")
    kept = reports.ours(readings, spark.createDataFrame([("a.py",)], "path string"), spark.createDataFrame([("u",)], "tool string"))
    assert sorted((r["tool"], r["unit"], r["path"] or "") for r in kept.collect()) == [("t", "f", "a.py"), ("u", "<tree>", "")]
    coverage = spark.createDataFrame([("x", "missing"), ("y", "contributed"), ("z", "failed")], "tool string, outcome string")
    assert rows(reports.remedies(coverage, spark.createDataFrame([("x", "missing", "install x")], "tool string, outcome string, remedy string")), "tool", "remedy") == [("x", "install x"), ("z", "see the tool's log")]


def text(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")


def test_metric_reports(spark):
    assert rows(readers.map_metrics(text(spark, '{"a.py": {"mi": 71.5, "rank": "A"}, "b.py": {"error": "x"}}', "broken"), "mi", "mi"), "path", "value") == [("a.py", 71.5)]
    assert rows(readers.list_metrics(text(spark, '{"files": [{"path": "a", "n": "3"}, {"path": "b", "n": "?"}]}'), "files", "path", "n", "m"), "path", "value")[0] == ("a", 3.0)
    sections = "File: a.py\n  Class: A\n    Total: 50%\nFile: b.py\n    Total: 7%\n"
    assert rows(readers.sectioned_metrics(text(spark, "  Lost: 1%\n" + sections), r"^File: (.+)$", r"^\s+(Total): (\d+)%$", "cohesion"), "path", "value") == [("a.py", 50.0), ("b.py", 7.0)]
    assert rows(readers.tree_ratio(text(spark, '{"statistics": {"total": {"percentage": 3.5}}}', "{}"), "$.statistics.total.percentage"), "unit", "value") == [("<tree>", 3.5)]
    assert rows(readers.tree_ratio(text(spark, "RESULT: passed (minimum: 80.0%, actual: 91.2%)"), pattern=r"actual: ([\d.]+)%"), "value") == [(91.2,)]


def test_snapshots_configurations_and_states(spark):
    snapshot = text(spark, '{"findings": [{"fingerprint": "f1", "kind": "risk", "label": "L"}], "labels": ["f1", "old"]}')
    assert rows(readers.baseline(snapshot), "fingerprint", "kind", "label") == [("f1", "risk", "L"), ("old", "label", "old")]
    status = spark.createDataFrame([("M\ta.py",), ("D\tgone.py",), ("R096\told.py\tnew.py",), ("A\tb.py",), ("",)], "line string")
    assert rows(readers.changed_paths(status), "path") == [("a.py",), ("b.py",), ("new.py",)] and rows(readers.renames(status), "old", "new") == [("old.py", "new.py")]
    assert readers.merged_settings([{"a": {"x": 1, "y": 2}, "l": [1], "exclude_additional": ["p"]}, {"a": {"y": 3}, "l": [2], "exclude_additional": ["q"]}]) == {"a": {"x": 1, "y": 3}, "l": [2], "exclude_additional": ["p", "q"]}
    assert readers.tightened({"a": 5, "b": 3}, {"a": 4}) == {"a": 4, "b": 3}
    with pytest.raises(ValueError, match="a, c"):
        readers.tightened({"a": 5}, {"a": 6, "c": 1})
    documents = text(spark, '{"schema": 1, "tool": "s", "score": 4.5}', '{"schema": 1, "tool": "t", "score": 4.5}', '{"schema": 0, "tool": "s", "score": 1}', "x", '{"schema": 1, "tool": "s", "score": 9}')
    assert [r["reason"] for r in readers.delegated_pillar(documents, "s").orderBy("file").collect()] == [None, "another tool", "schema too old", "no score", "score out of range"]


def test_banners_are_comments(spark):
    frame = spark.createDataFrame([(["# Code generated by x. DO NOT EDIT."],), (["x = 'code generated by'"],), (["", "// @generated"],), ([],)], "head array<string>")
    assert [r[0] for r in frame.select(readers.is_generated(frame["head"], ["code generated", "@generated"])).collect()] == [True, False, True, False]


def test_one_sarif_document(spark, tmp_path):
    found = spark.createDataFrame([("r2", "m", "b.py", 3, "fail"), ("r1", "n", "a.py", None, "warn"), ("r2", "o", "a.py", 9, "warn")], "rule string, message string, path string, line int, status string")
    sinks.sarif_document(found, f"file://{tmp_path}/out", "own")
    run = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1", "r2"] and run["tool"]["driver"]["name"] == "own"
    assert [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["level"]) for r in run["results"]] == [("a.py", "warning"), ("a.py", "warning"), ("b.py", "error")]
    cards = spark.createDataFrame([(4.0, 3.0, 5.0, "B")], "overall double, low double, high double, grade string")
    assert len(sinks.attestation(cards, "abc", "own").first()["digest"]) == 64
    assert rows(sinks.coverage_document(spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "tool string, outcome string")), "outcome", "tools") == [("x", ["a", "b"]), ("y", ["c"])]
