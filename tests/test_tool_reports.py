"""The source of tools' reports: cut lines, documents, refusals, filters in the scan."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from strataloom.sources.tool_reports import Piece, Reader, tool_reports


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_every_line_is_read_once_however_files_are_cut(spark, tmp_path, step):
    lines = [f"src/f{i}.py:{i + 1}: message é {i}" for i in range(40)] + ["noise", "", "a.py:x: no", "b.py:7:3: with a column\r", "last.py:9: no end"]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "_hidden.txt").write_text("x.py:1: hidden\n")
    got = tool_reports(spark, str(tmp_path), "text", tool="t", concept="style", splitBytes=max(step, 100))
    want = [(f"src/f{i}.py", i + 1, f"message é {i}") for i in range(40)] + [("b.py", 7, "with a column"), ("last.py", 9, "no end")]
    assert rows(got, "path", "line", "message") == sorted(want, key=str)
    reader = Reader({"path": str(tmp_path), "kind": "text", "splitBytes": step}, got.schema, False)
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(found) == len(want) and (step > 1 or len(reader.partitions()) > 500)


def test_json_lines_and_documents(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('progress\n{"file": "a.py", "at": {"row": 3}, "text": "x", "symbol": "", "code": "E1"}\n{"file": 5, "at": 1}\n{broken\n[1]\n{}\n')
    got = tool_reports(spark, f"file://{tmp_path}/l.jsonl", "jsonl", keys="file,at.row,text")
    assert rows(got, "path", "line", "message", "rule") == [("", None, "", None), ("5", None, "", None), ("a.py", 3, "x", "E1")]
    (tmp_path / "d.json").write_text(json.dumps({"out": {"items": [{"path": "p", "line": "12", "message": "m", "check_name": "c"}, {"path": None, "line": 0}]}}))
    got = tool_reports(spark, str(tmp_path / "d.json"), "json", items="out.items")
    assert rows(got, "path", "line", "message", "rule", "tool") == [("", None, "", None, "json"), ("p", 12, "m", "c", "json")]


def test_documents_that_are_refused_are_named_and_the_others_read(spark, tmp_path):
    (tmp_path / "ok.xml").write_text('<checkstyle><file name="A.java"><error line="4" message="m" source="rule.X" severity="error"/><error line="0" message=""/></file></checkstyle>')
    (tmp_path / "bomb.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><checkstyle><file name="&a;"/></checkstyle>')
    (tmp_path / "cut.xml").write_text("<checkstyle><file")
    got = tool_reports(spark, str(tmp_path), "checkstyle", tool="cs")
    assert rows(got, "path", "line", "rule", "level", "message") == [("A.java", 4, "rule.X", "error", "m"), ("A.java", None, None, None, "")]
    refused = tool_reports(spark, str(tmp_path), "checkstyle", refusals="true")
    assert [(r["file"].rsplit("/", 1)[1], r["reason"]) for r in refused.orderBy("file").collect()] == [("bomb.xml", "declares a document type or entities"), ("cut.xml", "not read as checkstyle")]
    with pytest.raises(Exception, match="unknown kind"):
        tool_reports(spark, str(tmp_path), "xls").collect()
    with pytest.raises(Exception, match="nowhere"):
        tool_reports(spark, str(tmp_path / "nowhere"), "text").collect()


def test_filters_reach_the_scan(spark, tmp_path):
    for n in range(3):
        results = [{"ruleId": f"R{i % 2}", "message": {"text": f"m{i}"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f"src/{n}/{i}.py"}, "region": {"startLine": i + 1}}}]} for i in range(6)] + [{}]
        (tmp_path / f"{n}.sarif").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": f"tool{n}"}}, "results": results}, {"results": None}]}))
    all_ = tool_reports(spark, str(tmp_path), "sarif")
    assert all_.count() == 21 and rows(all_.filter("rule = 'unknown'"), "path", "line", "level", "message") == [("", 1, "warning", "")] * 3
    one = all_.filter((F.col("tool") == "tool1") & F.col("rule").isin("R1", "R7") & F.col("path").startswith("src/") & (F.col("line") > 2))
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = " ".join(x for x in plan.splitlines() if "Filter (" in x)
    assert "line" in filters and "tool1" not in filters and "R7" not in filters and "src/" not in filters
    assert rows(one, "path", "line") == [("src/1/3.py", 4), ("src/1/5.py", 6)]
    assert all_.filter("tool = 'nobody'").count() == 0 and all_.filter(F.col("tool").isNull()).count() == 0

    reader = Reader({"path": str(tmp_path), "kind": "sarif"}, all_.schema, False)
    kept = [EqualTo(("file",), f"{tmp_path}/2.sarif"), GreaterThan(("line",), 3)]
    assert list(reader.pushFilters(kept)) == kept[1:]
    assert [d[0].rsplit("/", 1)[1] for p in reader.partitions() for d in p.documents] == ["2.sarif"]
    assert len(Reader({"path": str(tmp_path), "kind": "sarif", "splitBytes": 10}, all_.schema, False).partitions()) == 3
    lines = Reader({"path": str(tmp_path), "kind": "text", "tool": "a"}, all_.schema, False)
    list(lines.pushFilters([EqualTo(("tool",), "b")]))
    assert lines.partitions() == [Piece()]
