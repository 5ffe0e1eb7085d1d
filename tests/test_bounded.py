"""Bounded writes: every refusal, whole replacements, and documents that no task holds."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strataloom.sources import bounded, sinks
from strataloom.sources.bounded import PathNotAllowed


def hidden(folder):
    return sorted(p.name for p in folder.rglob(".*") if not p.name.endswith(".crc"))


def test_files_are_replaced_whole_and_stay_below_the_root(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    (root / "sub").mkdir(parents=True)
    outside.mkdir()
    bounded.write_text(spark, f"file://{root}", "a/b/report.json", '{"n": 1}', json_only=True)
    bounded.write_text(spark, f"file://{root}", f"{root}/a/b/report.json", '{"n": 2}', json_only=True)
    assert json.loads((root / "a/b/report.json").read_text()) == {"n": 2} and hidden(root) == []
    (root / "README.md").write_text("mine")
    (root / "link").symlink_to(outside)
    (root / "file_link.json").symlink_to(outside / "x.json")
    os.link(root / "README.md", outside / "same")
    for target, why in [("README.md", "no JSON"), ("../outside/x.json", "outside"), (str(outside / "x.json"), "not below"), ("link/x.json", "a link"), ("file_link.json", "a link"), ("sub", "no regular"), ("README.md/x.json", "no folder"), ("", "not below")]:
        with pytest.raises(PathNotAllowed, match=why):
            bounded.write_text(spark, f"file://{root}", target, "{}", json_only=True)
    assert (root / "README.md").read_text() == "mine" and list(outside.iterdir()) == [outside / "same"]
    bounded.write_text(spark, f"file://{root}", "README.md", "new")  # another file under the name; what the old one was linked to stays
    assert (outside / "same").read_text() == "mine" and (root / "README.md").read_text() == "new"

    def broken():
        yield b"half"
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        bounded.write_text(spark, f"file://{root}", "README.md", broken())
    assert (root / "README.md").read_text() == "new" and hidden(root) == []


def test_tables_replace_their_own_alone(spark, tmp_path):
    root = f"file://{tmp_path}"
    for n in (3, 5):
        place = bounded.write_table(spark.range(n), root, "out/t", "numbers")
        assert spark.read.parquet(place).count() == n
    with pytest.raises(PathNotAllowed, match="no letters"):
        bounded.write_table(spark.range(1), root, "out/t", "letters")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    for target in ("src", "src/a.py"):
        with pytest.raises(PathNotAllowed):
            bounded.write_table(spark.range(1), root, target, "numbers")
    with pytest.raises(Exception, match="divide|DIVIDE"):
        bounded.write_table(spark.range(3).select(F.expr("1 div (id - 1)").alias("x")), root, "out/t", "numbers")
    assert spark.read.parquet(place).count() == 5 and hidden(tmp_path) == []
    (tmp_path / "out/t").rename(tmp_path / "out/.t.before")  # a run that ended between its two renames
    assert bounded.settle(spark, root, "out/t", "numbers") and spark.read.parquet(place).count() == 5
    assert not bounded.settle(spark, root, "out/u", "numbers")


def test_a_log_takes_records_and_is_not_put_into_other_folders(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([("c1", 4.0), ("c2", None)], "commit string, score double")
    for _ in range(2):
        place = bounded.append_records(rows, root, "log")
    assert spark.read.json(place).count() == 4
    (tmp_path / "old").mkdir()
    (tmp_path / "old/h.jsonl").write_text('{"commit": "c0", "score": 1}\n\n')
    bounded.append_records(rows, root, "old")
    assert spark.read.json(f"{root}/old").filter("commit is not null").count() == 3
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text("text\n")
    (tmp_path / "data.json").write_text("{}")
    for target in ("notes", "data.json", "../x"):
        with pytest.raises(PathNotAllowed):
            bounded.append_records(rows, root, target)
    assert [p.name for p in (tmp_path / "notes").iterdir()] == ["a.md"]
    bounded.write_table(rows, root, "t", "numbers")
    with pytest.raises(PathNotAllowed):
        bounded.append_records(rows, root, "t")


def test_documents_are_joined_from_ranges(spark, tmp_path):
    rows = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("k")).withColumn("value", F.concat(F.lit("é line\n "), F.col("k").cast("string"), F.repeat(F.lit("x"), F.lit(300))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        place = bounded.ordered_document(rows, ["k"], f"file://{tmp_path}", "doc/out.txt", head="[", foot="]", between=", ")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = (tmp_path / "doc/out.txt").read_text()
    assert place.endswith("doc/out.txt") and text == "[" + ", ".join(f"é line\n {k}" + "x" * 300 for k in range(20000)) + "]"  # 6 MB in parts of a MB and over
    assert hidden(tmp_path) == []
    bounded.ordered_document(rows.limit(0), ["k"], f"file://{tmp_path}", "doc/out.txt", head="[", foot="]")
    assert (tmp_path / "doc/out.txt").read_text() == "[]"


def test_a_sarif_document_in_order(spark, tmp_path):
    rows = [("R2", "m\n\"q\"", "b.py", 3, "fail"), ("R1", "a", "a.py", None, "warn"), ("R1", "c", None, 0, None)]
    frame = spark.createDataFrame(rows, "rule string, message string, path string, line long, status string")
    sinks.sarif_document(frame, f"file://{tmp_path}/out", "audit")
    run = json.loads((tmp_path / "out/part-00000.sarif").read_text())["runs"][0]
    assert run["tool"]["driver"] == {"name": "audit", "rules": [{"id": "R1"}, {"id": "R2"}]}
    assert [(r["ruleId"], r["level"], r["message"]["text"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in run["results"]] == [("R1", "warning", "c", 1), ("R1", "warning", "a", 1), ("R2", "error", 'm\n"q"', 3)]
    sinks.sarif_document(frame.limit(0), f"file://{tmp_path}/out", "audit")
    assert json.loads((tmp_path / "out/part-00000.sarif").read_text())["runs"][0]["results"] == []
