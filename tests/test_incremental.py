"""A changing tree: rows equal to those of a full run, and only new texts parsed."""

import pytest
from pyspark.sql import functions as F

from strataloom.functions import declarations as recognisers
from strataloom.operators import code, incremental

FIRST = [("src/a.py", "def a(x):\n    if x:\n        return 1\n"), ("src/b.go", "func B(x int) int {\n\treturn x\n}\n"), ("src/c.py", "x = 1\n"), ("src/d.py", None), ("src/e.js", "function a(x) { return x }\n"), ("src/copy.py", "def a(x):\n    if x:\n        return 1\n")]
THEN = [("moved/a.py", FIRST[0][1]), ("src/b.go", "func B(x int) int {\n\tif x > 1 {\n\t\treturn 2\n\t}\n\treturn x\n}\n"), FIRST[2], ("src/new.py", "def n():\n    pass\n"), ("src/a.go", FIRST[4][1])]


def tree(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def plain(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def test_a_second_run_parses_what_changed_and_equals_a_full_one(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    first = incremental.declarations(tree(spark, FIRST), store)
    assert plain(first) == plain(code.declarations(tree(spark, FIRST)))
    seen = spark.sparkContext.accumulator(0)
    own = recognisers.measured

    def watched(path, text):
        seen.add(1)
        return own(path, text)

    monkeypatch.setattr(recognisers, "measured", watched)
    second = incremental.declarations(tree(spark, THEN), store)
    parsed = seen.value
    monkeypatch.undo()
    assert plain(second) == plain(code.declarations(tree(spark, THEN)))
    assert parsed == 3  # the changed one, the new one, and the text that became another language; neither the moved nor the unchanged one
    stored = spark.read.parquet(f"{store}/gen=1")
    assert stored.select("mark").distinct().count() == 5  # what is no longer in the tree is gone
    assert plain(incremental.declarations(tree(spark, []), store)) == []


def test_generations_of_other_code_or_of_broken_runs_are_not_read(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    incremental.declarations(tree(spark, FIRST), store, digest="a" * 64)
    assert incremental.generations(spark, store, "a" * 64) == [0] and incremental.generations(spark, store, "b" * 64) == []
    # A run that broke before its mark: its rows are wrong, and nobody reads them.
    spark.read.parquet(f"{store}/gen=0").withColumn("name", F.lit("wrong")).write.parquet(f"{store}/gen=1")
    got = incremental.declarations(tree(spark, FIRST), store, digest="a" * 64)
    assert plain(got) == plain(code.declarations(tree(spark, FIRST))) and incremental.generations(spark, store, "a" * 64) == [0, 2]
    with pytest.raises(FileExistsError):
        incremental._commit(spark.range(1), store, 2, "a" * 64)
    incremental.declarations(tree(spark, FIRST[:1]), store, digest="b" * 64)
    incremental.forget(spark, store)
    assert incremental.generations(spark, store, "a" * 64) == [2] and incremental.generations(spark, store, "b" * 64) == [3]
    assert sorted(p.name.split(".")[0] for p in (tmp_path / "store").iterdir() if p.is_dir()) == ["gen=2", "gen=3"]


def test_no_join_of_digests_sends_a_side_to_every_task(spark, tmp_path):
    trees = spark.range(40).selectExpr("concat('a', id, '.py') path", "concat('def f', id, '():\n    pass\n') text")
    store = f"file://{tmp_path}/store"
    incremental.declarations(trees.limit(20), store)
    rows = incremental.declarations(trees, store)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 40
