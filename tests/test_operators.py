import random

from pyspark.sql import functions as F

from strataloom.operators import bands, matching, scoring, series, text
from strataloom.operators.graph import connected_components


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (None, 5)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_coming_back_to_an_instrument_opens_a_segment(spark):
    scans = spark.createDataFrame([(1, i, k) for i, k in enumerate("AABBA")] + [(2, 0, None), (2, 1, None)], "u int, seq int, k string")
    out = series.segments(scans, ["u"], ["seq"], ["k"]).orderBy("u", "seq").collect()
    assert [r["segment"] for r in out] == [0, 0, 1, 1, 2, 0, 0]


def test_overlapping_intervals_are_indistinguishable(spark):
    rows = spark.createDataFrame([("a", 1, 3.0, 2.5, 3.5), ("a", 2, 3.2, 2.9, 3.6), ("b", 1, 1.0, 0.9, 1.1), ("b", 2, 2.0, 1.9, 2.1), ("c", 1, 1.0, 1.0, 1.0), ("d", 1, None, None, None), ("d", 2, 1.0, 1.0, 1.0)], "s string, q int, e double, l double, h double")
    got = {r["s"]: r["verdict"] for r in series.trajectory(rows, ["s"], ["q"], "e", "l", "h").collect()}
    assert got == {"a": "indistinguishable", "b": "improved", "c": "unknown", "d": "unknown"}


def test_clone_windows_count_both_places_in_one_file_and_skip_uniform_ones(spark):
    body = "\n".join(f"x{i} = {i}" for i in range(4))
    files = spark.createDataFrame([("a", body + "\n// note\n\n" + body), ("b", "\n".join(["same"] * 9))], "path string, content string")
    windows = text.clone_windows(text.source_lines(files), 4)
    assert sorted((r["path"], r["line_no"]) for r in windows.collect()) == [("a", 1), ("a", 7)]


def test_null_is_neither_ok_nor_zero(spark):
    row = spark.range(1).select(bands.status(F.lit(None).cast("int"), 1, 2).alias("s"), bands.band(F.lit(None).cast("int"), 1, 2).alias("b"), bands.status(F.lit(400), 400, 800).alias("edge"), bands.band(F.lit(801), 400, 800).alias("hard")).first()
    assert (row["s"], row["b"], row["edge"], row["hard"]) == (None, None, "ok", 0.75)


def test_matching_is_one_to_one_by_tiers(spark):
    cur = spark.createDataFrame([("f1", "d", "x"), ("f2", "d", "y"), ("f3", None, "z")], "fingerprint string, digest string, label string")
    old = spark.createDataFrame([("g1", "d", "q"), ("g2", "e", "y"), ("g3", None, "w")], "fingerprint string, digest string, label string")
    got = sorted(tuple(r) for r in matching.tiered_match(cur, old, [["digest"], ["label"]]).collect())
    assert got == [("f1", "g1", 1), ("f2", "g2", 2)]


def test_suffix_join_needs_one_answer(spark):
    paths = spark.createDataFrame([("b/c.py",), ("c.py",), ("x.py",)], "path string")
    tree = spark.createDataFrame([("a/b/c.py",), ("d/c.py",)], "path string")
    assert [tuple(r) for r in matching.suffix_join(paths, tree).collect()] == [("b/c.py", "a/b/c.py")]


def test_unknown_is_priced_and_never_raises_the_floor(spark):
    rows = [(1, "file_size", 3.0, "measured"), (1, "duplication", 4.0, "unknown"), (1, "test_presence", 1.0, "not_applicable")]
    got = scoring.overall(scoring.rollup(spark.createDataFrame(rows, "r int, aspect string, score double, state string"), ["r"]), ["r"]).first()
    assert got["low"] <= got["score"] <= got["high"]
    known = [(1, "file_size", 3.0, "measured"), (1, "duplication", 4.0, "measured")]
    assert got["low"] <= scoring.overall(scoring.rollup(spark.createDataFrame(known, "r int, aspect string, score double, state string"), ["r"]), ["r"]).first()["low"]
    letters = spark.range(1).select(scoring.letter(F.lit(4.9), [(F.lit(None), 0.0, 0.1)]).alias("x"), scoring.letter(F.lit(4.9)).alias("y")).first()
    assert tuple(letters) == ("B", "A+")


def test_pairs_of_commits_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from strataloom.operators import history

    rows = spark.range(600).selectExpr("id div 6 c", "id % 11 p")
    monkeypatch.setattr(history, "COUNTED", 50)
    got = history.coupling(rows, "c", "p", support=1, confidence=0.0)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
    assert sum(r["co_changes"] for r in got.collect()) == 100 * 15


def test_a_bootstrap_sends_no_picks_to_every_task(spark):
    from strataloom.operators import stats

    rows = spark.range(300).selectExpr("id % 2 g", "cast(id * 7 % 31 as double) v")
    got = stats.bootstrap_median(rows, "g", "v", draws=5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 2
