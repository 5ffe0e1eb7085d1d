"""The work order: builders, and worths equal to scoring the changed summary again."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import scorecard as sc
from strataloom.operators import workorder as wo

FIELDS = {
    "files": 60.0, "declarations": 400.0, "production_declarations": 300.0, "file_band_pressure": 0.1, "declaration_band_pressure": 0.1, "duplicate_blocks": 30.0, "risk_findings": 4.0, "gate_failures": 0.0,
    "coupled_pairs": 1.0, "hotspots": 2.0, "files_changed": 50.0, "single_author_files": 3.0, "settled_files": 20.0, "test_files": 10.0, "dead_declarations": 3.0, "near_duplicates": 9.0, "divergent_concerns": 2.0,
    "file_failures": 1.0, "file_warnings": 2.0, "declaration_failures": 5.0, "declaration_warnings": 6.0, "coverage_percent": None, "has_readme": True, "has_changelog": True, "has_docs": False, "unpaired_hotspot": False,
}
DDL = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in FIELDS.items()) + ", p string"
CHANGES = {"base": {}, "clean": {"duplicate_blocks": 0.0, "risk_findings": 0.0, "dead_declarations": 0.0, "near_duplicates": 0.0, "divergent_concerns": 0.0}, "unknown": {"duplicate_blocks": None, "dead_declarations": None, "test_files": None}, "untested": {"test_files": 0.0}, "empty": {"files": 0.0, "production_declarations": 0.0}, "young": {"settled_files": 0.0, "files_changed": 0.0}}
COUNTS = {"oversized-declaration": 5, "oversized-file": 1, "duplicate-block": 12, "near-duplicate": 9, "dead-code": 3, "risk-pattern": 4, "competing-libraries": 2, "unpaired-hotspot": 1, "semantic-policy": 2}


def summaries(spark, changes):
    return spark.createDataFrame([tuple({**FIELDS, **c}.values()) + (p,) for p, c in changes.items()], DDL)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(p, c, f"src/{i}.py", i, c, float(i), None) for p in CHANGES for c, n in COUNTS.items() for i in range(n)]
    return spark.createDataFrame(rows, "p string, class string, path string, line long, label string, severity double, sites array<string>")


def overall(spark, changes):
    return {r["p"]: r["overall"] for r in sc.scorecard(summaries(spark, changes)).collect()}


def test_worths_equal_scoring_again(spark, items):
    got = {(r["p"], r["class"]): (r["class_count"], r["delta"], r["class_delta"]) for r in wo.worths(items, sc.scorecard(summaries(spark, CHANGES)), ["p"]).collect()}
    base = overall(spark, CHANGES)
    again, keys = {}, {}
    for p, change in CHANGES.items():
        for cls, _, _, counter, aspect in wo.CLASSES:
            for m in (1, COUNTS.get(cls, 0)) if cls in COUNTS and aspect else ():
                now = {**FIELDS, **change}[counter]
                keys[f"{p}/{cls}/{m}"] = (p, cls, m)
                again[f"{p}/{cls}/{m}"] = {**change, counter: None if now is None else max(0.0, now - m)}
    scored = overall(spark, again)
    want = {(p, c): (n, 0.0, 0.0) for p in CHANGES for c, n in COUNTS.items()}
    for name, (p, cls, m) in keys.items():
        gain = round(max(0.0, scored[name] - base[p]), 3)
        n, one, all_ = want[p, cls]
        want[p, cls] = (n, gain if m == 1 else one, gain if m == n else all_)
    assert got == want and any(v[2] > v[1] > 0 or v[2] > 0 for v in got.values())


def test_combined_is_a_scoring_of_all_changes(spark, items):
    cleared = {p: {**c, **{k[3]: None if {**FIELDS, **c}[k[3]] is None else max(0.0, {**FIELDS, **c}[k[3]] - COUNTS[k[0]]) for k in wo.CLASSES if k[4]}} for p, c in CHANGES.items()}
    base, after = overall(spark, CHANGES), overall(spark, cleared)
    got = {r["p"]: r["gain"] for r in wo.combined(items, sc.scorecard(summaries(spark, CHANGES)), ["p"]).collect()}
    assert got == {p: round(max(0.0, after[p] - base[p]), 3) for p in CHANGES}


def test_order_and_worth_of_items(spark, items):
    rows = wo.work_order(items, sc.scorecard(summaries(spark, CHANGES)), ["p"]).filter("p = 'base'").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1)) and not {r["band"] for r in rows} & {"reconsider"}
    ranks = [wo.BANDS.index(r["band"]) for r in rows]
    assert ranks == sorted(ranks) and all((a["band"], -a["class_delta"]) <= (b["band"], -b["class_delta"]) or a["band"] != b["band"] for a, b in zip(rows, rows[1:]))
    worths = [(r["class"], r["worth"]) for r in rows if r["worth"] is not None]
    assert len(worths) == len({c for c, _ in worths}) and all(w > 0 for _, w in worths)
    assert {r["class"] for r in wo.work_order(items, sc.scorecard(summaries(spark, CHANGES)), ["p"], hide=()).collect()} == set(COUNTS)


def test_builders(spark):
    make = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    side = "struct<path string, start int, name string>"
    items = wo.together(
        wo.of_declarations(make("path string, name string, start int, lines int, cyclomatic int", ("a.py", "f", 3, 90, 5), (None, "g", 1, 1, 1))),
        wo.of_files(make("path string, lines int", ("b.py", 900))),
        wo.of_clones(make("path string, line long, lines int, locations array<string>", ("a.py", 1, 8, ["a.py:1", "b.py:7"]), ("c.py", 2, None, ["c.py:2"]))),
        wo.of_similar(make(f"left {side}, right {side}, similarity double", (("a.py", 1, "f"), ("b.py", 5, "g"), 0.9))),
        wo.of_unused(make("path string, name string, start int, lines int", ("a.py", "_x", 4, None))),
        wo.of_risks(make("path string, line int, rule string", ("a.py", 6, "debt"), ("", 7, "debt"))),
        wo.of_unpaired(make("path string, line int, name string, lines int", ("a.py", None, None, 300))),
        wo.of_idioms(make("concern string, package string, files long, example string", ("orm", "knex", 3, "k.ts"), ("orm", "prisma", 1, "p.ts"), ("http", "got", 1, "g.ts"))),
        wo.of_semantic(make("kind string, path string, line int, rule string, message string", ("policy", "t.py", 1, "r", None), ("candidate", "t.py", 1, "r", "m"), ("universal", None, 1, "r", "m"))),
    )
    got = {(r["class"], r["path"], r["line"], r["label"], r["severity"], tuple(r["sites"] or ())) for r in items.collect()}
    assert got == {
        ("oversized-declaration", "a.py", 3, "f", 110.0, ()), ("oversized-file", "b.py", None, "b.py", 900.0, ()), ("duplicate-block", "a.py", 1, "duplicated block", 8.0, ("a.py:1", "b.py:7")),
        ("duplicate-block", "c.py", 2, "duplicated block", 1.0, ()), ("near-duplicate", "a.py", 1, "f is like g", 0.9, ("a.py:1", "b.py:5")), ("dead-code", "a.py", 4, "_x", 1.0, ()), ("risk-pattern", "a.py", 6, "debt", 1.0, ()),
        ("unpaired-hotspot", "a.py", None, "a.py", 300.0, ()), ("competing-libraries", "p.ts", None, "orm: converge on knex", 2.0, ()), ("semantic-policy", "t.py", 1, "r", 1.0, ()),
    }
