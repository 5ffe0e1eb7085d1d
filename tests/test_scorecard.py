"""The scorer on single summaries: what is unknown is priced, never clean; caps, gates and the fitted constant."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import calibration
from strataloom.operators import scorecard as sc

CLEAN = {
    "files": 500, "declarations": 1000, "production_declarations": 650, "file_band_pressure": 0.0, "declaration_band_pressure": 0.0, "duplicate_blocks": 0, "risk_findings": 0, "gate_failures": 0,
    "coupled_pairs": 0, "hotspots": 0, "files_changed": 50, "single_author_files": 0, "settled_files": 20, "test_files": 100, "dead_declarations": 0, "near_duplicates": 0, "divergent_concerns": 0,
    "file_failures": 0, "file_warnings": 0, "declaration_failures": 0, "declaration_warnings": 0, "coverage_percent": 90.0, "has_readme": True, "has_changelog": True, "has_docs": True, "unpaired_hotspot": False,
}
TYPES = {k: "boolean" if isinstance(v, bool) else "double" for k, v in CLEAN.items()}


def cards(spark, *changes: dict):
    rows = [tuple(None if (v := {**CLEAN, **c}[k]) is None else v if TYPES[k] == "boolean" else float(v) for k in CLEAN) + (i,) for i, c in enumerate(changes)]
    frame = spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in TYPES.items()) + ", i int")
    return sc.scorecard(frame).orderBy("i").collect()


def test_a_clean_project_and_its_caps(spark):
    clean, untested, unpaired, gated, failing = cards(spark, {}, {"test_files": 0}, {"unpaired_hotspot": True}, {"gate_failures": 1}, {"file_failures": 2})
    assert (clean["overall"], clean["low"], clean["high"], clean["grade"], clean["blockers"]) == (5.0, 5.0, 5.0, "A+", [])
    assert untested["c_testability"] == 2.0 and unpaired["c_testability"] == 4.0
    assert gated["grade"] != "A+" and gated["blockers"] == ["gates"] and failing["grade"] == "A"


def test_no_card_without_tests_or_full_evidence_is_an_a(spark):
    none, unknown, hidden, opted, young = cards(spark, {"test_files": 0}, {"test_files": None}, {"divergent_concerns": None, "has_docs": None}, {"coverage_percent": None}, {"settled_files": 0, "files_changed": 0})
    assert none["capped"] == "no tests" and unknown["capped"] == "unmeasured: test_presence" and hidden["capped"] == "unmeasured: documentation, idiom_consistency"
    assert not any(r["grade"].startswith("A") for r in (none, unknown, hidden))
    assert opted["capped"] is None and young["capped"] is None and opted["grade"] == young["grade"] == "A+"  # looked, and there was nothing to measure
    raised = cards(spark, {}, {"has_docs": None})
    assert [r["grade"] for r in raised] == ["A+", "B"]  # the floor alone would be an A


def test_hiding_an_input_never_raises_the_floor(spark):
    names = [k for k in CLEAN if k not in ("coverage_percent", "unpaired_hotspot")]
    worse = {"file_band_pressure": 0.2, "duplicate_blocks": 100, "dead_declarations": 9, "test_files": 3}
    base, *hidden = cards(spark, worse, *[{**worse, n: None} for n in names])
    assert all(r["low"] <= base["low"] for r in hidden) and all(r["low"] <= r["overall"] <= r["high"] for r in [base, *hidden])
    assert all(x is not None for r in hidden for x in (r["overall"], r["grade"]))


def test_what_has_no_population_leaves_both_sums(spark):
    none, unknown = cards(spark, {"settled_files": 0, "coverage_percent": None}, {"settled_files": None})
    assert none["low"] == none["high"] and unknown["low"] < unknown["high"]


@pytest.mark.parametrize("target", [4.0, 3.5])
def test_the_constant_brings_the_median_to_its_target(spark, target):
    rows = [tuple(float(v) if TYPES[k] == "double" else v for k, v in {**CLEAN, "file_band_pressure": 0.03 * i, "declaration_band_pressure": 0.05 * i, "duplicate_blocks": 60 * i, "risk_findings": 5 * i}.items()) for i in range(1, 10)]
    frame = spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in TYPES.items()))
    k = calibration.curve_constant(frame, target)
    again = frame.select("*", *[v.alias(f"a_{n}") for n, v in sc.aspects().items() if n not in sc.REFERENCES], *[sc.displayed(5 * k / (p / sc.REFERENCES[n] + k)).alias(f"a_{n}") for n, p in sc.pressures().items()])
    assert again.select(F.median(sc._overall(sc._categories(sc.UNKNOWN)))).first()[0] == pytest.approx(target, abs=0.1)
