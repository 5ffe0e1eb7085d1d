"""Resamples and fits of the curve's constant: against plain Python with the same digests, on small corpora and none."""

import hashlib
import statistics

from pyspark.sql import functions as F
from test_scorecard import CLEAN, TYPES

from strataloom.operators import calibration
from strataloom.operators import scorecard as sc

SCHEMA = ", ".join(f"{k} {t}" for k, t in TYPES.items()) + ", repo string"


def corpus(spark, n):
    rows = [{**CLEAN, "file_band_pressure": 0.03 * i, "declaration_band_pressure": 0.05 * (i % 4), "duplicate_blocks": 60 * i, "risk_findings": 5 * i, "test_files": 0 if i == 3 else 40} for i in range(1, n + 1)]
    return spark.createDataFrame([tuple(float(v) if TYPES[k] == "double" else v for k, v in r.items()) + (f"r{i:02}",) for i, r in enumerate(rows)], SCHEMA)


def picks(n, draw, seed):
    return [int(hashlib.md5(f"{seed}:{draw}:{j}".encode()).hexdigest()[:13], 16) % n for j in range(1, n + 1)]


def test_resamples_are_named_by_digests_and_keep_the_size(spark):
    rows = corpus(spark, 11)
    got = {(r["draw"], r["repo"]): r["w"] for r in calibration.resample(rows.repartition(3), "repo", 5, 9).collect()}
    want = {}
    for draw in range(1, 6):
        for i in picks(11, draw, 9):
            want[draw, f"r{i:02}"] = want.get((draw, f"r{i:02}"), 0) + 1
    assert got == want
    assert calibration.resample(rows.limit(0), "repo", 5).count() == 0


def test_weighted_medians_skip_nulls_and_split_even_numbers(spark):
    values = [("a", 1, 1.0, None), ("a", 2, 3.0, 4.0), ("a", 1, 9.0, None), ("b", 3, 2.0, None), ("b", 3, 7.0, None), (None, 1, 5.0, 5.0)]
    rows = spark.createDataFrame(values, "g string, w long, x double, y double")
    got = {(r["g"], r["of"]): r["median"] for r in calibration.weighted_medians(rows, "g", "w", ["x", "y"], parts=3).collect()}
    for g in ("a", "b"):
        assert got[g, "x"] == statistics.median([x for k, w, x, _ in values if k == g for _ in range(w)])
    assert got["a", "y"] == 4.0 and ("b", "y") not in got


def test_each_draw_is_fitted_under_its_own_references(spark):
    rows = corpus(spark, 11)
    frame = calibration.refits(rows, "repo", 4, 9, target=3.9)
    fits = {r["draw"]: r for r in frame.collect()}
    assert sorted(fits) == [0, 1, 2, 3, 4] and all(r["n"] == 11 for r in fits.values())
    held = [r.asDict() for r in rows.orderBy("repo").collect()]

    def overall(chosen, refs, c):
        pressures = sc.pressures()
        curves = [sc.displayed(5 * c / (p / refs[k] + c)).alias(f"a_{k}") if refs[k] else F.lit(None).cast("double").alias(f"a_{k}") for k, p in pressures.items()]
        scored = spark.createDataFrame(chosen, rows.schema).select("*", *curves, *[v.alias(f"a_{k}") for k, v in sc.aspects().items() if k not in pressures])
        return statistics.median(r[0] for r in scored.select(sc._overall(sc._categories(sc.UNKNOWN))).collect())

    for draw in (2,):
        chosen = [held[i] for i in picks(11, draw, 9)]
        assert abs(fits[draw]["r_file_size"] - statistics.median(r["file_band_pressure"] for r in chosen)) < 1e-4
        refs = {k: fits[draw][f"r_{k}"] for k in sc.REFERENCES}
        assert refs["policy_gates"] == sc.REFERENCES["policy_gates"]
        c = fits[draw]["constant"]
        assert overall(chosen, refs, c * 0.5) < 3.9 <= overall(chosen, refs, c + 0.05) + 0.1
        assert abs(overall(chosen, refs, c) - 3.9) <= 0.05 + 1e-9
    span = calibration.interval(frame).first()
    drawn = sorted(fits[k]["constant"] for k in range(1, 5))
    assert (span["draws"], span["measured"], span["low"], span["high"]) == (4, fits[0]["constant"], drawn[0], drawn[3])


def test_small_corpora_have_no_constant(spark):
    few = calibration.refits(corpus(spark, 5), "repo", 2)
    assert [r["constant"] for r in few.collect()] == [None] * 3
    assert calibration.interval(few).first()["low"] is None
    assert calibration.refits(corpus(spark, 5).limit(0), "repo", 2).count() == 0
    assert calibration.curve_constant(corpus(spark, 5)) is None


def test_rows_that_no_longer_change_are_not_scored_again(spark, monkeypatch):
    scored, real = [], calibration._tenths

    def spy(rows, **at):
        if "t" in at:
            scored.append(rows.filter("slot = 1").count())
        return real(rows, **at)

    monkeypatch.setattr(calibration, "_tenths", spy)
    fits = calibration.refits(corpus(spark, 40), "repo", 2)
    assert fits.count() == 3 and len(scored) == len(calibration.DEPTHS) + 1
    assert scored[0] > 60 and scored[-2] * 10 < scored[0] > scored[-1]
