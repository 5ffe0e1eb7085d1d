"""Multiple-instance learning against direct sums: counts, choice of features, gradient and score."""

import math

import numpy as np
import pyarrow as pa

from strataloom.llm import toxicity


def likelihood(rows, theta):
    """Of documents given as (label, weight, [(times, columns)])."""
    total = 0.0
    for y, w, bag in rows:
        clean = math.log1p(-1 / (1 + math.exp(-theta[-1])))
        for times, columns in bag:
            clean += times * math.log1p(-1 / (1 + math.exp(-(theta[-2] + sum(theta[c] for c in columns)))))
        total += w * (math.log(-math.expm1(clean)) if y else clean)
    return total


def test_gradient():
    rng = np.random.default_rng(5)
    theta = rng.normal(size=7)
    rows = [(int(rng.integers(0, 2)), float(rng.uniform(0.5, 2)), [(int(rng.integers(1, 4)), rng.integers(0, 5, rng.integers(0, 4)).tolist()) for _ in range(rng.integers(0, 5))]) for _ in range(12)]
    ints = pa.list_(pa.int32())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), *(pa.array(x, ints) for x in ([[len(c) for _, c in r[2]] for r in rows], [[t for t, _ in r[2]] for r in rows], [[c for _, cs in r[2] for c in cs] for r in rows]))],
        ["y", "w", "sizes", "times", "columns"],
    )
    got = toxicity.slope(batch, theta)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-5
        assert abs(got[i] - (likelihood(rows, theta + step) - likelihood(rows, theta - step)) / 2e-5) < 1e-4


def test_score_and_worst_sentence():
    # A short word is its own beginning twice.
    model = toxicity.Model({"bad": 3.0, "bad*": 1.0, "good": -2.0}, -3.0, 0.01)
    p = lambda z: 1 / (1 + math.exp(-z))
    score, start, end, worst = model.score("A good day. Bad, bad thing! So.")
    assert abs(score - (1 - 0.99 * (1 - p(-5)) * (1 - p(2)) * (1 - p(-3)))) < 1e-12
    assert "A good day. Bad, bad thing! So."[start:end] == " Bad, bad thing" and abs(worst - p(2)) < 1e-12
    assert model.score("")[1:] == (-1, -1, 0.0)


def test_counts_and_choice(spark):
    texts = [("vile vile thing here", 1), ("vile words", 1), ("plain words here", 0), ("", 0)] * 3
    docs = spark.createDataFrame(texts, "text string, y int").repartition(3)
    got = {r["feature"]: (r["n0"], r["n1"]) for r in toxicity.counted(docs).collect()}
    assert got["vile"] == (0, 6) and got["words"] == (3, 3) and got["here"] == (3, 3) and got["word*"] == (3, 3)
    names = toxicity.chosen(toxicity.counted(docs), {0: 6, 1: 6}, 2)
    assert names == sorted(names) and len(names) <= 2


def test_long_texts_and_labels(spark):
    """A sentence in a very long text decides; repeated labels and rows, labels without a text and texts without a label do no harm."""
    rows = [(i, ("calm words of day. " * 400) + ("you vile fool! " if i % 3 == 0 else "fine then. ") + "more calm words. ") for i in range(240)]
    docs = spark.createDataFrame([*rows, rows[0], (900, None), (None, "calm")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(0, 0), (7777, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["predicted"] == (r["doc_id"] % 3 == 0)
            if r["predicted"]:
                assert "vile" in rows[r["doc_id"]][1][r["worst_start"] : r["worst_end"]]
