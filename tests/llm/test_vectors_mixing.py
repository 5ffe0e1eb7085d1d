"""Vectors of repeated ids, and words that sources give to a mix, against brute force."""

import numpy as np
import pytest

from strataloom.llm import mixing, vectors
from strataloom.llm.queries import op5_mixing

SF = "/root/testdata/sf0.01"


def brute(rows, cosine=0.98):
    """rows: (vec_id, vector, label); links and smallest reachable id of each row."""
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if v and np.linalg.norm(v) else None for _, v, _ in rows]
    near = [[i != j and rows[i][2] == rows[j][2] and rows[i][2] is not None and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine for j in range(n)] for i in range(n)]
    least = [r[0] for r in rows]
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near[i][j]:
                    least[i] = least[j] = min(least[i], least[j])
    return sorted((rows[i][0], sum(near[i]), least[i]) for i in range(n))


def test_repeated_ids_keep_their_own_vectors(spark):
    a = [1.0, 0.0, 0.0]
    rows = [(1, a, 0), (2, [1.0, 0.05, 0.0], 0), (4, [2.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 1), (3, [0.0, 1.0, 0.01], 1), (3, [0.0, 0.0, 1.0], 0), (7, [0.0, 0.0, 0.0], 0), (8, a, None), (9, [1.0, 0.0], 0), (1, a, 0)]
    frame = spark.createDataFrame([(i, v, y, -1, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, node int, component string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(frame).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("pivots", [None, 5])
def test_clusters_of_every_density(spark, pivots):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * [0.02, 0.1, 0.25][i % 3]).tolist(), int(i % 2)) for i in range(150)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), pivots=pivots).collect())
    assert got == brute(rows)


def test_sources_reach_their_targets(spark):
    rows = op5_mixing(spark, SF).collect()
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(docs[r["doc_id"]], []).append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    for s, own in by.items():
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 * goal[s] + 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= max(0.01 * goal[s], 1)
        assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in own)
    again = {r["doc_id"]: r["taken"] for r in op5_mixing(spark, SF).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_few_and_long_documents(spark):
    """Where documents are long against their source, what is missed is less than the least document that could still be turned."""
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(1000, "a"), (10, "a"), (500, "b"), (400, "b"), (30, "b"), (7, None), (0, "c"), (2000, "d")])]
    docs = spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in rows] + [(99, None, "c", 1, "k")], "doc_id long, text string, source string, own int, key string")
    got = mixing.mix_digest(docs).collect()
    assert len(got) == len(rows) + 1 and sum(r["size"] for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert mixing.mix_digest(docs.limit(0)).count() == 0


def test_very_many_sources():
    dealt = mixing.split_quotas(np.full(200_000, 64), 2, 1)
    assert (dealt.sum(0) == 64).all() and abs(int(dealt[0].sum()) - 6_400_000) <= 1
