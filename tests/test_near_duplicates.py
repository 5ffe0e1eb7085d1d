"""Near duplicates: every run of words crosses one shuffle, and repeated or null keys stay right."""

import random
from itertools import combinations

from strataloom.plans import catalogue


def moved(spark) -> int:
    """Bytes shuffled, spilled and written so far."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in rows)


def best_partners(rows, k=6, holders=12, shared=3, threshold=0.8):
    sets = {}
    for key, text in rows:
        w = (text or "").split()
        if len(w) >= k:
            sets.setdefault(key, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    held = {}
    for key, own in sets.items():
        for s in own:
            held[s] = held.get(s, 0) + 1
    best = {}
    for a, b in combinations(sorted(x for x in sets if x is not None), 2):
        common = sets[a] & sets[b]
        if sum(held[s] <= holders for s in common) >= shared and (sim := len(common) / len(sets[a] | sets[b])) >= threshold:
            for own, other in ((a, b), (b, a)):
                best[own] = max(best.get(own, (0, 0)), (sim, -other))
    return {(min(own, -other), max(own, -other), round(sim, 6)) for own, (sim, other) in best.items()}


def test_equal_to_brute_force_with_repeated_and_null_keys(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choices(vocabulary, k=12))
    rows = []
    for i in range(120):
        if i % 3 and rows and rows[-1][1]:
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice((3, 6, 9, 40, 90))))
        rows.append((i, text if i % 4 else f"{common} \n {text}"))
    rows += [(i, rows[i + 1][1]) for i in range(0, 40, 5)]  # keys of two rows
    rows += [(None, rows[8][1]), (None, rows[8][1]), (None, None), (200, None), (201, "")]
    rows += [(300 + i, rows[50][1] + f" end{i % 2}") for i in range(13)]  # more holders than propose candidates
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalogue.near_duplicates(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == best_partners(rows)


def test_a_run_crosses_one_shuffle(spark, tmp_path):
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(300)]
    rows = [(2 * i + j, " ".join(w)) for i, w in enumerate(texts) for j in range(1 + (i % 5 == 0))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = moved(spark)
    assert len(catalogue.near_duplicates(spark, str(tmp_path)).collect()) == 60
    assert moved(spark) - before < 35 * sum(len(t.split()) for _, t in rows)
