"""The sieve of odd sketches on pairs at the least similarity."""

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import minhash


def test_sieve_keeps_long_pairs_at_the_threshold(spark):
    rng, functions, rows, size = np.random.default_rng(4), minhash._functions(), [], 18000
    for i in range(150):
        x = rng.integers(0, 1 << 64, size * 10 // 9, dtype=np.uint64)
        own = [np.unique(s) for s in (x[:size], x[size // 9 :])]  # 8 of 10 parts are common
        sketches = [minhash.signature(s, functions)[1:] for s in own]
        rows.append((i, *[([int(v) for v in odd], filled, len(s)) for s, (odd, filled) in zip(own, sketches)]))
    part = "struct<odd:array<long>,filled:array<int>,n:long>"
    pairs = spark.createDataFrame(rows, f"i int, a {part}, b {part}")
    kept = pairs.filter(minhash.may_reach(F.col("a"), F.col("b"), 0.8, 3.0)).count()
    assert kept >= 147  # 0.2 of 150 are beyond three standard errors
