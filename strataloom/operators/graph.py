"""Connected components by alternating star contraction, entirely on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged, unstaged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): ``component`` is the smallest node that is reachable over ``edges``.

    Large-star and small-star steps alternate: each node's neighbours are hung onto the smallest one, first those
    above it, then those below. Both are a grouped minimum, which is pre-aggregated, and a join back; AQE splits the
    join where one node has very many neighbours. The number of rounds grows with the logarithm of the longest path.
    Loops, repeated and null edges add nothing; an empty table gives an empty result. Raises if ``rounds`` is reached.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now = staged(now, "cc")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        after = staged(small, "cc")
        unstaged(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Settled: every edge leads from a node to its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
