"""Groups from buckets of candidates: who shares a bucket is compared, who passes is linked, without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import released, staged, unstaged


def link_buckets(buckets: DataFrame, traits: DataFrame, close: Callable[[Column, Column], Column], near: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], turns: int = 2, finer: Callable[[Column], Column] | None = None, sift: bool = False) -> DataFrame:
    """(node, component) under the links that ``verify`` leaves of the pairs of nodes that share a bucket.

    ``buckets``: (key, node, m), m a small number of the node; a repeated row costs time, no more. ``traits``: (node, s).
    ``close`` (on two m) and ``near`` (on two s): conditions that every linked pair
    meets; they are part of the joins, so that no other pair becomes a row. ``verify``: from (a, b), which are near, to
    those of them that are linked. ``finer``: from m to an array of marks of which two near nodes share one at least;
    buckets of several nodes are split by it.

    The components are those of comparing every pair in every bucket, yet most pairs never arise:

    - in each bucket the nodes meet its heaviest one (weight: the sizes of all buckets that a node is in; what
      copies were made from shares more keys with them than they do among themselves), and each node is compared with
      that one of the nodes it met which shares most buckets with it;
    - in ``turns`` rounds the nodes outside the largest component of a bucket meet a member of that one, another in every
      bucket and round, and each is compared with the one that it met most often (with ``sift``: most often of those that are near);
    - a bucket whose nodes are all in one component by then is done, however large it is;
    - in the others, the nodes outside the largest component are compared with all nodes of other components, and all
      that are near and were not compared yet are verified.

    So the rows of pairs grow with the number of nodes, and in the last step with the near pairs that the rounds left.
    """
    spark = buckets.sparkSession
    left, right = traits.select(F.col("node").alias("a"), F.col("s").alias("_sa")), traits.select(F.col("node").alias("b"), F.col("s").alias("_sb"))

    def repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        sizes = staged(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        return sizes, staged(rows.join(sizes.select("key"), "key"), "buckets")

    def best(met: DataFrame, sift: bool) -> DataFrame:
        """Of (a, b, weight) for each a the b of most rows, then of most weight; (a, b) in order, without the pairs that aren't near."""
        counted = met.groupBy("a", "b").agg(F.count("*").alias("times"), F.max("weight").alias("weight"))
        if sift:
            counted = counted.join(left, "a").join(right, "b").filter(near(F.col("_sa"), F.col("_sb"))).select("a", "b", "times", "weight")
        picked = counted.groupBy("a").agg(F.max(F.struct("times", "weight", "b")).alias("top")).select(F.least("a", "top.b").alias("a"), F.greatest("a", "top.b").alias("b")).distinct()
        return staged(picked if sift else picked.join(left, "a").join(right, "b").filter(near(F.col("_sa"), F.col("_sb"))).select("a", "b"), "near")

    sizes, shared = repeated(buckets)
    released(spark)
    if finer is not None:
        coarse = sizes, shared
        sizes, shared = repeated(shared.select("node", "m", "key", F.explode(finer(F.col("m"))).alias("mark")).select(F.xxhash64("key", "mark").alias("key"), "node", "m"))
        for x in coarse:
            unstaged(x)
    weights = shared.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = shared.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "m")).alias("hub"))
    met = shared.join(hubs, "key").filter((F.col("node") != F.col("hub.node")) & close(F.col("m"), F.col("hub.m")))
    done = best(met.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("hub.weight").alias("weight")), False)
    released(spark)
    links = staged(verify(done), "links")
    released(spark)
    comps = connected_components(links)
    rows = shared
    for turn in range(turns + 1):
        last = turn == turns
        placed = staged(rows.select("key", "node", "m").join(comps, "node", "left").select("key", "node", "m", F.coalesce("component", "node").alias("comp")), "placed")
        by = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max_by(F.struct("node", "m"), F.xxhash64("node", "key", F.lit(turn))).alias("mid"))
        open_ = by.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "comp", "mid")).alias("top")).filter("parts > 1").select("key", F.col("top.comp").alias("main"), F.col("top.mid").alias("mid"))
        members = placed.join(open_, "key")
        if not last:
            members = staged(members, "open")
            met = members.filter((F.col("comp") != F.col("main")) & close(F.col("m"), F.col("mid.m")))
            found = best(met.select(F.col("node").alias("a"), F.col("mid.node").alias("b"), F.lit(0).alias("weight")), sift)
            found = staged(found.join(done, ["a", "b"], "left_anti"), "near")
            released(spark)
        else:
            # Both sides have the same columns and no filter of their own, so that one exchange serves both. It is Spark's
            # own, whose large partitions AQE splits: a bucket that holds very many nodes does not stay in one task.
            held = members.join(traits, "node").select("key", "node", "m", "comp", "main", "s")
            x = held.select(F.col("key").alias("xk"), F.col("node").alias("x"), F.col("m").alias("xm"), F.col("comp").alias("xc"), F.col("main").alias("xmain"), F.col("s").alias("xs"))
            y = held.select(F.col("key").alias("yk"), F.col("node").alias("y"), F.col("m").alias("ym"), F.col("comp").alias("yc"), F.col("main").alias("ymain"), F.col("s").alias("ys"))
            outside = F.when(F.col("yc") == F.col("xc"), False).otherwise(F.col("xc") != F.col("xmain"))
            pairs = x.join(y, (F.col("xk") == F.col("yk")) & outside & ((F.col("yc") == F.col("ymain")) | (F.col("x") < F.col("y"))) & close(F.col("xm"), F.col("ym")) & near(F.col("xs"), F.col("ys")))
            found = staged(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), "near")
        more = staged(verify(found), "links")
        if not last:
            if rows is not shared:
                unstaged(rows)
            rows = members
        unstaged(placed)
        released(spark)
        done = done.union(found)
        if not more.isEmpty():
            links = links.union(more)
            comps = connected_components(links)
    if rows is not shared:
        unstaged(rows)
    for x in (sizes, shared):
        unstaged(x)
    released(spark)
    return comps
