"""Medians of a corpus, rank statistics and the bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def placed_values(rows: DataFrame, value: str, parts: int = 32) -> DataFrame:
    """(value, k, before): distinct values, how often each occurs, and how many values are smaller; nulls are left out.

    Counts are dealt to ranges of values; sums run inside a range, and what the ranges before hold is added. So no task
    holds more than a range.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("k"))
    ranged = staged(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum("k").alias("own"))
    ahead = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("ahead"))  # a row for each range
    inside = F.sum("k").over(Window.partitionBy("part").orderBy("value")) - F.col("k")
    return ranged.withColumn("inside", inside).join(F.broadcast(ahead), "part").select("value", "k", (F.col("ahead") + F.col("inside")).alias("before"))


def numbered(rows: DataFrame, order: str, name: str = "n", parts: int = 32) -> DataFrame:
    """``rows`` numbered from 1 on in the order of a column, nulls first: by ranges of it, each numbered by itself behind those before it. Rows of equal values are numbered in no fixed order."""
    ranged = staged(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "numbered")
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_own"))
    ahead = sums.select("_part", (F.sum("_own").over(Window.orderBy("_part")) - F.col("_own")).alias("_ahead"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_part", "_inside", "_ahead")


def references(rows: DataFrame, columns: list[str], least: int = 8) -> DataFrame:
    """Exact interpolated medians, one row; null where fewer than ``least`` rows have a value."""
    out = None
    for c in columns:
        placed, n = placed_values(rows, c), rows.agg(F.count(c).alias("n"))
        low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
        at = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("k"))
        both = placed.join(F.broadcast(n)).filter(at(low) | at(high)).agg(F.min("value").alias("a"), F.max("value").alias("b"), F.max("n").alias("n"))
        one = both.select(F.when(F.col("n") >= least, F.round((F.col("a") + F.col("b")).cast("double") / 2, 4)).alias(c))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of each row, from counts of equal values (``placed_values``); rows without a value go."""
    placed = placed_values(rows, value).select(F.col("value").alias(value), (F.col("before") + (F.col("k") + 1) / 2).alias(name))
    return rows.join(placed, value)


def mann_whitney(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(n1, n0, u, z): U of group 1 against group 0 by average ranks, z with tie and continuity correction; null under three rows a side."""
    ranked = average_ranks(rows, value, "_rank")
    ties = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("k")).agg(F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("ties"))
    s = ranked.agg(F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"), F.sum(F.when(F.col(group) == 1, F.col("_rank"))).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n0")
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    gap = u - F.col("n1") * F.col("n0") / 2
    enough = (F.col("n1") >= 3) & (F.col("n0") >= 3)
    return s.crossJoin(ties).select("n1", "n0", F.when(enough, u).alias("u"), F.when(enough & (sd > 0), F.round((F.abs(gap) - 0.5) / sd * F.signum(gap), 6)).alias("z"))


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks; 0 where it is undefined."""
    both = average_ranks(average_ranks(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx"), y, "_ry")
    return both.agg(F.round(F.coalesce(F.nanvl(F.corr("_rx", "_ry"), F.lit(0.0)), F.lit(0.0)), 6).alias("rho"))


#: Cuts of a group's places in which a resample's middle is looked for, and picks that one row of the draws stands for.
CUTS, CHUNK = 256, 1 << 18


def bootstrap_median(values: DataFrame, by: str, column: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """(by, median, low, high): the median of each group and its 95 % interval over ``draws`` seeded resamples of the group.

    The j-th value of a resample is that one whose place in the group's order a digest of (seed, group, draw, j) names, so every run draws
    alike. Values never meet the picks: the middle of a resample is that of its places, which are counted in
    ``CUTS`` cuts of the group first; only those in the cut of the middle are drawn again and put in order, and two places a resample are
    looked up. Groups may be of any size. Null values and null groups are left out.
    """
    spark = values.sparkSession
    parts = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = values.filter(F.col(column).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).alias("by"), F.col(column).cast("double").alias("v")).agg(F.count("*").alias("k"))
    ranged = staged(counts.repartitionByRange(parts, "by", "v").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = staged(ranged.groupBy("by").agg(F.sum("k").alias("n")), "sizes")
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    # A row for each chunk of picks; those of a draw stay together, so that its cuts are counted before they move.
    drawn = sizes.select("by", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    chunks = drawn.select("by", "n", "draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(CHUNK).cast("long"))).alias("from"))

    def picks(rows: DataFrame) -> DataFrame:
        """``rows`` (chunks, whatever else they have) with the place ``i`` of each of their picks and its ``cut``."""
        spread = rows.repartition(parts, "by", "draw", "from").withColumn("j", F.explode(F.sequence("from", F.least("n", F.col("from") + (CHUNK - 1)))))
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("by").cast("string"), "draw", "j"))
        return spread.withColumn("i", F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % F.col("n")).withColumn("cut", F.expr(f"i * {CUTS} div n"))

    cuts = picks(chunks).groupBy("by", "draw", "cut").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    before = F.sum("c").over(Window.partitionBy("by", "draw").orderBy("cut")) - F.col("c")  # a row for each cut
    placed = cuts.withColumn("before", before)
    at = lambda place, size: (F.col("before") <= place) & (place < F.col("before") + F.col(size))
    middle = placed.filter(at(low, "c") | at(high, "c")).groupBy("by", "draw").agg(F.min("cut").alias("first"), F.max("cut").alias("last"), F.min("before").alias("ahead"))
    again = picks(chunks.join(middle.hint("merge"), ["by", "draw"])).filter((F.col("cut") == F.col("first")) | (F.col("cut") == F.col("last")))
    # Between the cuts of the two middles, if these differ, no pick lies.
    ranks = again.withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("by", "draw").orderBy("i")) - 1)
    wanted = ranks.groupBy("by", "draw").agg(*[F.max(F.when(F.col("rank") == place, F.col("i"))).alias(k) for k, place in (("a", low), ("b", high))])
    wanted = staged(wanted.unionByName(sizes.select("by", F.lit(0).alias("draw"), low.alias("a"), high.alias("b"))), "wanted")  # draw 0: the group itself
    # Where the values of so many places are: in which range, then in the range.
    sums = ranged.groupBy("by", "part").agg(F.sum("k").alias("own"))
    sums = sums.withColumn("before", F.sum("own").over(Window.partitionBy("by").orderBy("part")) - F.col("own"))  # a row for each range
    place = F.col("place")
    places = wanted.select("by", F.explode(F.array("a", "b")).alias("place")).distinct()
    there = places.join(sums.hint("merge"), "by").filter(at(place, "own")).select("by", "part", "place", (place - F.col("before")).alias("inside"))
    inside = ranged.withColumn("before", F.sum("k").over(Window.partitionBy("by", "part").orderBy("v")) - F.col("k"))
    found = inside.join(there.hint("merge"), ["by", "part"]).filter(at(F.col("inside"), "k")).select("by", "place", "v")
    found = staged(found, "found")
    both = wanted
    for k in ("a", "b"):
        both = both.join(found.select("by", F.col("place").alias(k), F.col("v").alias(f"v{k}")).hint("merge"), ["by", k])
    medians = both.select("by", "draw", (F.col("va") * 0.5 + F.col("vb") * 0.5).alias("m"))
    drawn = F.when(F.col("draw") > 0, F.col("m"))
    ends = medians.groupBy("by").agg(F.max(F.when(F.col("draw") == 0, F.col("m"))).alias("median"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))
    return ends.select(F.col("by").alias(by), *[F.round(F.col(k) + 1e-9, 4).alias(k) for k in ("median", "low", "high")])
