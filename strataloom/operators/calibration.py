"""The constant of the curve from a corpus of projects, and how far it moves when the corpus is drawn again: weighted resamples, all fitted in lockstep.

A corpus is one summary row a project (``scorecard``). Every fit is a bisection on the median overall score of its
resample; one pass serves all resamples and some steps of each, and scores only the rows that still change between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged, unstaged
from . import scorecard as sc
from .scoring import CATEGORIES, HALF, UNKNOWN
from .stats import numbered

# The span of the search and its steps, the plateau around its end, the least corpus, the reference that is a unit and no median.
LOW, HIGH, STEPS = 1e-3, 1e3, 40
PLATEAU, STRIDE = 80, 0.001
LEAST_CORPUS = 8
UNIT = "policy_gates"

#: Steps of a bisection that each pass answers: it looks at every middle they may come to. Few while the span is wide and
#: most rows still change in it, many when few do.
DEPTHS = (2, 2, 2, 2, 2, 5, 5, 5, 5, 5, 5)
#: Passes after which nearly every row still changes in the span, so that looking for those that don't would not pay.
WIDE = 4
assert sum(DEPTHS) == STEPS


def resample(projects: DataFrame, key: str, draws: int, seed: int = 7) -> DataFrame:
    """(draw, key, w): how often each project is in each of ``draws`` resamples of the size of the corpus, with replacement; those of 0 have no row.

    The j-th pick of a resample is the project whose number, in the order of ``key``, a digest of (seed, draw, j) names; so
    every run draws alike, whatever the partitions. Keys are distinct. An empty corpus has no resamples.
    """
    own = staged(numbered(projects.select(key), key, "_i"), "corpus")
    size = own.agg(F.count("*").alias("_n"))  # one row
    picks = own.select(F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).join(F.broadcast(size))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", "_j"))
    chosen = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % F.col("_n") + 1).alias("_i")
    return picks.select("draw", chosen).groupBy("draw", "_i").agg(F.count("*").alias("w")).join(own, "_i").select("draw", key, "w")


def weighted_medians(rows: DataFrame, by: str, weight: str, columns: list[str], parts: int = 64) -> DataFrame:
    """(by, of, median): exact medians of each column in each group, of rows that count ``weight`` times; nulls are left out.

    Values are cut into ranges once for all groups. The weights of the ranges say in which of them a group's middle
    lies, and only its rows in there are put in order; so no task orders a whole group.
    """
    long = rows.select(F.col(by).alias("by"), F.col(weight).alias("w"), F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    counted = staged(long.filter("x.v is not null").groupBy("by", F.col("x.of").alias("of"), F.col("x.v").alias("v")).agg(F.sum("w").alias("w")), "values")
    ranged = staged(counted.select("of", "v").distinct().repartitionByRange(parts, "of", "v").withColumn("part", F.spark_partition_id()), "ranges")
    held = counted.join(ranged, ["of", "v"])
    whole = Window.partitionBy("by", "of")  # a row for each range
    sums = held.groupBy("by", "of", "part").agg(F.sum("w").alias("own"))
    sums = sums.select("by", "of", "part", "own", (F.sum("own").over(whole.orderBy("part")) - F.col("own")).alias("ahead"), F.sum("own").over(whole).alias("n"))
    # The middles are the first values up to which half of the rows lie, and more than half.
    middle = sums.filter("ahead * 2 <= n and (ahead + own) * 2 >= n").select("by", "of", "part", "ahead", "n")
    upto = F.sum("w").over(Window.partitionBy("by", "of", "part").orderBy("v")) + F.col("ahead")
    placed = held.join(middle, ["by", "of", "part"]).withColumn("upto", upto)
    ends = placed.groupBy("by", "of").agg(F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") * 2 > F.col("n"), F.col("v"))).alias("b"))
    return ends.select(F.col("by").alias(by), "of", ((F.col("a") + F.col("b")) / 2).alias("median"))


def references_of(rows: DataFrame, by: str = "draw", weight: str = "w") -> DataFrame:
    """(by, r_<pressure>): medians of the pressures p_<pressure> of each group to four digits; that of gates is fixed. A pressure that no row has is null."""
    names = [k for k in sc.REFERENCES if k != UNIT]
    medians = weighted_medians(rows, by, weight, [f"p_{k}" for k in names])
    found = medians.groupBy(by).agg(*[F.max(F.when(F.col("of") == f"p_{k}", F.round(F.col("median") + HALF, 4))).alias(f"r_{k}") for k in names])
    return found.withColumn(f"r_{UNIT}", F.lit(sc.REFERENCES[UNIT]))


_MID = "(x.low + x.high) / 2"


def _middles(depth: int) -> str:
    """(low, high) halved downwards or upwards; the middles that so many halvings may come to, as a heap whose place h is followed by 2 h downwards and 2 h + 1 upwards."""
    return f"""transform(sequence(1, {(1 << depth) - 1}), h -> aggregate(slice(split(bin(h), ''), 2, 64), struct(low, high),
    (x, up) -> if(up = '1', struct({_MID} as low, x.high as high), struct(x.low as low, {_MID} as high)), x -> {_MID}))"""


def _descended(depth: int) -> str:
    """Where the heap ``k`` leads to, by whether the median at each of its places is ``below`` the target."""
    return f"""aggregate(sequence(1, {depth}), struct(1 as h, low, high),
    (x, _) -> if(below[x.h - 1], struct(2 * x.h + 1 as h, k[x.h - 1] as low, x.high as high), struct(2 * x.h as h, x.low as low, k[x.h - 1] as high)), x -> struct(x.low, x.high))"""


def _median_tenths(scored: DataFrame) -> DataFrame:
    """(draw, slot, m20) of (draw, slot, t, w): twice the weighted median of the scores in tenths, of which there are 51 at most."""
    counts = scored.groupBy("draw", "slot", "t").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("draw", "slot")
    upto = counts.select("draw", "slot", "t", F.sum("w").over(w.orderBy("t")).alias("upto"), F.sum("w").over(w).alias("n"))
    ends = [F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("t"))), F.min(F.when(F.col("upto") * 2 > F.col("n"), F.col("t")))]
    return upto.groupBy("draw", "slot").agg((ends[0] + ends[1]).alias("m20"))


def _settled() -> list[Column]:
    """f_<category> and t_<category>: what a category's weighted sum has from the aspects that are on no curve, and the sum of its weights."""
    found, absent, out = sc.aspects(), sc.not_applicable(), []
    for c in CATEGORIES:
        own = sc.weights(c, absent)
        fixed = [F.coalesce(found[a], F.lit(UNKNOWN)) * w for a, w in own.items() if a not in sc.REFERENCES]
        out += [sum(fixed, F.lit(0.0)).alias(f"f_{c}"), sum(own.values(), F.lit(0.0)).alias(f"t_{c}")]
    return out


def _tenths(rows: DataFrame, **at: Column) -> DataFrame:
    """``rows`` with a column for each of ``at``: ten times the overall score under that constant of the curve, over q_<pressure>, f_<category>, t_<category> and cap."""
    shown = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), v)) + HALF, 1)  # noqa: E731  the one rounding of scores, of what is never null
    curve = lambda a, k: F.when(F.col(f"q_{a}").isNull(), UNKNOWN).otherwise(shown(5 * k / (F.col(f"q_{a}") + k)))
    curves = rows.select("*", *[curve(a, k).alias(f"{x}_a_{a}") for a in sc.REFERENCES for x, k in at.items()])
    out = []
    for x in at:
        means = {c: sum((F.col(f"{x}_a_{a}") * w for a, w in own.items() if a in sc.REFERENCES), F.col(f"f_{c}")) / F.col(f"t_{c}") for c, own in CATEGORIES.items()}
        means["testability"] = F.least(means["testability"], F.col("cap"))
        out.append(F.round(shown(sum((shown(v) for v in means.values()), F.lit(0.0)) / len(means)) * 10).cast("int").alias(x))
    return curves.select(*[f"`{c}`" for c in rows.columns], *out)


def fit_constants(rows: DataFrame, target: float = 4.0) -> DataFrame:
    """(draw, n, constant): for each draw the constant of the curve at which the median overall score of its rows is ``target``.

    ``rows``: summary rows with draw, w (how often a row counts), p_<pressure> and r_<pressure>, the pressures and what they
    are divided by. A pressure without a reference over 0 counts as unknown. The search halves its span ``STEPS`` times; as scores are
    rounded it ends on the edge of a plateau, whose middle among the constants ``PLATEAU`` strides on either side is
    taken where there is one. Draws of fewer than ``LEAST_CORPUS`` rows have no constant.
    """
    if not 0 < target < 5:
        raise ValueError("a target between 0 and 5, both excluded")
    q = [F.when(F.col(f"r_{k}") > 0, F.col(f"p_{k}") / F.col(f"r_{k}")).alias(f"q_{k}") for k in sc.REFERENCES]
    corpus = staged(rows.select("draw", "w", *q, *_settled(), sc.testability_cap(UNKNOWN).alias("cap")), "corpus")
    enough = corpus.groupBy("draw").agg(F.sum("w").alias("n")).filter(F.col("n") >= LEAST_CORPUS)
    state = staged(enough.select("draw", "n", F.lit(LOW).alias("low"), F.lit(HIGH).alias("high")), "bounds")

    # A score never falls as the constant grows. So a row whose score is the same at both ends of its draw's span has it
    # all over the span: it goes into the counts for good, and only the others are scored at every middle.
    rising = [F.coalesce(F.col(f"q_{k}") >= 0, F.lit(True)) for k in sc.REFERENCES]

    def settled(rows: DataFrame, counts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows that still change within the ``spans`` (draw, low, high), and ``counts`` (draw, t, w) with those that don't."""
        ends = _tenths(rows.join(F.broadcast(spans.select("draw", "low", "high")), "draw"), _u=F.col("low"), _v=F.col("high"))
        same = F.col("_u") == F.col("_v")
        for x in rising:
            same = same & x
        held = staged(ends.withColumn("_same", F.coalesce(same, F.lit(False))).drop("low", "high"), "ends")
        done = held.filter("_same").groupBy("draw", F.col("_u").alias("t")).agg(F.sum("w").alias("w"))
        return held.filter("not _same").drop("_u", "_v", "_same"), staged(counts.union(done), "counts")

    def medians(rows: DataFrame, counts: DataFrame, points: DataFrame) -> DataFrame:
        """``points``: (draw, slot, k), some for each draw, whose number is a parameter."""
        at = _tenths(rows.join(F.broadcast(points), "draw"), t=F.col("k")).groupBy("draw", "slot", "t").agg(F.sum("w").alias("w"))
        return _median_tenths(at.union(counts.join(F.broadcast(points), "draw").select("draw", "slot", "t", "w")))

    goal = target * 20
    none = corpus.groupBy("draw").agg(F.lit(0).alias("t"), F.sum("w").alias("w")).filter("false")
    rows, counts = corpus, none
    for turn, depth in enumerate(DEPTHS):
        heap = state.select("draw", "n", "low", "high", F.expr(_middles(depth)).alias("k"))
        below = medians(rows, counts, heap.select("draw", F.posexplode("k").alias("slot", "k"))).groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "m20"))), lambda x: x["m20"] < goal - HALF).alias("below"))
        state = staged(heap.join(below, "draw").select("draw", "n", F.expr(_descended(depth)).alias("x")).select("draw", "n", "x.*"), "bounds")
        if turn >= WIDE:
            rows, counts = settled(rows, counts, state)
    fitted = state.select("draw", "n", ((F.col("low") + F.col("high")) / 2).alias("end"))
    strides = F.transform(F.sequence(F.lit(-PLATEAU), F.lit(PLATEAU)), lambda i: F.col("end") + i * STRIDE)
    points = fitted.select("draw", F.posexplode(strides).alias("slot", "k"))
    # A draw that ends near 0 has constants below it, where scores need not rise: its rows are all scored.
    spans = points.groupBy("draw").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    wide = spans.select("draw", F.when(F.col("low") > 0, F.col("low")).alias("low"), "high")
    rows, counts = settled(corpus, none, wide)
    flat = medians(rows, counts, points).filter(F.abs(F.col("m20") - goal) < HALF)
    edges = flat.groupBy("draw").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    near = lambda slot: F.round(F.col("end") + (F.col(slot) - PLATEAU) * STRIDE + HALF, 4)
    constant = F.coalesce(F.round((near("a") + near("b")) / 2 + HALF, 4), F.round(F.col("end") + HALF, 4))
    every = corpus.groupBy("draw").agg(F.sum("w").alias("n"))
    return every.join(fitted.drop("n").join(edges, "draw", "left").select("draw", constant.alias("constant")), "draw", "left")


def refits(summary: DataFrame, key: str, draws: int = 200, seed: int = 7, target: float = 4.0) -> DataFrame:
    """(draw, n, constant, r_<pressure>): the constant fitted to each resample of the corpus, under references taken from that resample; draw 0 is the corpus itself.

    ``draws`` is the one number that bounds what is broadcast; the corpus may be of any size. Projects of repeated keys
    count as one each, so keys should be distinct. An empty corpus gives no rows.
    """
    own = staged(summary.select("*", *[v.alias(f"p_{k}") for k, v in sc.pressures().items()]), "projects")
    weights = resample(own, key, draws, seed).unionByName(own.select(F.lit(0).alias("draw"), key, F.lit(1).cast("long").alias("w")))
    rows = staged(own.join(weights, key), "resamples")
    refs = staged(references_of(rows), "references")
    fits = fit_constants(rows.join(F.broadcast(refs), "draw"), target)  # a row for each draw
    return staged(fits.join(refs, "draw"), "fits")


def interval(fits: DataFrame, least: float = 0.025, most: float = 0.975) -> DataFrame:
    """(draws, measured, low, high, outside): the constant of the corpus, the ends of the middle share of those of its resamples, and whether it is beyond them.

    An end is the value that so large a share of the ordered constants precedes; draws without a constant are left out.
    """
    order = F.row_number().over(Window.orderBy("constant", "draw")) - 1  # a row for each draw
    drawn = fits.filter("draw > 0 and constant is not null").withColumn("place", order).withColumn("n", F.count("*").over(Window.partitionBy()))
    at = lambda share: F.max(F.when(F.col("place") == F.floor(F.col("n") * share), F.col("constant")))
    ends = drawn.agg(F.count("*").alias("draws"), at(least).alias("low"), at(most).alias("high"))
    own = fits.filter("draw = 0").agg(F.max("constant").alias("measured"))
    return ends.crossJoin(own).select("draws", "measured", "low", "high", ((F.col("measured") < F.col("low")) | (F.col("measured") > F.col("high"))).alias("outside"))  # a row each


def curve_constant(summary: DataFrame, target: float = 4.0) -> float | None:
    """The constant of the curve at which the median overall score of a corpus is ``target``, under the fixed references; null under eight projects."""
    rows = summary.select("*", F.lit(0).alias("draw"), F.lit(1).cast("long").alias("w"), *[v.alias(f"p_{k}") for k, v in sc.pressures().items()], *[F.lit(v).alias(f"r_{k}") for k, v in sc.REFERENCES.items()])
    fit = fit_constants(rows, target).first()
    return fit["constant"] if fit else None
