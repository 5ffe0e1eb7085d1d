"""Mixing sources to target weights: block quotas go down a multivariate-hypergeometric splitting tree to output shards."""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of the total size by weight; a source stops at ``cap`` times its size and the excess goes to the others by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if level * weights[i] >= cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): exact block counts. Each node of the tree deals its blocks to two halves by a multivariate-hypergeometric draw."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def deal(own: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = own
            return
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = np.zeros_like(own)
        take, rest, all_left = int(own.sum()) * (mid - low) // (high - low), int(own.sum()), own.copy()
        for i, n in enumerate(all_left.tolist()):  # one source after the other: each marginal is hypergeometric
            rest -= n
            left[i] = rng.hypergeometric(n, rest, take) if n and take else 0
            take -= int(left[i])
        deal(left, low, mid)
        deal(own - left, mid, high)

    deal(np.asarray(quotas, np.int64), 0, shards)
    return out


def closed(texts: pa.Table) -> pa.Table:
    """The documents next to the cut of each source that change sides to bring its words near its target, largest first, as long as that helps.

    Columns: key, own (which document), h (its hash, which settles ties), step (the words that changing sides adds, or takes if negative), rest (the words the source lacks).
    """
    keys, own, h, step, rest = (texts[k].to_pylist() for k in ("key", "own", "h", "step", "rest"))
    by: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        by.setdefault(k, []).append(i)
    moved = []
    for rows in by.values():
        left, open_ = rest[rows[0]], sorted(rows, key=lambda i: (-abs(step[i]), h[i], own[i]))
        for i in open_ * 2:
            sign = -1 if i in moved else 1  # a second look may take a change back
            if abs(left - sign * step[i]) < abs(left):
                left -= sign * step[i]
                moved.remove(i) if sign < 0 else moved.append(i)
    return pa.table({"key": pa.array([keys[i] for i in moved], pa.string()), "own": pa.array([own[i] for i in moved], pa.int64()), "turned": pa.array([True] * len(moved), pa.bool_())})


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, shards: int = 64, blocks: int = 4096, buckets: int = 1024, nearby: int = 64, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, draws array<struct<epoch, shard, place>>) for every row of ``docs``.

    Each source's documents are laid in the order of a seeded hash along a line of words, which is cut into ``blocks``
    blocks of equal length; a document belongs to the block of its middle. The target asks for so many whole passes
    over the line and a part of one more. Of the ``nearby`` documents next to where that part ends some change sides, largest
    first, as long as that brings the source's words nearer to the target; so it is missed by half of the least of these documents that could still change, about.
    With very many sources there are fewer blocks, so that all quotas stay within what numpy draws from (10**9). The quotas of all sources go down the splitting tree to the ``shards``; a shard's quota of a source
    is a run of the permuted blocks that no other shard has, and ``place`` is the order inside the shard. Positions on
    the line come from sums by (source, hash bucket), so no task holds a source. Only sums by source reach the driver.

    Null sources form a source of their own, last in order; null or empty texts have size 0; repeated rows count each;
    ids may be null. ``weights`` repeat over the sources in code-point order.
    """
    spark = docs.sparkSession
    rows = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))).alias("h"))
        .withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
        .withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))),
        "mix",
    )
    sums = rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("own"))
    by_source = sums.groupBy("key", "source").agg(F.sum("own").alias("n")).collect()
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in by_source]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    blocks = max(64, min(blocks, 900_000_000 // (cap * max(1, len(sizes)))))
    full = [int(g // n) if n else 0 for g, n in zip(goal, sizes)]
    part = [round((g / n - f) * blocks) if n else 0 for g, n, f in zip(goal, sizes, full)]
    quotas = np.array([f * blocks + k for f, k in zip(full, part)], np.int64)
    dealt = split_quotas(quotas, shards, seed) if len(quotas) else np.zeros((shards, 0), np.int64)
    plan = []
    for i, r in enumerate(by_source):
        rng = np.random.default_rng([seed, i])
        steps = []
        for e in range(full[i] + 1):
            n = blocks if e < full[i] else part[i]
            a = int(rng.integers(1, max(2, n)))
            while n and gcd(a, n) != 1:
                a += 1
            steps.append((max(n, 1), a, int(rng.integers(0, max(1, n)))))
        plan.append((r["key"], sizes[i], goal[i], full[i], part[i], [x[0] for x in steps], [x[1] for x in steps], [x[2] for x in steps], np.cumsum(dealt[:-1, i]).tolist()))
    plan_df = spark.createDataFrame(plan, "key string, source_size long, target double, full int, part int, n array<long>, a array<long>, c array<long>, bounds array<long>")
    before = sums.withColumn("start", F.sum("own").over(Window.partitionBy("key").orderBy("bucket")) - F.col("own")).select("key", "bucket", "start")
    line = rows.withColumn("at", F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
    placed = line.join(before, ["key", "bucket"]).join(plan_df, "key")
    block = F.when(F.col("source_size") > 0, F.least(F.lit(blocks - 1), F.floor((F.col("start") + F.col("at")) * blocks / F.col("source_size")))).otherwise(0).cast("long")
    placed = staged(placed.withColumn("block", block).withColumn("taken_last", F.col("block") < F.col("part")).withColumn("own", F.monotonically_increasing_id()), "placed")
    words = placed.groupBy("key").agg(F.sum(F.col("size") * (F.col("full") + F.col("taken_last").cast("int"))).alias("words"))
    rest = placed.select("key", "target", "source_size", "full", "part").distinct().join(words, "key").select("key", (F.col("target") - F.col("words")).alias("rest"), ((F.col("part") / blocks) * F.col("source_size")).alias("cut"))
    may = placed.filter((F.col("size") > 0) & (F.col("taken_last") | (F.col("full") < cap)) & (F.col("target") != F.col("full") * F.col("source_size")))
    away = F.row_number().over(Window.partitionBy("key").orderBy(F.abs(F.col("start") + F.col("at") - F.col("cut")), "h", "own"))
    # A row number with a limit: each task keeps ``nearby`` rows a source before anything moves.
    close = may.join(F.broadcast(rest) if len(sizes) <= 10_000 else rest, "key").withColumn("rank", away).filter(F.col("rank") <= nearby)
    close = close.select("key", "own", "h", F.when(F.col("taken_last"), -F.col("size")).otherwise(F.col("size")).alias("step"), "rest")
    turned = close.groupBy("key").applyInArrow(closed, "key string, own long, turned boolean")
    placed = placed.join(turned, ["key", "own"], "left").withColumn("last", F.coalesce("turned", F.lit(False)) != F.col("taken_last"))
    passes = F.col("full") + F.col("last").cast("int")
    epochs = F.when(passes > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))

    def draw(e):
        place = F.lit(blocks) * e + F.pmod(F.get("a", e) * F.col("block") + F.get("c", e), F.get("n", e))
        return F.struct(e.cast("int").alias("epoch"), F.size(F.filter("bounds", lambda x: x <= place)).alias("shard"), F.xxhash64(F.lit(seed + 1), "doc_id", e).alias("place"))

    return placed.select("doc_id", "source", "size", "source_size", "target", F.transform(epochs, draw).alias("draws"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_shards): the words that the mix takes of each document, repeats counted."""
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.size(F.array_distinct(F.transform("draws", lambda d: d["shard"]))).cast("long").alias("n_shards"))
