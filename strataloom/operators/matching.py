"""Findings across scans: identities, tiered one-to-one matching, differences to a baseline, set-wise pairing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged, unstaged


def identity(kind: Column, path: Column, name: Column, ordinal: Column) -> Column:
    """``kind:path:name#ordinal``; line numbers are no part of it."""
    return F.concat(kind, F.lit(":"), path, F.lit(":"), name, F.lit("#"), ordinal.cast("string"))


def ordinals(items: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return items.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def tiered_match(current: DataFrame, known: DataFrame, tiers: list[list[str]], fingerprint: str = "fingerprint") -> DataFrame:
    """(current, known, tier): greedy one-to-one matching, tier by tier.

    A tier is a list of columns that must be equal and not null. Within equal keys the n-th in order of fingerprint
    matches the n-th of the other side; who is matched leaves both sides before the next tier.
    """
    out = []
    left, right = current, known
    for no, keys in enumerate(tiers, 1):
        place = Window.partitionBy(*keys).orderBy(fingerprint)
        present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        a = left.filter(present).select(*keys, F.col(fingerprint).alias("current"), F.row_number().over(place).alias("_n"))
        b = right.filter(present).select(*keys, F.col(fingerprint).alias("known"), F.row_number().over(place).alias("_n"))
        hit = a.join(b, [*keys, "_n"]).select("current", "known", F.lit(no).alias("tier"))
        out.append(hit)
        left = left.join(hit.select(F.col("current").alias(fingerprint)), fingerprint, "left_anti")
        right = right.join(hit.select(F.col("known").alias(fingerprint)), fingerprint, "left_anti")
    return reduce(DataFrame.unionByName, out)


#: Paths up to which a block of a log of renames grows in a task's memory.
BLOCK_PATHS = 100_000


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, old, new) of one range of a log, latest first, to what blocks of it do: (s, p, end, renames, leaves, comes).

    ``s``: the earliest place in the block. ``end``: where a file called p before the block is behind it, after so many ``renames``; null if nothing leaves p.
    ``leaves``, ``comes``: the first places at which p is left and arrived at. A block ends between two places.
    """
    schema = pa.schema([("s", pa.int64()), ("p", pa.string()), ("end", pa.string()), ("renames", pa.int64()), ("leaves", pa.int64()), ("comes", pa.int64())])
    ends, came, at, now = {}, {}, None, {}

    def taken() -> None:
        for old, new in now.items():
            came[new] = at
        # Renames of one place happen at once: all are read before any is set.
        moved = {old: (*(x[:2] if (x := ends.get(new)) else (new, 0)), at) for old, new in now.items()}
        ends.update({old: (end, n + 1, s) for old, (end, n, s) in moved.items()})
        now.clear()

    def whole() -> Iterator[pa.RecordBatch]:
        paths = sorted(ends.keys() | came.keys())
        for i in range(0, len(paths), 10_000):
            part = paths[i : i + 10_000]
            found = [ends.get(p, (None, None, None)) for p in part]
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int64()), pa.array(part, pa.string()), *[pa.array([x[k] for x in found], schema.types[k + 2]) for k in range(3)], pa.array([came.get(p) for p in part], pa.int64())], schema=schema)
        ends.clear()
        came.clear()

    for batch in rows:
        for s, old, new in zip(*[batch[c].to_pylist() for c in ("s", "old", "new")]):
            if s != at:
                taken()
                if len(ends) + len(came) >= BLOCK_PATHS:
                    yield from whole()
                at = s
            now.setdefault(old, new)  # the least target comes first
    taken()
    yield from whole()


def rename_map(renames: DataFrame, seq: str = "seq", old: str = "old", new: str = "new", rounds: int = 40) -> DataFrame:
    """(old, new): where each path of the beginning of a log is at its end, from renames in the order of ``seq``.

    A rename is followed by the next one that begins where it ended, if that comes later; so a name that is left and taken
    again is told apart by time. The log is cut into ranges, each of which says in one pass where it takes each of its paths; these
    moves are a log of their own, as long as the paths that each range has. Chains of those are halved in each round (pointer jumping). Chains of over
    2 ** (``rounds`` - 1) renames are refused. Paths that were made by a rename are not of the beginning; renames of one ``seq`` happen at once,
    and of several of one path in one ``seq`` the least target counts. Paths that end where they began are left out.
    """
    spark = renames.sparkSession
    own = renames.select(F.col(seq).cast("long").alias("s"), F.col(old).cast("string").alias("old"), F.col(new).cast("string").alias("new")).filter("s is not null and old is not null and new is not null and old != new")
    parts = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = own.repartitionByRange(parts, "s").sortWithinPartitions(F.desc("s"), "old", "new")
    moves = staged(ranged.mapInArrow(_blocks, "s long, p string, end string, renames long, leaves long, comes long"), "moves")
    heads = moves.groupBy("p").agg(F.min("leaves").alias("leaves"), F.min("comes").alias("comes"), F.min(F.when(F.col("end").isNotNull(), F.col("s"))).alias("s")).filter("leaves <= comes or comes is null").select(F.col("p").alias("path"), F.struct("p", "s").alias("at"))
    own = moves.filter("end is not null").select("s", F.col("p").alias("old"), F.col("end").alias("new"), "renames")
    leaves, comes = own.select(F.col("old").alias("p"), "s", F.lit(1).alias("leaves"), "old", "new", "renames"), own.select(F.col("new").alias("p"), "s", F.lit(0).alias("leaves"), "old", "new", "renames")
    # At each arrival at a path: in which block it is left next. One window a path.
    w = Window.partitionBy("p").orderBy("s", F.desc("leaves"))
    at = leaves.unionByName(comes).withColumn("next", F.min(F.when(F.col("leaves") == 1, F.col("s"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    steps = at.filter("leaves = 0").select(F.struct(F.col("old").alias("p"), "s").alias("at"), F.col("new").alias("end"), "renames", F.when(F.col("next").isNotNull(), F.struct("p", F.col("next").alias("s"))).alias("to"))
    steps = staged(steps, "renames")
    for _ in range(rounds):
        if steps.filter("to is not null").isEmpty():
            break
        ahead = steps.select(F.col("at").alias("to"), F.col("end").alias("_end"), F.col("renames").alias("_renames"), F.col("to").alias("_to"))
        jumped = staged(steps.join(ahead, "to", "left").select("at", F.coalesce("_end", "end").alias("end"), (F.col("renames") + F.coalesce("_renames", F.lit(0))).alias("renames"), F.col("_to").alias("to")), "renames")
        unstaged(steps)
        steps = jumped
    if not steps.filter(F.col("to").isNotNull() | (F.col("renames") > 1 << max(0, min(rounds, 62) - 1))).isEmpty():
        raise RuntimeError(f"chains of renames did not end in {rounds} rounds")
    return heads.join(steps, "at").select(F.col("path").alias("old"), F.col("end").alias("new")).filter("old != new")


def at_new_paths(known: DataFrame, moved: DataFrame, path: str = "path", name: str = "path_now") -> DataFrame:
    """``known`` with the path that each finding's file has now; for a last tier of ``tiered_match`` that holds it against the current paths."""
    return known.join(moved.select(F.col("old").alias(path), F.col("new").alias("_new")), path, "left").withColumn(name, F.coalesce("_new", path)).drop("_new")


def baseline_diff(current: DataFrame, known: DataFrame, matched: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """(fingerprint, change): introduced and cleared findings, those without a match."""
    new = current.join(matched.select(F.col("current").alias(fingerprint)), fingerprint, "left_anti").select(fingerprint, F.lit("introduced").alias("change"))
    old = known.join(matched.select(F.col("known").alias(fingerprint)), fingerprint, "left_anti").select(fingerprint, F.lit("cleared").alias("change"))
    return new.unionByName(old)


def conformance(changed: DataFrame, named: DataFrame, path: str = "path") -> DataFrame:
    """(path, scope): changed paths in or out of scope, named ones unaddressed."""
    a, b = changed.select(path, F.lit(True).alias("_c")).distinct(), named.select(path, F.lit(True).alias("_n")).distinct()
    scope = F.when(F.col("_c") & F.col("_n"), "in-scope").when(F.col("_c"), "out-of-scope").otherwise("unaddressed")
    return a.join(b, path, "full_outer").select(path, scope.alias("scope"))


def weakened(lines: DataFrame, by: str, side: str, assertion: Column) -> DataFrame:
    """(by, added, removed): where more assertions went than came."""
    counted = lines.groupBy(by).agg(F.count_if(assertion & (F.col(side) == "+")).alias("added"), F.count_if(assertion & (F.col(side) == "-")).alias("removed"))
    return counted.filter("removed > added")


def suffix_join(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, found): each path's only tree path that is it or ends in ``/`` and it; by file name first, so no pair of unlike names is compared."""
    base = lambda c: F.substring_index(c, "/", -1)
    a, b = paths.select("path", base("path").alias("_b")).distinct(), tree.select(F.col("path").alias("found"), base("path").alias("_b")).distinct()
    hit = a.join(b, "_b").filter((F.col("found") == F.col("path")) | F.col("found").endswith(F.concat(F.lit("/"), F.col("path"))))
    return hit.groupBy("path").agg(F.count("*").alias("n"), F.min("found").alias("found")).filter("n = 1").select("path", "found")
