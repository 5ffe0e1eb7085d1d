"""Exact near-duplicate vectors: pivots cut the space into cells, the triangle inequality says what lies near a boundary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import staged

TILE = 2048


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers ``labels`` (each its own place, or a smaller one that it is joined to) until both ends of all pairs share one."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(labels, high, low)
        while (labels != (jumped := labels[labels])).any():
            labels[:] = jumped


def near_vectors(vectors: DataFrame, cosine: float = 0.98, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; vectors of one label are linked from ``cosine`` on, in double precision.

    Equal vectors of a label are one node with a number of copies. Unit vectors at a cosine of at least ``cosine`` are
    at most r = sqrt(2 - 2 * cosine) apart. Each node lives in the cell of its nearest pivot p, and is a guest in every
    other cell, of pivot q, from whose border it is at most r away: if x and y are within r, and q is the pivot nearest to y, then
    d(x, q)**2 - d(x, p)**2 is at most 2 r d(p, q). So whatever lies within r of a node is in the node's own cell,
    as inhabitant or guest, exactly once. Cells are compared independently, inhabitants with all members, in tiles of
    at most about ``TILE`` by ``TILE`` nodes, so that no task holds a cell. A tile returns the inhabitants' numbers of
    links, copies counted, and for each node that it linked the one it joins it to, never all pairs.

    ``pivots``: how many nodes, those of the smallest hashes, serve as pivots (they only steer speed); by default one for
    ``TILE`` nodes, from 32 to 1,024.
    Null, zero, empty or non-finite vectors, null labels and null ids link with nothing, and vectors of different widths not with
    each other: component is the id itself, kept is true. Rows of one id are vectors of their own, whatever their labels; each has the
    links and the component of its own vector.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    good = F.size("v") > 0
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = good & F.forall("v", fine) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("h0", F.xxhash64("v")).withColumn("h1", F.xxhash64(F.lit(1), "v"))
    nodes = rows.filter("good").groupBy("label", "h0", "h1").agg(F.min("vec_id").alias("first"), F.first("v").alias("v"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    nodes = nodes.withColumn("group", F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")))
    nodes = staged(nodes.select("label", "h0", "h1", "node", "first", "v", "copies", "group"), "vectors")
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    if pivots is None:
        pivots = min(1024, max(32, nodes.count() // TILE))
    widths: dict[int, list] = {}
    for r in nodes.orderBy("h0", "h1", "label").limit(pivots).collect():
        widths.setdefault(len(r["v"]), []).append(r["v"])
    centres = {w: _unit(np.array(v, float)) for w, v in widths.items()}

    def cells(batches):
        for batch in batches:
            for width in set(pa.compute.list_value_length(batch["v"]).to_pylist()):
                part = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch["v"]), width))
                c = centres.get(width)
                if c is None:
                    home, near = np.zeros(len(part), np.int64), np.ones((len(part), 1), bool)
                else:
                    dot = _unit(_matrix(part["v"])) @ c.T
                    home = dot.argmax(1)
                    gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[home]
                    near = dot.max(1)[:, None] - dot <= radius * gap + 1e-9
                at, cell = np.nonzero(near)
                taken = part.select(["group", "node", "copies", "v"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(cell == home[at])], ["group", "node", "copies", "v", "cell", "lives"])

    placed = nodes.select("group", "node", "copies", "v").mapInArrow(cells, "group string, node long, copies long, v array<double>, cell int, lives boolean")
    placed = placed.withColumn("spread", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)))
    sizes = staged(placed.groupBy("group", "cell").agg(F.ceil(F.count_if("lives") / TILE).cast("int").alias("own"), F.ceil(F.count("*") / TILE).cast("int").alias("all")), "cells")
    placed = placed.join(sizes, ["group", "cell"])
    lives = placed.filter("lives").select("group", "cell", (F.col("spread") % F.col("own")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(True).alias("lives"), "node", "copies", "v")
    members = placed.filter("own > 0").select("group", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own").cast("long") - 1)).alias("i"), (F.col("spread") % F.col("all")).cast("int").alias("j"), F.lit(False).alias("lives"), "node", "copies", "v")

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lives = table["lives"].to_numpy()
        ids, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        x = _unit(_matrix(table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"]))
        a, b = np.flatnonzero(lives), np.flatnonzero(~lives)
        links, labels = np.zeros(len(a), np.int64), np.arange(len(ids))
        for s in range(0, len(a), 512):
            own = a[s : s + 512]
            hit = (x[own] @ x[b].T >= cosine) & (ids[own][:, None] != ids[b][None, :])
            links[s : s + 512] = hit @ copies[b]
            p, q = np.nonzero(hit)
            _joined(labels, own[p], b[q])
        moved = np.flatnonzero(labels != np.arange(len(ids)))
        forest = list(zip(ids[moved].tolist(), ids[labels[moved]].tolist()))
        return pa.table({"node": pa.array([*ids[a].tolist(), *[f[0] for f in forest]], pa.int64()), "other": pa.array([*[None] * len(a), *[f[1] for f in forest]], pa.int64()), "links": pa.array([*links.tolist(), *[0] * len(forest)], pa.int64())})

    found = staged(lives.unionByName(members).groupBy("group", "cell", "i", "j").applyInArrow(tile, "node long, other long, links long"), "tiles")
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = nodes.select("label", "h0", "h1", "node", "first", "copies").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("c"))
    known = placed.join(least, "component").join(links, "node", "left")
    known = known.select("label", "h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "c", F.lit(True).alias("good"))
    out = rows.drop("v").join(known, ["label", "h0", "h1", "good"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
