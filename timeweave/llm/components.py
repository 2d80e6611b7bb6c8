"""Connected components of a graph too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Up to so many links are joined by one task in one pass, without rounds of joins to plan and compile; more are dealt out.
FEW = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every node's larger neighbours are linked to the least of it and its neighbours; else its smaller ones are.

    Minima are aggregated before the shuffle, and the join's other side has one row a node, so a hub's edges can be split.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("n"))
    linked = joined.where(F.col("v") > F.col("u")) if large else joined
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of links, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, nodes[label]
        # the larger root hangs on the least that it meets; then every node points at its root
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _few(edges: DataFrame) -> DataFrame:
    """node, root of links that one task holds."""

    def run(batches):
        own = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if own:
            node, root = roots(*(np.concatenate(x) for x in zip(*own, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(c.lean(run), "node long, root long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the component's least node) of every node that has an edge (u, v). Self links and repeated links do no harm."""
    edges = c.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= FEW:
        return _few(edges)
    before = None
    for _ in range(most_rounds):
        edges = c.cut(_star(_star(edges, large=True), large=False))
        # a round that changes nothing ends it; each link counts with its two ends
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
