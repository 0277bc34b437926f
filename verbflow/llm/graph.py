"""Connected components: of few edges in one task, of many by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: So many edges are joined in one task; more go through rounds of shuffles.
AT_ONCE = 2_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node reachable from each) by hooking roots and jumping pointers."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.ravel()
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        if np.array_equal(low, high):
            return nodes, nodes[parent]
        np.minimum.at(parent, high, low)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]


def _in_one_task(batches):
    rows = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if rows:
        nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*rows, strict=True)))
        for at in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 50_000]), pa.array(least[at : at + 50_000])], ["node", "component"])


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) for every node that occurs in ``edges`` (a, b), two longs; component is the least node.

    Edges are counted first: up to ``at_once`` (32 MB) are joined in one task.  Beyond that each
    round shrinks paths to stars (repeats fall out once a round); a hub's edges are dealt out by
    the join's skew handling and its minimum by partial aggregation, and the edges of each round
    are written to the checkpoint folder, so a lost executor costs no more than the round.
    Loops and repeated edges do no harm; empty edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("a", "b").where("a <> b").checkpoint()
    if edges.count() <= at_once:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    edges = edges.distinct().checkpoint()
    mark = None
    while True:
        edges = _small_star(_large_star(edges)).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
