"""Near-duplicate embeddings by an exact metric range join.

On unit vectors cosine >= c is a distance of at most r = sqrt(2 - 2c).  Pivots split the
vectors into cells (each vector lives with its nearest pivot).  A vector at distance r or
less from cell j's border must be known there too: if x has a partner y in cell j, then
d(x, pj) - d(x, pi) <= 2r by the triangle inequality, x lies within r of the plane between the
two pivots, and d(x, pj) <= r + the cell's radius.  Every cell then joins on its own.

Equal vectors are one node with a multiplicity.  Cells are joined in blocks, each pair of
blocks in a task of its own, so a cell may hold any share of the vectors; a task hands on
link counts and a spanning forest rather than all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_checkpoint_dir, hash_sample
from .graph import components
from .topk import matrix, usable

#: Pivots are at most so many vectors of the table.
PIVOTS = 256
BLOCK = 4096


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components would overflow or vanish
    return x / np.sqrt((x * x).sum(1))[:, None]


def choose_pivots(nodes: DataFrame, count: int) -> np.ndarray:
    """Farthest-first pivots among a bounded sample of the vectors; any choice gives the same links."""
    want = max(1, min(PIVOTS, -(-count // 4096)))
    sample = hash_sample(nodes, "node", count, 16 * want).orderBy("node").select("v").toArrow()
    if not sample.num_rows:
        sample = nodes.orderBy("node").limit(1).select("v").toArrow()
    x = unit(matrix(sample.column("v").combine_chunks()))
    picked, apart = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(want, len(x)):
        far = int(apart.argmax())
        if apart[far] == 0:
            break
        picked.append(far)
        apart = np.minimum(apart, ((x - x[far]) ** 2).sum(1))
    return x[picked]


def find_root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def join_block(x: np.ndarray, y: np.ndarray, x_rows: np.ndarray, y_rows: np.ndarray, allowed, cosine: float, weight: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between two blocks: the weight of partners of each row, and a spanning forest of the linked rows."""
    links = np.zeros(len(weight), np.int64)
    parent = np.arange(len(weight))
    forest = []
    y_single = y.astype(np.float32)
    for a in range(0, len(x), 512):
        near = x[a : a + 512].astype(np.float32) @ y_single.T >= cosine - 1e-4
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i += a
        ok = allowed(x_rows[i], y_rows[j])
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 100_000):
            p, q = i[s : s + 100_000], j[s : s + 100_000]
            true = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
            p, q = x_rows[p[true]], y_rows[q[true]]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            for u, v in zip(p.tolist(), q.tolist(), strict=True):
                u, v = find_root(parent, u), find_root(parent, v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    forest.append((u, v))
    return links, forest


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    ``n_links`` counts the other rows with a cosine of ``cosine`` or more in double
    precision, copies included; ``component_id`` is the smallest id reachable by links and
    ``kept`` tells the rows that bear it.  Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing.  Rows with a null id link as others do, but
    their component is named by the smallest id that is not null.  Vectors must be of
    one length; others raise ValueError.  Rows that share an id are vectors of their own.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    value = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    zero = F.forall(F.col(vector_col), lambda c: c.cast("double") == 0)
    every = vectors.select(F.col(id_col).alias("id"), F.when(usable(vector_col) & ~zero, value).alias("v"))
    # -0.0 and 0.0 are one; copies share a node
    every = every.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    every = every.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).checkpoint()
    nodes = every.where("v is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("v").alias("v")).checkpoint()
    count = nodes.count()
    blank = every.where("v is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not count:
        return blank
    pivots = choose_pivots(nodes, count)
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    between = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(2))

    def distances(batch):
        x = unit(matrix(batch.column("v")))
        return np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(batch)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["cell", "d"])

    reach = np.full(len(pivots), -1.0)
    sizes = np.zeros(len(pivots), np.int64)
    for r in nodes.select("v").mapInArrow(home, "cell int, d double").groupBy("cell").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")).collect():
        reach[r.cell], sizes[r.cell] = r.d, r.n
    def cells(batch):
        """(row, cell, at home?) for the own cell and every cell of a lower number that may hold a partner (a pair meets there only)."""
        d = distances(batch)
        own = d.argmin(1)
        rows = np.arange(len(d))
        mine = d[rows, own][:, None]
        gap = np.maximum(between[own], 1e-12)
        needed = (d <= radius + reach[None, :] + 1e-9) & (d - mine <= 2 * radius + 1e-9) & ((d * d - mine * mine) / (2 * gap) <= radius + 1e-9) & (reach >= 0)[None, :]
        needed &= np.arange(len(pivots))[None, :] <= own[:, None]
        needed[rows, own] = True
        r, c = np.nonzero(needed)
        return r, c, own[r] == c

    def count_visitors(batches):
        for batch in batches:
            if batch.num_rows:
                _, c, is_home = cells(batch)
                cell, n = np.unique(c[~is_home], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n)], ["cell", "n"])

    visitors = np.zeros(len(pivots), np.int64)
    for r in nodes.select("v").mapInArrow(count_visitors, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        visitors[r.cell] = r.n
    parts = np.maximum(1, -(-sizes // BLOCK))
    visitor_parts = np.maximum(1, -(-visitors // (4 * BLOCK)))

    def deal(batches):
        """Home rows stand in one block and meet all home and visitors' blocks; a visitors' block meets all home blocks."""
        for batch in batches:
            if not batch.num_rows:
                continue
            r, c, is_home = cells(batch)
            node = batch.column("node").to_numpy().astype(np.uint64)
            block = np.where(is_home, node[r] % parts[c].astype(np.uint64), node[r] % visitor_parts[c].astype(np.uint64)).astype(np.int64)
            out = []
            for at_home, others, visiting in ((True, parts, False), (True, visitor_parts, True), (False, parts, True)):
                rows = np.flatnonzero(is_home == at_home)
                times = others[c[rows]]
                rows = np.repeat(rows, times)
                other = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                mine = block[rows] if at_home else parts[c[rows]] + block[rows]
                theirs = parts[c[rows]] + other if visiting and at_home else other
                out.append((r[rows], c[rows], np.minimum(mine, theirs), np.maximum(mine, theirs), mine))
            r, c, low, high, mine = (np.concatenate(z) for z in zip(*out, strict=True))
            for a in range(0, len(r), 20_000):
                z = slice(a, a + 20_000)
                t = batch.take(pa.array(r[z]))
                yield pa.RecordBatch.from_arrays([*(pa.array(q[z].astype(np.int32)) for q in (c, low, high, mine)), t.column("node"), t.column("copies"), t.column("v")], ["cell", "low", "high", "block", "node", "copies", "v"])

    def meet(t: pa.Table) -> pa.Table:
        block = t.column("block").to_numpy()
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        node, weight = t.column("node").to_numpy(), t.column("copies").to_numpy()
        x = unit(matrix(t.column("v").combine_chunks()))
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        allowed = (lambda p, q: p < q) if low == high else (lambda p, q: np.ones(len(p), bool))
        links, forest = join_block(x[left], x[right], left, right, allowed, cosine, weight)
        has = np.flatnonzero(links)
        a, b = np.array(forest, np.int64).reshape(-1, 2).T
        return pa.table({"node": pa.array(np.concatenate([node[has], node[a]])), "links": pa.array(np.concatenate([links[has], np.zeros(len(a), np.int64)])), "b": pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(node[b])])})

    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("cell", "low", "high", "block")), T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    dealt = nodes.select("node", "copies", "v").mapInArrow(deal, schema)
    met = dealt.groupBy("cell", "low", "high").applyInArrow(meet, "node long, links long, b long").checkpoint()
    links = met.where("b is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = components(met.where("b is not null").select(F.col("node").alias("a"), "b"))
    info = nodes.select("node", "copies", "least").join(links, "node", "left").join(named, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"), "least")
    least = info.groupBy("c").agg(F.min("least").alias("component_id"))
    info = info.join(least, "c").select("node", "n_links", "component_id")
    linked = every.where("v is not null").select("id", "node").join(info, "node").select(F.col("id").alias(id_col), "n_links", F.coalesce("component_id", "id").alias("component_id"), (F.col("id") == F.coalesce("component_id", "id")).alias("kept"))
    return linked.unionByName(blank)
