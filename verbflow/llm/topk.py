"""Exact top-k inner products, searched in the order of falling norms.

Vectors are dealt by length into ranges, longest first, and rotated by the singular vectors
of the whole table, so that the first coordinates hold most of every product.  Every query
meets the range of the longest vectors first.  Its k-th best score there is what any other
vector has to reach: a range whose longest vector times the query's norm can't reach it
isn't visited, within a range the walk from the longest vector on ends at that point, and
the partial product of the first coordinates plus the product of the residual norms
(Cauchy-Schwarz) bounds what is worth an exact product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_checkpoint_dir

QUERY_BLOCK = 4096
VECTOR_BLOCK = 32768
#: Ranges of length; a range holds as many blocks as its vectors need.
RANGES = 64


def usable(column: str):
    """Not null, not empty, and no null or non-finite component."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad


def rotation(vectors: DataFrame, column: str) -> np.ndarray:
    """Right singular vectors of all vectors, from their Gram matrix (dimensions squared numbers to the driver)."""

    def gram(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0)).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d)), pa.array(np.tile(np.arange(d), d)), pa.array(total.ravel())], ["i", "j", "v"])

    cells = vectors.select(column).mapInArrow(gram, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    d = int(round(cells.num_rows**0.5))
    g = np.zeros((d, d))
    g[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    values, basis = np.linalg.eigh(g)
    return basis[:, np.argsort(-values)]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix; its lists must be of one length."""
    sizes = column.value_lengths()
    if len(column) and pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("vectors must be of one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, basis: np.ndarray, k: int, floor: np.ndarray | None = None, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vector index, score) of the k best of each query, ties to the smaller id.

    Vectors are integers held as doubles, so exact products have no rounding below 2**53.
    ``floor`` holds a score for each query that k vectors elsewhere reach; lower ones don't count.
    """
    norms = np.sqrt((vectors * vectors).sum(1))
    order = np.lexsort((ids, -norms))
    vectors, ids, norms = vectors[order], ids[order], norms[order]
    head = max(1, vectors.shape[1] // 4)
    rotated, turned = vectors @ basis, queries @ basis
    rest_v = np.sqrt(np.maximum(norms**2 - (rotated[:, :head] ** 2).sum(1), 0))
    norm_q = np.sqrt((queries * queries).sum(1))
    rest_q = np.sqrt(np.maximum(norm_q**2 - (turned[:, :head] ** 2).sum(1), 0))
    n = len(queries)
    best = np.full((n, k), -np.inf)
    best_at = np.full((n, k), -1)
    big = np.iinfo(np.int64).max
    best_id = np.full((n, k), big)
    alive = np.arange(n)
    floor = np.full(n, -np.inf) if floor is None else floor
    for a in range(0, len(vectors), chunk):
        b = min(a + chunk, len(vectors))
        alive = alive[norm_q[alive] * norms[a] * (1 + 1e-9) + 1e-6 >= np.maximum(best[alive, -1], floor[alive])]
        if not len(alive):
            break
        bound = turned[alive, :head] @ rotated[a:b, :head].T + np.outer(rest_q[alive], rest_v[a:b])
        bound += 1e-9 * np.outer(norm_q[alive], norms[a:b]) + 1e-6
        least = np.maximum(best[alive, -1], floor[alive])
        worth = (bound >= least[:, None]) & (query_ids[alive][:, None] != ids[a:b][None, :])
        q_at, v_at = np.nonzero(worth)
        if not len(q_at):
            continue
        if len(q_at) * 4 > worth.size:
            score = (queries[alive] @ vectors[a:b].T)[q_at, v_at]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", queries[alive[q_at[s : s + 65536]]], vectors[a + v_at[s : s + 65536]]) for s in range(0, len(q_at), 65536)])
        keep = score >= least[q_at]
        q_at, v_at, score = alive[q_at[keep]], a + v_at[keep], score[keep]
        touched = np.unique(q_at)
        all_q = np.concatenate([np.repeat(touched, k), q_at])
        all_s = np.concatenate([best[touched].ravel(), score])
        all_i = np.concatenate([best_id[touched].ravel(), ids[v_at]])
        all_v = np.concatenate([best_at[touched].ravel(), v_at])
        o = np.lexsort((all_i, -all_s, all_q))
        all_q, all_s, all_i, all_v = all_q[o], all_s[o], all_i[o], all_v[o]
        starts = np.searchsorted(all_q, touched)
        pick = (starts[:, None] + np.arange(k)[None, :]).ravel()
        best[touched], best_id[touched], best_at[touched] = (x[pick].reshape(-1, k) for x in (all_s, all_i, all_v))
    q, c = np.nonzero(best_at >= 0)
    return q, order[best_at[q, c]], best[q, c].astype(np.int64)


def top_inner_products(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Components become floor(scale * x).  A query is not its own candidate; ties go to the
    smaller id; fewer than k candidates give fewer rows.  Rows whose vector is null, empty or
    holds null or non-finite components take no part, nor do rows without an id; vectors
    must be of one length (others raise ValueError).  Blocks of queries meet blocks of vectors in tasks of their own,
    and each task hands on k rows per query, so neither side is broadcast or collected.  What the first range
    gives is written to the checkpoint folder and read for the bounds and for the result.
    Rows that share an id are candidates each, and an id that occurs several times as a
    query is searched once.
    """

    def prepared(df: DataFrame) -> DataFrame:
        scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
        rows = df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))
        return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)))

    spark = vectors.sparkSession
    base, asked = prepared(vectors), prepared(queries).dropDuplicates(["id"])
    n, m = base.count(), asked.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = rotation(base, "v")
    # few queries: let more blocks share the work, as many as the cluster shuffles into
    v_blocks = max(-(-n // VECTOR_BLOCK), min(-(-n // 2048), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    q_blocks, ranges = -(-m // QUERY_BLOCK), min(RANGES, v_blocks)
    parts = -(-v_blocks // ranges)
    base, longest = by_length(base, ranges)
    part = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")

    def search(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        ids = t.column("id").to_numpy()
        if asks.all() or not asks.any():
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        x = matrix(t.column("v").combine_chunks())
        q, v, s = search_block(x[asks], ids[asks], x[~asks], ids[~asks], basis, k, t.column("floor").to_numpy()[asks])
        return pa.table({"query_id": pa.array(ids[asks][q]), "vec_id": pa.array(ids[~asks][v]), "score": pa.array(s)})

    def best_of(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def meet(some: DataFrame, visits: DataFrame) -> DataFrame:
        """The k best of each (query, range) of ``visits``, from blocks of ``some`` vectors."""
        held = some.select("range", part(parts, 1).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.lit(False).alias("asks"), F.lit(0.0).alias("floor"), "id", "v")
        asking = visits.select("range", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), part(q_blocks, 2).alias("qb"), F.lit(True).alias("asks"), "floor", "id", "v")
        return held.unionByName(asking).groupBy("range", "part", "qb").applyInArrow(search, "query_id long, vec_id long, score long")

    lowest = F.lit(float("-inf"))
    found = best_of(meet(base.where("range = 0"), asked.withColumn("range", F.lit(0)).withColumn("floor", lowest)))
    if ranges > 1:
        ensure_checkpoint_dir(spark)
        found = found.checkpoint()
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        bounded = asked.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", lowest))
        # the same slack as in the blocks: norms are rounded, scores are not
        reach = F.filter(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(top).alias("top")) for r, top in sorted(longest.items()) if r)), lambda x: F.col("norm") * x["top"] * (1 + 1e-9) + 1e-6 >= F.col("floor"))
        visits = bounded.withColumn("range", F.explode(F.transform(reach, lambda x: x["r"])))
        found = best_of(found.drop("rank").unionByName(meet(base.where("range > 0"), visits)))
    return found.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")


def by_length(vectors: DataFrame, ranges: int) -> tuple[DataFrame, dict[int, float]]:
    """The vectors with the ``range`` of their norm, longest first, and the greatest norm of each range.

    Borders are approximate percentiles.  A norm that many vectors share is a border several times over;
    its vectors are dealt by id among the ranges it touches, so equal lengths crowd no range.
    """
    if ranges == 1:
        return vectors.withColumn("range", F.lit(0)), {0: float("inf")}
    borders = vectors.agg(F.percentile_approx("norm", [1 - i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    borders = F.array(*map(F.lit, borders))
    above = F.size(F.filter(borders, lambda b: b > F.col("norm")))
    level = F.size(F.filter(borders, lambda b: b == F.col("norm")))
    dealt = vectors.withColumn("range", (above + F.pmod(F.xxhash64("id", F.lit(3)), level + 1)).cast("int"))
    longest = {r["range"]: r.top for r in dealt.groupBy("range").agg(F.max("norm").alias("top")).collect()}
    return dealt, longest
