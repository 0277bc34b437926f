"""ops 3 and 5 against brute force."""

import math

import numpy as np
import pytest

from verbflow.llm import embedding_dedup, topk


def vectors(seed, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[20:60] = x[5] + 0.15 * rng.normal(size=(40, d))
    x[60:90] = x[6]
    x[90:95] = 3 * x[7]
    return x.astype(np.float32)


def frame(spark, x, extra=()):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + list(extra), "vec_id bigint, embedding array<float>")


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [math.nan] + [1.0] * 15), (904, [math.inf] + [1.0] * 15), (905, [None] + [1.0] * 15)]


@pytest.mark.parametrize("block", [4096, 37])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "choose_pivots", lambda nodes, count, f=embedding_dedup.choose_pivots: f(nodes, 20 * 4096))
    x = vectors(1)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame(spark, x, ODD)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    comp = np.arange(len(x))
    for _ in range(20):
        comp = np.array([comp[near[i]].min() for i in range(len(x))])
    for i in range(len(x)):
        assert got[i] == (int(near[i].sum()) - 1, int(comp[i]), comp[i] == i)
    for i, _ in ODD:
        assert got[i] == (0, i, True)


def test_near_duplicates_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


@pytest.mark.parametrize(("block", "ranges", "spread"), [(32768, 64, False), (37, 64, False), (37, 4, True)])
def test_top_k(spark, monkeypatch, block, ranges, spread):
    """In one range, in many, and in ranges of several blocks; lengths alike (thirty the same) and far apart."""
    monkeypatch.setattr(topk, "VECTOR_BLOCK", block)
    monkeypatch.setattr(topk, "RANGES", ranges)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4096 if ranges == 64 else 2)
    x = vectors(2)
    if spread:
        x *= np.random.default_rng(8).gamma(1, 2, len(x)).astype(np.float32)[:, None]
    df = frame(spark, x, ODD[:2] + ODD[3:])
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_inner_products(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    v = np.floor(256 * x.astype(float))
    expected = []
    for q in range(0, len(x), 50):
        score = (v @ v[q]).astype(int)
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-score[i], i))[:5]
        expected += [(q, k, i, int(score[i])) for k, i in enumerate(order, 1)]
    assert got == expected


def test_equal_lengths_crowd_no_range(spark):
    df = spark.range(400).selectExpr("id", "CASE WHEN id < 200 THEN 2.0D ELSE id / 100D END norm")
    dealt, longest = topk.by_length(df, 8)
    sizes = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
    assert sum(sizes.values()) == 400 and max(sizes.values()) < 100
    rows = sorted(((r["range"], -r.norm) for r in dealt.collect()))
    assert [n for _, n in rows] == sorted(n for _, n in rows)
    assert all(longest[r] == max(-n for g, n in rows if g == r) for r in sizes)


def test_a_bound_keeps_short_vectors_away():
    """With the k-th best score known, a block that can't reach it returns nothing, and ties still count."""
    v = np.array([[3.0, 0.0], [2.0, 0.0], [1.0, 0.0]])
    q = np.array([[1.0, 0.0]])
    found = topk.search_block(q, np.array([9]), v, np.arange(3), np.eye(2), 2, np.array([2.0]))
    assert sorted(zip(*(a.tolist() for a in found[1:]), strict=True)) == [(0, 3), (1, 2)]
    assert len(topk.search_block(q, np.array([9]), v, np.arange(3), np.eye(2), 2, np.array([4.0]))[0]) == 0


def test_top_k_few_and_none(spark):
    df = frame(spark, vectors(3)[:3])
    assert topk.top_inner_products(df, df.where("vec_id = 0")).count() == 2
    assert topk.top_inner_products(df.limit(0), df.limit(0)).count() == 0


def test_search_prunes_nothing_it_needs():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(2000, 24)) * rng.gamma(1, 1, 2000)[:, None])
    q = v[::100]
    basis = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    ids = rng.permutation(2000)
    got = topk.search_block(q, ids[::100], v, ids, basis, 5, chunk=64)
    for i in range(len(q)):
        score = v @ q[i]
        best = sorted((k for k in range(2000) if k != 100 * i), key=lambda k: (-score[k], ids[k]))[:5]
        mine = [(int(b), int(c)) for a, b, c in zip(*got, strict=True) if a == i]
        assert sorted(b for b, _ in mine) == sorted(best)


def test_vectors_of_several_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="one length"):
        embedding_dedup.near_duplicates(df).collect()
    with pytest.raises(Exception, match="one length"):
        topk.top_inner_products(df, df).collect()


def test_huge_and_tiny_components_and_shared_ids(spark):
    """Squares that over- or underflow don't matter; rows that share an id are vectors of their own."""
    rows = [(1, [1e200, 1.01e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [-1.0, 1.0]), (4, [5.0, 5.1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (4, 3, 1, False)]
