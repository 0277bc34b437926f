"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i says
whether term bucket i occurs in the text.  The pairwise part learns what an additive
model can't: that two terms are worse together than each alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, row_runs, with_fields

TERM = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20


def term_buckets(text: str | None) -> list[int]:
    """Distinct hashed terms (runs of letters, lower case) of the whole text."""
    return [zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in set(TERM.findall(text.lower()))] if text else []


def unexplained_pairs(owner: np.ndarray, column: np.ndarray, residual: np.ndarray, variance: np.ndarray, terms: int, most: int, least: float = 6.0, strip: int = 512) -> np.ndarray:
    """Terms of pairs over whose rows the residuals add up to ``least`` standard deviations or more.

    Such a sum takes at least ``least`` poorly explained rows that hold both terms, so only terms
    of that many come into question, the ``most`` most frequent ones if they are more: the pairs are
    counted as a product of matrices of terms, summed over blocks of rows, ``strip`` terms against all
    later ones at a time, so that no matrix of all pairs is held.
    """
    poor = np.abs(residual) >= 0.25
    seen = np.bincount(column[np.repeat(poor, np.diff(np.searchsorted(owner, np.arange(len(residual) + 1))))], minlength=terms)
    chosen = np.argsort(-seen, kind="stable")[:most]
    chosen = np.sort(chosen[seen[chosen] >= least])
    place = np.full(terms, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    # the chosen terms of every 256 rows, as cells of a matrix that is made anew for each strip
    blocks = []
    for at in range(0, len(residual), 256):
        cells = slice(*np.searchsorted(owner, [at, at + 256]))
        used = place[column[cells]] >= 0
        blocks.append((at, ((owner[cells][used] - at) * len(chosen) + place[column[cells][used]]).astype(np.int32)))
    found = np.zeros(len(chosen), bool)
    x = np.empty((256, len(chosen)), np.float32)
    for a in range(0, len(chosen), strip):  # of the pairs' matrix, right of the diagonal
        b = min(a + strip, len(chosen))
        total, spread = (np.zeros((b - a, len(chosen) - a), np.float32) for _ in range(2))
        for at, cells in blocks:
            n = len(residual[at : at + 256])
            x[:] = 0
            x.reshape(-1)[cells] = 1
            for sums, weight in ((total, residual), (spread, variance)):
                sums += (x[:n, a:b] * weight[at : at + 256, None].astype(np.float32)).T @ x[:n, a:]
        pairs = np.nonzero(np.triu(np.abs(total) / np.sqrt(spread + 1), 1) >= least)
        for side in pairs:
            found[a + side] = True
    return chosen[found]


@dataclass
class FactorizationMachine:
    """Weights over ``buckets``, the hashed terms that were kept (sorted)."""

    buckets: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """For rows of 0/1 features; O(features * factors) by the square-of-sum identity."""
        s = x @ self.factors
        pairs = 0.5 * ((s * s).sum(1) - (x * x) @ (self.factors**2).sum(1))
        return self.bias + x @ self.linear + pairs

    @classmethod
    def fit(cls, rows: list[list[int] | np.ndarray], labels: np.ndarray, features: int = 1024, pair_terms: int = 4096, rank: int = 8, epochs: int = 30, seed: int = 7) -> FactorizationMachine:
        """Keep the terms that differ most between the classes, then train by AdaGrad on log loss.

        Terms that tell nothing alone but much together join them: those of pairs that the machine
        over the first terms leaves unexplained; it is then trained anew over all.  ``features`` and
        ``pair_terms`` bound the terms that are picked alone and searched for pairs.

        Without rows of both labels, the constant prior is returned.
        """
        y = np.asarray(labels, np.float64)
        n, positives = len(y), float(y.sum())
        if not 0 < positives < n:
            prior = min(max(positives / (n + 1), 1e-6), 1 - 1e-6)
            return cls(np.empty(0, np.int64), float(np.log(prior / (1 - prior))), np.empty(0), np.empty((0, rank)))
        # 32-bit cells: the driver holds one row number and one term number for each term of each row
        sizes = [len(r) for r in rows]
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        terms = np.unique(np.concatenate([np.empty(0, np.int64), *(np.unique(np.concatenate([np.asarray(r) for r in rows[at : at + 1024]])) for at in range(0, n, 1024))]))
        column = np.concatenate([np.searchsorted(terms, np.asarray(r)).astype(np.int32) for r in rows])
        seen = np.bincount(column, minlength=len(terms))
        toxic = np.bincount(column[np.repeat(y > 0, sizes)], minlength=len(terms))
        base = positives / n
        z = np.abs(toxic - seen * base) / np.sqrt(seen * base * (1 - base) + 1.0)
        z[seen < min(5, 1 + n // 100)] = 0
        keep = np.sort(np.argsort(-z, kind="stable")[:features])
        keep = keep[z[keep] >= min(3.2, z.max())]  # what chance alone makes of many terms stays below
        model, p = cls._train(terms, keep, owner, column, y, rank, epochs, seed)
        more = np.setdiff1d(unexplained_pairs(owner, column, y - p, p * (1 - p), len(terms), pair_terms), keep)
        return cls._train(terms, np.union1d(keep, more), owner, column, y, rank, epochs, seed)[0] if len(more) else model

    @classmethod
    def _train(cls, terms: np.ndarray, keep: np.ndarray, owner: np.ndarray, column: np.ndarray, y: np.ndarray, rank: int, epochs: int, seed: int) -> tuple[FactorizationMachine, np.ndarray]:
        """The machine over the kept terms, and its probabilities of the rows."""
        n, base = len(y), float(y.mean())
        place = np.full(len(terms), -1, np.int32)
        place[keep] = np.arange(len(keep))
        x = np.zeros((n, len(keep)), np.uint8)
        for at in range(0, len(column), 1 << 20):
            to = place[column[at : at + (1 << 20)]]
            x[owner[at : at + (1 << 20)][to >= 0], to[to >= 0]] = 1

        rng = np.random.default_rng(seed)
        model = cls(terms[keep], float(np.log(base / (1 - base))), np.zeros(len(keep)), rng.normal(0, 0.02, (len(keep), rank)))
        g0, g1, g2 = 1e-6, np.full(len(keep), 1e-6), np.full((len(keep), rank), 1e-6)
        step, decay = 0.1, 2e-4
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, 128):
                rows_at = order[at : at + 128]
                b = x[rows_at].astype(np.float64)
                s = b @ model.factors
                error = 1 / (1 + np.exp(-np.clip(model.margin(b), -40, 40))) - y[rows_at]
                error /= len(rows_at)
                d0, d1 = float(error.sum()), b.T @ error + decay * model.linear
                d2 = b.T @ (error[:, None] * s) - model.factors * (b.T @ error)[:, None] + decay * model.factors
                g0, g1, g2 = g0 + d0 * d0, g1 + d1 * d1, g2 + d2 * d2
                model.bias -= step * d0 / g0**0.5
                model.linear -= step * d1 / np.sqrt(g1)
                model.factors -= step * d2 / np.sqrt(g2)
        margins = np.concatenate([model.margin(x[at : at + 1024].astype(np.float64)) for at in range(0, n, 1024)])
        return model, 1 / (1 + np.exp(-np.clip(margins, -40, 40)))

    @cached_property
    def place(self) -> dict[int, int]:
        return {int(b): i for i, b in enumerate(self.buckets)}

    def score(self, rows: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.buckets)))
        for i, row in enumerate(rows):
            hit = [self.place[b] for b in row if b in self.place]
            x[i, hit] = 1
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 16_000, **options) -> FactorizationMachine:
    """Fit on at most about ``sample_rows`` labelled documents, picked by a hash of their id.

    Null labels and ids are left out; several labels of one id count by their mean.
    Only the sampled ids (bounded by ``sample_rows``) are broadcast, and only hashed terms
    come back to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
    known = hash_sample(known, "__id", known.count(), sample_rows)

    def featurise(batches):
        for batch in batches:
            ids, texts, ys = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ys, pa.int32()), pa.array([np.array(term_buckets(t), "<i4").tobytes() for t in texts], pa.binary())], ["__id", "__y", "__f"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")
    kind = picked.schema["__id"].dataType.simpleString()
    rows = picked.select("__id", "__text", "__y").mapInArrow(featurise, f"__id {kind}, __y int, __f binary").groupBy("__id").agg(F.first("__y").alias("y"), F.min("__f").alias("f")).orderBy("__id").collect()
    return FactorizationMachine.fit([np.frombuffer(r.f, "<i4") for r in rows], np.array([r.y for r in rows]), **options)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    A narrow map over whole texts; null and empty texts get the bias alone.
    Columns of ``docs`` named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in (part for whole in batches for part in row_runs(whole, at)):
            score = np.empty(batch.num_rows)
            texts = batch.column(at).to_pylist()
            for i in range(0, len(texts), 512):
                score[i : i + 512] = model.score([term_buckets(t) for t in texts[i : i + 512]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, with_fields(docs.schema, score=T.DoubleType(), predicted=T.IntegerType()))
