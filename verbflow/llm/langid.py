"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (A-Z in lower case) in both directions, labels
every byte position, and a document's probabilities are the mean over all positions of
its whole text.  The state starts anew at white space, so a word's labels depend on the
word alone and are computed once for each distinct word that a worker meets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_words, hash_sample, row_runs, text_chunks, with_fields

LETTER = re.compile(r"[^\W\d_]")
#: Bytes read in one go; a longer word is read in several pieces, none is left out.
SPAN = 24


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to SPAN bytes as a matrix (words, longest) and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max())
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
    return flat.reshape(len(words), width), lengths


@dataclass
class Gru:
    """One direction: W reads the embedding (E, 3H), U the state (H, 3H), b the bias; gates: update, reset, candidate."""

    W: np.ndarray
    U: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (T, B, 3H) already times W plus b; returns the states (T, B, H)."""
        steps, batch, width = x.shape
        hidden = width // 3
        h = np.zeros((batch, hidden), x.dtype)
        out = np.empty((steps, batch, hidden), x.dtype)
        zr, cand = self.U[:, : 2 * hidden], self.U[:, 2 * hidden :]
        for t in range(steps):
            gates = sigmoid(x[t, :, : 2 * hidden] + h @ zr)
            z, r = gates[:, :hidden], gates[:, hidden:]
            c = np.tanh(x[t, :, 2 * hidden :] + (r * h) @ cand)
            m = mask[t][:, None]
            new = h + m * (1 - z) * (c - h)
            if keep is not None:
                keep.append((h, z, r, c, m))
            h = new
            out[t] = h
        return out

    def backward(self, d_out: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of U and of the inputs x, by backpropagation through time."""
        steps, batch, hidden = d_out.shape
        d_x = np.empty((steps, batch, 3 * hidden), d_out.dtype)
        d_u = np.zeros_like(self.U)
        carry = np.zeros((batch, hidden), d_out.dtype)
        zr, cand = self.U[:, : 2 * hidden], self.U[:, 2 * hidden :]
        for t in range(steps - 1, -1, -1):
            h, z, r, c, m = keep[t]
            d = d_out[t] + carry
            d_c = d * m * (1 - z) * (1 - c * c)
            d_z = d * m * (h - c) * z * (1 - z)
            d_rh = d_c @ cand.T
            d_r = d_rh * h * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], 1)
            d_u[:, : 2 * hidden] += h.T @ d_gates
            d_u[:, 2 * hidden :] += (r * h).T @ d_c
            carry = d * (1 - m * (1 - z)) + d_rh * r + d_gates @ zr.T
            d_x[t] = np.concatenate([d_gates, d_c], 1)
        return d_u, d_x


class BiGru:
    """Embedding of bytes, a Gru in each direction, and a softmax over classes at every position."""

    def __init__(self, classes: list[str], embed: int = 12, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.3, (256, embed)).astype(np.float32)
        make = lambda a, b: (rng.normal(0, 1, (a, b)) / np.sqrt(a)).astype(np.float32)
        self.ways = [Gru(make(embed, 3 * hidden), make(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32)) for _ in range(2)]
        self.out = make(2 * hidden, len(classes))
        self.bias = np.zeros(len(classes), np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.bias, *(a for g in self.ways for a in (g.W, g.U, g.b))]

    def _read(self, codes: np.ndarray, lengths: np.ndarray, keeps: list[list] | None = None):
        """States of both directions (T, B, 2H), aligned by position; mask (T, B)."""
        steps = codes.shape[1]
        mask = (np.arange(steps)[:, None] < lengths[None, :]).astype(np.float32)
        seen = self.embed[codes.T]
        states = []
        for way, g in enumerate(self.ways):
            x = seen @ g.W + g.b
            flip = slice(None, None, -1) if way else slice(None)
            # backwards, padding is read first: the mask holds the state at zero there
            h = g.forward(x[flip], mask[flip], None if keeps is None else keeps[way])
            states.append(h[flip])
        return np.concatenate(states, 2), mask, seen

    def label(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each word the sum over its positions of the class probabilities."""
        h, mask, _ = self._read(codes, lengths)
        logits = h @ self.out + self.bias
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        return (p * mask[:, :, None]).sum(0)

    def learn(self, words: dict[str, list[bytes]], steps: int = 1500, batch: int = 192, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross-entropy of every position; each batch draws evenly from the classes."""
        rng = np.random.default_rng(seed)
        params = self.arrays()
        first, second = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
        share = max(1, batch // len(self.classes))
        for step in range(1, steps + 1):
            picked = [words[c][i] for c in self.classes for i in rng.integers(0, len(words[c]), share)]
            y = np.repeat(np.arange(len(self.classes)), share)
            codes, lengths = padded(picked)
            keeps: list[list] = [[], []]
            h, mask, seen = self._read(codes, lengths, keeps)
            logits = h @ self.out + self.bias
            logits -= logits.max(2, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(2, keepdims=True)
            d = p
            d[:, np.arange(len(y)), y] -= 1
            d *= (mask / mask.sum())[:, :, None]
            grads = [np.zeros_like(self.embed), np.einsum("tbh,tbc->hc", h, d), d.sum((0, 1))]
            d_h = d @ self.out.T
            hidden = d_h.shape[2] // 2
            d_seen = np.zeros_like(seen)
            for way, g in enumerate(self.ways):
                flip = slice(None, None, -1) if way else slice(None)
                d_u, d_x = g.backward(d_h[:, :, way * hidden : (way + 1) * hidden][flip], keeps[way])
                d_x = d_x[flip]
                d_seen += d_x @ g.W.T
                grads += [np.einsum("tbe,tbh->eh", seen, d_x), d_u, d_x.sum((0, 1))]
            np.add.at(grads[0], codes.T.ravel(), d_seen.reshape(-1, d_seen.shape[2]))
            speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for a, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class Labeller:
    """Runs a model over documents and remembers up to ``limit`` distinct words."""

    def __init__(self, model: BiGru, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(model.classes)), np.float32)

    def _meet(self, words: set[bytes]) -> None:
        if len(self.place) + len(words) > self.limit:
            self.place, self.sums = {}, self.sums[:0]
        new = sorted((w for w in words if w not in self.place), key=len)
        if not new:
            return
        pieces = [(i, w[at : at + SPAN]) for i, w in enumerate(new) for at in range(0, len(w), SPAN)]
        pieces.sort(key=lambda p: len(p[1]))
        sums = np.zeros((len(new), len(self.model.classes)), np.float32)
        for at in range(0, len(pieces), 512):
            part = pieces[at : at + 512]
            np.add.at(sums, [i for i, _ in part], self.model.label(*padded([w for _, w in part])))
        start = len(self.sums)
        self.sums = np.concatenate([self.sums, sums])
        self.place.update((w, start + i) for i, w in enumerate(new))

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Mean class probabilities over all byte positions of each text; zeros for a text without words."""
        out = np.zeros((len(texts), len(self.model.classes)))
        for start, run in text_chunks(texts, 1 << 20):
            split = [ascii_words(t) for t in run]
            # no name for the memory here: emptied, it would live on beside the new one
            self._meet({w for words in split for w in words if w not in self.place} if self.place else set().union(*split))
            # a full memory may have been emptied above
            if any(w not in self.place for words in split for w in words):
                self._meet(set().union(*split))
            get = self.place.__getitem__
            for i, words in enumerate(split, start):
                if words:
                    total = self.sums[np.fromiter(map(get, words), np.int64, len(words))].sum(0, dtype=np.float64)
                    out[i] = total / total.sum()
        return out


def fit_langid(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 3_000, **options) -> BiGru | None:
    """Train on at most about ``sample_rows`` documents with text and language, picked by a hash of the id.

    None if no document qualifies.
    """
    usable = docs.where(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    total = docs.where(F.col(lang_col).isNotNull()).count()
    words: dict[str, list[bytes]] = {}
    for r in hash_sample(usable, "__id", total, sample_rows).select("l", "t").orderBy("l", "__id", "t").toLocalIterator():
        words.setdefault(r.l, []).extend(w[at : at + SPAN] for w in ascii_words(r.t) for at in range(0, len(w), SPAN))
    words = {k: v for k, v in sorted(words.items()) if v}
    if not words:
        return None
    model = BiGru(list(words))
    model.learn(words, **options)
    return model


def predict_langid(docs: DataFrame, model: BiGru | None, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, the mean probability of that language.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    Columns of ``docs`` named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        labeller = Labeller(model) if model else None
        for batch in (part for whole in batches for part in row_runs(whole, at)):
            texts = batch.column(at).to_pylist()
            has = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if labeller and has.any():
                p = labeller.probabilities(texts)
                pred[has] = np.array(model.classes, object)[p.argmax(1)[has]]
                score[has] = np.clip(p.max(1)[has], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred.tolist(), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_fields(docs.schema, lang_pred=T.StringType(), score=T.DoubleType()))
