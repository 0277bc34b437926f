"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array.  In each round every word looks up the
ranks of its neighbouring pairs by binary search over the sorted pair keys, and merges
its lowest-ranked pair wherever it occurs; words without a known pair are done.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_chunks, with_fields


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return letters


class Bpe:
    """The tables of a tokenizer file of kind BPE over bytes, as numpy arrays."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        self.base = len(self.tokens)
        keys, made = [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] * self.base + vocab[b])
            made.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[order], order, np.array(made, np.int64)
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in one array, and where each word's ids begin (one entry more than words)."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        word = np.repeat(np.arange(len(raw)), size)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(size) - 1
        symbols[ends[size > 0]] = self.last[flat[ends[size > 0]]]
        known = symbols >= 0
        symbols, word = symbols[known], word[known]
        done_symbols, done_words = [], []
        never = len(self.keys)
        while len(symbols):
            # ranks of the pairs (i, i + 1) within words
            rank = np.full(len(symbols), never)
            same = np.flatnonzero(word[:-1] == word[1:])
            key = symbols[same] * self.base + symbols[same + 1]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            hit = self.keys[at] == key
            rank[same[hit]] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(symbols)])
            over = np.repeat(lowest == never, length)
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
            least = np.repeat(lowest, length)
            merge = (rank == least) & ~over
            # in a run of overlapping pairs every second one merges, from the left
            run_start = merge & ~np.r_[False, merge[:-1]]
            position = np.arange(len(merge))
            start_of = np.maximum.accumulate(np.where(run_start, position, 0))
            merge &= (position - start_of) % 2 == 0
            left = np.flatnonzero(merge)
            symbols = symbols.copy()
            symbols[left] = self.made[rank[left]]
            keep = ~over
            keep[left + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids = np.concatenate(done_symbols) if done_symbols else np.empty(0, np.int64)
        owner = np.concatenate(done_words) if done_words else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        begins = np.searchsorted(owner[order], np.arange(len(words) + 1))
        return ids[order], begins

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space."""
        return " ".join(self.tokens[i] for i in ids)


class Encoder:
    """Encodes texts; remembers for up to ``limit`` words their ids and tokens as joined strings."""

    def __init__(self, bpe: Bpe, limit: int = 150_000):
        self.bpe, self.limit = bpe, limit
        self.memory: dict[str, tuple[str, str]] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(bpe.specials, key=len, reverse=True))) + ")") if bpe.specials else None
        # \s as the Unicode property, whatever this library's default is
        self.split = regex.compile(bpe.pattern.replace(r"\s", r"\p{White_Space}"))

    def words(self, text: str) -> list[str]:
        """Pre-tokens after NFC and lower case, letter by letter (so a final sigma stays as it is)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split.findall(text.lower())

    def pieces(self, text: str | None) -> list[str]:
        """Pre-tokens and special tokens in order."""
        if not text:
            return []
        if self.special is None or "<|" not in text:
            return self.words(text)
        return [w for i, part in enumerate(self.special.split(text)) for w in ([part] if i % 2 else self.words(part))]

    def encode(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids, and its tokens, joined by one space."""
        out = []
        for _, run in text_chunks(texts, 2 << 20):
            split = [self.pieces(t) for t in run]
            met = set().union(*split)
            if len(self.memory) + len(met) > self.limit:
                self.memory = {s: (str(i), s) for s, i in self.bpe.specials.items()}
            elif not self.memory:
                self.memory = {s: (str(i), s) for s, i in self.bpe.specials.items()}
            new = [w for w in met if w not in self.memory]
            ids, begins = self.bpe.encode_words(new)
            ids, tokens = ids.tolist(), self.bpe.tokens
            for w, a, b in zip(new, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                mine = ids[a:b]
                self.memory[w] = (" ".join(map(str, mine)), " ".join([tokens[i] for i in mine]))
            get = self.memory.__getitem__
            for words in split:
                both = [p for p in map(get, words) if p[0]]
                out.append((" ".join([p[0] for p in both]), " ".join([p[1] for p in both])))
        return out


def encode_decode(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens`` and the SHA-256 of ids and decoded text.

    ``with_ids`` adds ``ids`` (array of int) and ``decoded``.  Null texts count as empty.
    A word spelled like a special token in the text becomes that token.  Columns of
    ``docs`` with the names of new ones are replaced.
    """
    bpe = Bpe(tokenizer_path)
    new = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if with_ids:
        new |= {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    docs = docs.drop(*new)
    names = docs.columns
    at = names.index(text_col)

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches):
        encoder = Encoder(bpe)
        for batch in batches:
            both = encoder.encode(batch.column(at).to_pylist())
            columns = [pa.array([i.count(" ") + 1 if i else 0 for i, _ in both], pa.int64()), pa.array([digest(i) for i, _ in both], pa.string()), pa.array([digest(d) for _, d in both], pa.string())]
            if with_ids:
                columns += [pa.array([[int(x) for x in i.split()] for i, _ in both], pa.list_(pa.int32())), pa.array([d for _, d in both], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *new])

    return docs.mapInArrow(run, with_fields(docs.schema, **new))
