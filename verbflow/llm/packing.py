"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece
lengths (at most ``capacity`` numbers) reaches the driver, which plans there which
lengths share a sequence: bin completion enumerates undominated fillings around the
largest piece left, prunes by the waste that a better plan could still afford, and keeps
best-fit solutions as incumbents.  A filling is applied as often as its lengths allow at
once, so planning costs the same for a thousand pieces or a billion.  The pieces then
find their places by their rank among pieces of their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import ensure_checkpoint_dir, row_runs, with_fields

#: White space as the byte-level pre-tokenizer's ``\s`` has it (the Unicode property White_Space).
WIDE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = r"\t-\r " + WIDE
#: No token crosses the borders of these chunks: a run of white space leaves its last
#: character to what follows, and only a plain space joins the characters after it.
CHUNK = re.compile(rf"[{WS}]+(?![^{WS}])| ?[^{WS}]+|[{WS}]")
#: White space other than a space or a line feed.
ODD = re.compile(rf"[\t\x0b-\r{WIDE}]")

Pattern = tuple[int, ...]


# --- planning ---------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any plan needs: by volume, and by what pieces over half a sequence leave to smaller ones.

    For every least size k: pieces over capacity - k stand alone, other large ones have room for what is
    left of theirs, and pieces from k to half a sequence must find room beside these or in sequences of their own.
    """
    number = np.zeros(capacity + 2, np.int64)
    for n, c in counts.items():
        number[n + 1] = c
    upto = np.cumsum(number)  # upto[n + 1]: pieces of n tokens at most
    volume = np.cumsum(number * np.arange(-1, capacity + 1))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    large = upto[capacity - k + 1] - upto[half + 1]
    room = capacity * large - (volume[capacity - k + 1] - volume[half + 1])
    small = volume[half + 1] - volume[k]
    return int((upto[-1] - upto[half + 1] + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in descending order, many equal pieces at a time."""
    open_: dict[int, list[list]] = {}  # room left -> [pattern, how many sequences]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, g in open_.items() if r >= length and g), default=None)
            if room is None:
                per = min(capacity // length, left)
                new = left // per
                open_.setdefault(capacity - per * length, []).append([(length,) * per, new])
                left -= new * per
                continue
            group = open_[room][-1]
            take = min(left, group[1])
            group[1] -= take
            open_.setdefault(room - length, []).append([(*group[0], length), take])
            if not group[1]:
                open_[room].remove(group)
            left -= take
    return [(tuple(p), n) for groups in open_.values() for p, n in groups if n]


def fillings(counts: dict[int, int], room: int, allowed: int, limit: int = 16, effort: int = 3000) -> list[Pattern]:
    """Undominated ways to fill ``room``, least waste first, wasting ``allowed`` at most.

    A single piece that fits exactly dominates all others.  A way is dominated if a piece
    left out could still be added, or could take the place of a smaller one.  ``limit`` and
    ``effort`` bound the search, not what is packed.  Larger pieces are tried first.
    """
    if room in counts:
        return [(room,)]
    lengths = [n for n in sorted(counts, reverse=True) if n <= room]
    rising = lengths[::-1]
    found: list[tuple[int, Pattern]] = []
    steps = 0

    def undominated(way: list[int], left: int) -> bool:
        if not left:
            return True
        used = Counter(way)

        def spare(low: int, high: int) -> bool:
            """Whether a piece over ``low`` and up to ``high`` is left over."""
            return any(counts[n] > used[n] for n in rising[bisect_right(rising, low) : bisect_right(rising, high)])

        return not spare(0, left) and not any(spare(a, a + left) for a in used)

    def walk(at: int, left: int, way: list[int]) -> None:
        nonlocal steps
        steps += 1
        if steps > effort or len(found) == limit and not found[-1][0]:
            return
        if left <= allowed and (left, tuple(way)) not in found and undominated(way, left):
            found.append((left, tuple(way)))
            found.sort(key=lambda x: (x[0], len(x[1])))
            del found[limit:]
        for i in range(at, len(lengths)):
            n = lengths[i]
            if n <= left and way.count(n) < counts[n]:
                walk(i, left - n, [*way, n])
                if steps > effort:
                    return

    # second pieces that fit exactly beside a first are found without a walk; a full list of them can't be bettered
    for n in lengths:
        rest = room - n
        if len(found) < limit and rest in counts and rest <= n and (rest != n or counts[n] > 1):
            found.append((0, (n, rest)))
    if len(found) < limit:
        walk(0, room, [])
    return [w for _, w in found] or ([()] if not lengths else [])


def unchained(plan: tuple | None) -> list[tuple[Pattern, int]]:
    """A chain (what came before, last) as a list."""
    out = []
    while plan:
        plan, last = plan
        out.append(last)
    return out[::-1]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 4000) -> list[tuple[Pattern, int]]:
    """Plan [(lengths that share a sequence, how often)].

    A branch takes a filling as often as it goes or once; it ends where the bound of what is left
    leaves nothing to gain.  ``nodes`` bounds the search for a better plan, not what is packed.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    least = lower_bound(counts, capacity)
    volume = sum(n * c for n, c in counts.items())
    # a branch is held as its parent's counts and what to take from them, and a plan as a chain of what was taken,
    # so the stack grows by a few numbers a branch, not by all counts
    stack: list[tuple] = [(counts, (), 0, None, 0, 0)]
    while stack and nodes > 0 and size > least:
        rest, pattern, many, plan, done, waste = stack.pop()
        nodes -= 1
        if many:
            need = Counter(pattern)
            rest = {n: left for n, c in rest.items() if (left := c - need.get(n, 0) * many)}
            plan = (plan, (pattern, many))
            done += many
        allowed = (size - 1) * capacity - volume - waste  # a better plan wastes this much at most
        if allowed < 0 or rest and done + lower_bound(rest, capacity) >= size:
            continue
        if not rest:
            best, size = unchained(plan), done
            continue
        # best fit of the rest is an incumbent too
        if nodes % 16 == 0:
            tail = best_fit(rest, capacity)
            whole = done + sum(n for _, n in tail)
            if whole < size:
                best, size = unchained(plan) + tail, whole
                continue
        top = max(rest)
        others = {n: c - (n == top) for n, c in rest.items() if c > (n == top)}
        ways = fillings(others, capacity - top, allowed)
        for way in reversed(ways):  # the stack then takes the least wasteful first
            pattern = (top, *way)
            need = Counter(pattern)
            lost = capacity - sum(pattern)
            times = min(rest[n] // k for n, k in need.items())
            if lost:
                times = min(times, allowed // lost)
            for many in sorted({min(1, times), times} - {0}):  # as often as it goes first, then once
                stack.append((rest, pattern, many, plan, done, waste + lost * many))
    return best


# --- tokens and pieces ------------------------------------------------------------------


class ChunkEncoder(dict):
    """ids of a byte-level BPE tokenizer as little-endian uint32, by chunks remembered up to ``limit``.

    A chunk is looked up as it stands; ``chunk -> ids of a space and the chunk`` are the
    entries of ``spaced``.  The ranks of the tokenizer's own file drive tiktoken, which is
    faster on single words; texts with a special token's spelling go to tokenizers whole.
    """

    #: The pre-tokenizer's pattern (fixed value).
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, tokenizer_json: str, limit: int = 400_000, prefix: str = "", encode=None):
        super().__init__()
        self.limit, self.prefix = limit, prefix
        if encode:
            self.ordinary = encode
            return
        import tiktoken

        self.json = tokenizer_json
        spec = json.loads(tokenizer_json)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.ordinary = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.special = list(special)
        self.spaced = ChunkEncoder("", limit, " ", self.ordinary)
        self.whole = None

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[chunk] = array("I", self.ordinary(self.prefix + chunk)).tobytes()
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            if self.whole is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_str(self.json)
                self.whole.no_truncation()
                self.whole.no_padding()
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        text = text.encode("utf-8", "replace").decode() if not text.isascii() else text
        if "  " in text or "\n " in text or ODD.search(text):
            return b"".join(map(self.__getitem__, CHUNK.findall(text)))
        # every space follows a letter or mark, so a token may start but not cross there
        first, *rest = text.split(" ")
        if not text.endswith(" ") and first:
            return b"".join([self[first], *map(self.spaced.__getitem__, rest)])
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = (tokens - 1) % capacity + 1 if tokens else 0
    spans = [(0, first)] if first else []
    return spans + [(s, capacity) for s in range(first, tokens, capacity)]


def tokenize_pieces(docs: DataFrame, tokenizer_json: str, *, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    kind = docs.schema[id_col].dataType

    def run(batches):
        encoder = ChunkEncoder(tokenizer_json)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in (row for part in row_runs(batch, 1) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                tokens = encoder.encode(text)
                tokens += end_id.to_bytes(4, "little")
                out += [(doc, i, s, n, zlib.crc32(tokens[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(tokens) // 4, capacity))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, nodes: int = 4000, buckets: int = 64) -> DataFrame:
    """One row per piece with its crc32, ``sequence_id`` and ``offset``.

    Null and empty texts are documents of the end token alone; repeated rows are packed
    as often as they occur.  Ranks are counted in ``buckets`` parts of each length, so that
    one length may hold any share of the rows; the offsets of the parts are broadcast
    (``capacity * buckets`` rows at most).  The pieces are written once to the checkpoint
    folder: the histogram and the placing read the same rows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    pieces = tokenize_pieces(docs, Path(tokenizer_path).read_text(encoding="utf-8"), id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id).checkpoint()
    pieces = pieces.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    parts = pieces.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    plan = bin_completion({r.length: r.n for r in parts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}, capacity, nodes)
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    here = Window.partitionBy("length", "__b").orderBy(id_col, "piece", "ids_crc32")
    ranked = pieces.withColumn("__r", F.row_number().over(here)).join(F.broadcast(offsets), ["length", "__b"]).select(*pieces.drop("__b").columns, (F.col("__at") + F.col("__r") - 1).alias("__rank"))

    slots: dict[int, list[tuple[int, int, int]]] = {}  # length -> (first rank, sequence of that rank, offset)
    used: Counter = Counter()
    base = 0
    for pattern, times in plan:
        at = 0
        for length in pattern:
            slots.setdefault(length, []).append((used[length], base, at))
            used[length] += times
            at += length
        base += times
    tables = {n: np.array(rows, np.int64) for n, rows in slots.items()}
    names = pieces.drop("__b").columns

    def place(batches):
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            length = batch.column("length").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine, t = np.flatnonzero(length == n), tables[int(n)]
                i = np.searchsorted(t[:, 0], rank[mine], "right") - 1
                seq[mine] = t[i, 1] + rank[mine] - t[i, 0]
                off[mine] = t[i, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, with_fields(pieces.drop("__b").schema, sequence_id=T.LongType(), offset=T.LongType()))
