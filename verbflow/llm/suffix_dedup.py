r"""Repeated passages by a sparse suffix array.

Of all suffixes (at word positions) only those that begin at content-selected positions
are kept: every run of ``words`` words is anchored at its minimiser, the k-word gram with the
least hash in it (the last of equal ones), so equal passages have the same anchor at the same
distance from their start.  Suffixes whose gram stands alone in the corpus drop out through a bitmap.
The rest travel by gram, with the words to the left and right that their passages reach.  There
they are sorted by the words from the anchor on, and by those before it read backwards;
comparing neighbours tells how far each agrees to either side, and passages that agree on both
sides are equal, word by word.  Adjoining passages merge into the longest spans.

Grams of more than HOT places would pile up in one task.  Their passages travel one by one,
under two independent 64-bit hashes of all their words.  In either case a block of texts hands on
each passage once, with a note that it repeats there.

Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case; they are compared by 32 bits of a hash
each, so two passages of 50 words are equal if 1600 bits are.  A passage repeats if it
occurs at two places, of two documents or of one.  Its first place (least id, then position) is
kept and all others are repeats.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, ascii_words, bucket_keys, gram_hashes, mix64, row_runs, shuffle_width

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: log2 of the bits of the bitmap of repeated grams that tasks get (8 MB), whatever the input's size.
REPEATED_BITS = 26
#: A gram of more places than this is hot.
HOT = 4096
#: Anchors and passages that a block of texts holds before it hands them on.
BLOCK_ANCHORS, BLOCK_PASSAGES = 150_000, 1_000_000


def anchors(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of minimisers, and for each the first and last of the runs of ``window`` grams that it anchors.

    A run is anchored at its least gram, the last of equal ones, which depends on the run alone.
    """
    if len(grams) < window:
        return (np.empty(0, np.int64),) * 3
    at = np.arange(len(grams))

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] <= grams[a], b, a)

    span = 1
    while 2 * span <= window:
        at = better(at[:-span], at[span:])
        span *= 2
    if span < window:
        at = better(at[: len(at) - (window - span)], at[window - span :])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def contexts(h: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, words: int, side: int) -> np.ndarray:
    """Words around anchors as (anchors, side + words) 32-bit numbers; 0 where none of an anchor's passages reaches."""
    short = np.zeros(len(h) + side + words, np.uint32)
    short[side : side + len(h)] = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    column = np.arange(side + words)
    out = np.lib.stride_tricks.sliding_window_view(short, side + words)[at]
    out[(column < (side - at + first)[:, None]) | (column >= (side - at + last + words)[:, None])] = 0
    return out


def neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and how many first words each shares with its predecessor there."""
    if not rows.shape[1]:
        return np.arange(len(rows)), np.zeros(len(rows), np.int64)
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    there = rows[order]
    differ = there[1:] != there[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if len(rows) > 1 else np.empty(0, np.int64)
    return order, np.r_[0, shared]


def classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """For every row a number that rows with the same first ``depth`` words have in common."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def judged(new: np.ndarray, rank: np.ndarray, start: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of passages sorted by (equal ones, document, start): which repeat, and which of these come first.

    A row that is there twice (the same document and start) is one; ``several`` has seen others.
    """
    again = ~new & np.r_[False, (rank[1:] == rank[:-1]) & (start[1:] == start[:-1])]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    repeats = np.zeros(len(new), bool)
    repeats[lead[(~new & ~again) | several]] = True
    return repeats[lead] & ~again, new


def compared(context: np.ndarray, rank: np.ndarray, at: np.ndarray, several: np.ndarray, words: int, side: int):
    """(rank, start, first) of all passages around anchors that repeat."""
    order = np.lexsort((at, rank))
    context, rank, at, several = context[order], rank[order], at[order], several[order]
    left, right = np.ascontiguousarray(context[:, :side][:, ::-1]), context[:, side:]
    most, least = (left != 0).sum(1), words - (right != 0).sum(1)  # words before the anchor in its passages
    by_left, by_right = neighbours(left), neighbours(right)
    out = [(rank[:0], at[:0], np.empty(0, bool))]
    for before in range(side + 1):
        mine = np.flatnonzero((least <= before) & (before <= most))
        if not len(mine):
            continue
        key = classes(*by_left, before)[mine] * (len(rank) + 1) + classes(*by_right, words - before)[mine]
        o = np.argsort(key, kind="stable")
        mine, key = mine[o], key[o]
        keep, first = judged(np.r_[True, key[1:] != key[:-1]], rank[mine], at[mine], several[mine])
        out.append((rank[mine[keep]], at[mine[keep]] - before, first[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def hot_compared(key: np.ndarray, rank: np.ndarray, start: np.ndarray, several: np.ndarray):
    """(rank, start, first) of all passages, named by two hashes each, that repeat."""
    order = np.lexsort((start, rank, key[:, 1], key[:, 0]))
    key, rank, start, several = key[order], rank[order], start[order], several[order]
    keep, first = judged(np.r_[True, (key[1:] != key[:-1]).any(1)] if len(key) else np.empty(0, bool), rank, start, several)
    return rank[keep], start[keep], first[keep]


class Documents:
    """Documents of a task, (id, hash of the text) each, in order of their ids."""

    def __init__(self, ids: list, marks: list[int]):
        pairs = list(zip(ids, marks, strict=True))
        self.names = sorted(set(pairs))
        place = {d: i for i, d in enumerate(self.names)}
        self.rank = np.fromiter((place[d] for d in pairs), np.int64, len(pairs))

    def bucket(self, width: int) -> np.ndarray:
        return np.fromiter((zlib.crc32(str(d).encode("utf-8", "replace")) % width for d, _ in self.names), np.int64, len(self.names))


def packets(kind: int, bucket: np.ndarray, rank: np.ndarray, docs: Documents, home: np.ndarray, **fields: np.ndarray) -> list[dict]:
    """Rows packed by bucket: the documents of a packet, each row's place among them, and the bytes of its fields."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    out = []
    for some in np.split(order, cuts[1:]) if len(order) else []:
        own, local = np.unique(rank[some], return_inverse=True)
        names = [docs.names[i] for i in own.tolist()]
        out.append({"bucket": int(home[bucket[some[0]]]), "kind": kind, "d": local.astype("<u4").tobytes(), "ids": [d for d, _ in names], "marks": [x for _, x in names], **{k: v[some].tobytes() for k, v in fields.items()}})
    return out


def runs(rank: np.ndarray, start: np.ndarray, first: np.ndarray):
    """(rank, low, high, first) of starts that follow each other."""
    order = np.lexsort((start, first, rank))
    rank, start, first = rank[order], start[order], first[order]
    cut = np.r_[True, (rank[1:] != rank[:-1]) | (first[1:] != first[:-1]) | (np.diff(start) > 1)] if len(rank) else np.empty(0, bool)
    low = np.flatnonzero(cut)
    high = np.r_[low[1:], len(rank)][: len(low)] - 1
    return rank[low], start[low], start[high], first[low]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 50, gram: int = 25, hot: int = HOT) -> DataFrame:
    """(id, first, start_word, n_words, text_hash): the longest spans of every document that repeat elsewhere.

    ``first`` tells the places that are kept from the repeats.  Rows that share an id and
    a text are one document; rows that share an id alone are documents of their own, told
    apart by ``text_hash`` (xxhash64 of the text).  Null, empty and shorter texts, and rows without
    an id, have no spans.  Very long texts are read whole and handed on in parts.  Other columns take no part.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    kind, side = docs.schema["id"].dataType, words - gram
    grams_of = gram_hashes

    def read(text: str, hashes: WordHashes):
        h = hashes.of(ascii_words(text))
        grams = grams_of(h, gram) if len(h) >= words else np.empty(0, np.uint64)
        at, first, last = anchors(grams, side + 1)
        return h, at, first, last, grams[at]

    def count(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [read(text, hashes)[4] for part in row_runs(batch, 0) for text in part.column(0).to_pylist()]
            value, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], ["k", "c"])

    several = docs.select("text").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).where("c > 1")
    bit = several.select(F.shiftrightunsigned("k", 64 - REPEATED_BITS).alias("h"), (F.col("c") > hot).alias("hot"))
    mask = lambda c: F.bit_or(F.when(c, F.expr("shiftleft(1L, cast(h & 63 as int))")).otherwise(F.lit(0).cast("long")))
    found = bit.groupBy(F.shiftright("h", 6).alias("w")).agg(mask(F.lit(True)).alias("v"), F.max("hot").alias("hot")).toArrow()
    repeated = np.zeros(1 << REPEATED_BITS - 6, np.int64)
    repeated[found.column("w").to_numpy()] = found.column("v").to_numpy()
    # hot grams are told by their word of 64 bits: those beside a hot one are dealt as it is, which costs time only
    heated = np.zeros(1 << REPEATED_BITS - 6, bool)
    heated[found.column("w").to_numpy()] = found.column("hot").to_numpy(zero_copy_only=False)
    sent = spark.sparkContext.broadcast((repeated, np.packbits(heated)))
    width = shuffle_width(spark)
    home = np.array(bucket_keys(spark, width))
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("d", "s", "m", "k")), T.StructField("ids", T.ArrayType(kind)), T.StructField("marks", T.ArrayType(T.LongType()))])

    def batch_of(rows: list[dict], id_type) -> pa.RecordBatch:
        types = {"bucket": pa.int32(), "kind": pa.int32(), **dict.fromkeys("dsmk", pa.binary()), "ids": pa.list_(id_type), "marks": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], list(types))

    def places(batches):
        """Anchors (kind 0), passages of hot grams (1), and passages that an earlier place of the block has already (2)."""
        hashes = WordHashes()
        hot_map = np.unpackbits(sent.value[1]).astype(bool)
        ids, marks, cold, warm, held, id_type = [], [], [], [], [0, 0], None

        def flush():
            known = Documents(ids, marks)
            doc_bucket, rows = known.bucket(width), []
            if cold:
                doc, at, key, context = (np.concatenate(z) for z in zip(*cold, strict=True))
                rank = known.rank[doc]
                name = np.zeros(len(context), np.uint64)
                for k, factor in enumerate(mix64(np.arange(1, side + words + 1, dtype=np.uint64))):
                    name += context[:, k] * factor
                order = np.lexsort((at, rank, name))
                rank, at, key, context, name = rank[order], at[order], key[order], context[order], name[order]
                new = np.r_[True, (name[1:] != name[:-1]) | (context[1:] != context[:-1]).any(1)]
                again = ~new & np.r_[False, (rank[1:] == rank[:-1]) & (at[1:] == at[:-1])]
                others = np.zeros(len(new), bool)
                others[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[~new & ~again]] = True
                rows += packets(0, (key[new] % np.uint64(width)).astype(np.int64), rank[new], known, home, s=at[new].astype("<u4"), m=others[new].view(np.uint8), k=context[new])
                rest = ~new & ~again
                low, high = at - (context[:, :side] != 0).sum(1), at + (context[:, side:] != 0).sum(1) - words
                rows += packets(2, doc_bucket[rank[rest]], rank[rest], known, home, s=np.stack([low[rest], high[rest]], 1).astype("<u4"))
            if warm:
                doc, start, key = (np.concatenate(z) for z in zip(*warm, strict=True))
                rank = known.rank[doc]
                order = np.lexsort((start, rank, key[:, 1], key[:, 0]))
                rank, start, key = rank[order], start[order], key[order]
                new = np.r_[True, (key[1:] != key[:-1]).any(1)]
                again = ~new & np.r_[False, (rank[1:] == rank[:-1]) & (start[1:] == start[:-1])]
                others = np.zeros(len(new), bool)
                others[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[~new & ~again]] = True
                rows += packets(1, (key[new, 0] % np.uint64(width)).astype(np.int64), rank[new], known, home, s=start[new].astype("<u4"), m=others[new].view(np.uint8), k=key[new])
                rest = ~new & ~again
                r, low, high, _ = runs(rank[rest], start[rest], np.zeros(int(rest.sum()), bool))
                rows += packets(2, doc_bucket[r], r, known, home, s=np.stack([low, high], 1).astype("<u4"))
            return batch_of(rows, id_type)

        for batch in (part for whole in batches for part in row_runs(whole, 1)):
            id_type = batch.schema.field(0).type
            for doc, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, at, first, last, keys = read(text, hashes)
                bits = (keys >> np.uint64(64 - REPEATED_BITS)).astype(np.int64)
                mine = ((sent.value[0][bits >> 6] >> (bits & 63)) & 1).astype(bool)
                heat = hot_map[bits >> 6]
                ids.append(doc)
                marks.append(mark)
                some = np.flatnonzero(mine & ~heat)
                for a in range(0, len(some), BLOCK_ANCHORS):
                    part = some[a : a + BLOCK_ANCHORS]
                    cold.append((np.full(len(part), len(ids) - 1), at[part], keys[part], contexts(h, at[part], first[part], last[part], words, side)))
                    held[0] += len(part)
                    if held[0] >= BLOCK_ANCHORS:
                        yield flush()
                        ids, marks, cold, warm, held = [doc], [mark], [], [], [0, 0]
                some = np.flatnonzero(mine & heat)
                if len(some):
                    size = last[some] - first[some] + 1
                    start = np.repeat(first[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    low, high = int(start[0]), int(start[-1])
                    both = np.stack([grams_of(x[low : high + words], words)[start - low] for x in (h, mix64(h + np.uint64(0x632BE59BD9B4E019)))], 1)
                    for a in range(0, len(start), BLOCK_PASSAGES):
                        part = slice(a, a + BLOCK_PASSAGES)
                        warm.append((np.full(len(start[part]), len(ids) - 1), start[part], both[part]))
                        held[1] += len(start[part])
                        if held[1] >= BLOCK_PASSAGES:
                            yield flush()
                            ids, marks, cold, warm, held = [doc], [mark], [], [], [0, 0]
        if ids:
            yield flush()

    def gathered(batches):
        """All packets of a partition by kind: (documents, rank, starts, several, keys)."""
        rows = [r for batch in batches for r in batch.to_pylist()]
        known = Documents([d for r in rows for d in r["ids"]], [x for r in rows for x in r["marks"]])
        base = np.cumsum([0, *(len(r["ids"]) for r in rows)])
        ranks = [known.rank[np.frombuffer(r["d"], "<u4").astype(np.int64) + b] for r, b in zip(rows, base, strict=False)]
        return rows, known, ranks

    def compare(batches):
        id_type, held = None, []
        for batch in batches:
            id_type = batch.schema.field(6).type.value_type
            held.append(batch)
        if not held:
            return
        rows, known, ranks = gathered(held)
        del held
        low, high, rank, first = [], [], [], []

        def add(r, a, b, f):
            rank.append(r), low.append(a), high.append(b), first.append(f)

        for what, shape, compared_by in ((0, side + words, lambda *x: compared(*x, words, side)), (1, 2, hot_compared)):
            mine = [i for i, r in enumerate(rows) if r["kind"] == what]
            if mine:
                join = lambda c, t: np.concatenate([np.frombuffer(rows[i][c], t) for i in mine])  # noqa: B023, E731
                add(*runs(*compared_by(join("k", "<u4" if what == 0 else "<u8").reshape(-1, shape), np.concatenate([ranks[i] for i in mine]), join("s", "<u4").astype(np.int64), join("m", np.uint8).astype(bool))))
        for r, k in zip(rows, ranks, strict=True):
            if r["kind"] == 2:
                s = np.frombuffer(r["s"], "<u4").astype(np.int64).reshape(-1, 2)
                add(k, s[:, 0], s[:, 1], np.zeros(len(k), bool))
        if rank:
            rank, low, high, first = (np.concatenate(x) for x in (rank, low, high, first))
            yield batch_of(packets(3, known.bucket(width)[rank], rank, known, home, s=np.stack([low, high], 1).astype("<u4"), m=first.view(np.uint8)), id_type)

    def spans(batches):
        """Adjoining passages of a document merge."""
        id_type, held = None, []
        for batch in batches:
            id_type = batch.schema.field(6).type.value_type
            held.append(batch)
        if not held:
            return
        rows, known, ranks = gathered(held)
        if not rows:
            return
        rank, first = np.concatenate(ranks), np.concatenate([np.frombuffer(r["m"], bool) for r in rows])
        low, high = np.concatenate([np.frombuffer(r["s"], "<u4").astype(np.int64).reshape(-1, 2) for r in rows]).T
        order = np.lexsort((high, low, first, rank))
        rank, first, low, high = rank[order], first[order], low[order], high[order]
        same = ~np.r_[True, (rank[1:] != rank[:-1]) | (first[1:] != first[:-1])]
        offset = np.cumsum(~same) * (int(high.max()) + 2 * words + 2)  # of each document and flag: running maxima don't cross
        reach = np.maximum.accumulate(high + offset)
        begin = np.flatnonzero(~same | np.r_[True, (low + offset)[1:] - reach[:-1] > words])
        end = np.r_[begin[1:], len(rank)] - 1
        until = (reach - offset)[end] + words
        for a in range(0, len(begin), 10_000):
            b = begin[a : a + 10_000]
            names = [known.names[i] for i in rank[b].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in names], id_type), pa.array(first[b]), pa.array(low[b].astype(np.int32)), pa.array((until[a : a + 10_000] - low[b]).astype(np.int32)), pa.array([x for _, x in names], pa.int64())], [id_col, "first", "start_word", "n_words", "text_hash"])

    placed = docs.mapInArrow(places, schema).repartition(width, "bucket")
    marked = placed.mapInArrow(compare, schema).repartition(width, "bucket")
    return marked.mapInArrow(spans, T.StructType([T.StructField(id_col, kind), T.StructField("first", T.BooleanType()), T.StructField("start_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("text_hash", T.LongType())]))


def without_repeats(text: str, spans: list[tuple[bool, int, int]]) -> str:
    """The text without its repeats (first, start_word, n_words), but with all words of first places.

    A run of words goes from its first word's start to its last word's end.
    """
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in WORD.finditer(raw)]
    gone = np.zeros(len(at) + 2, np.int8)
    for first, start, size in sorted(spans):  # repeats before first places
        gone[start + 1 : start + size + 1] = not first
    edges = np.diff(gone)
    out, last = [], 0
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 50, gram: int = 25) -> DataFrame:
    """``docs`` with the repeats cut out of the texts; every row stays, even with nothing left.

    Words of a passage's first place stay.  Rows that share an id and a text are cut alike, rows that
    share an id alone each by their own spans.  A column named n_chars is left as it is.
    """
    names = docs.columns
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, words=words, gram=gram)
    spans = spans.groupBy(F.col(id_col).alias("__d"), F.col("text_hash").alias("__x")).agg(F.collect_list(F.struct("first", "start_word", "n_words")).alias("__spans"))
    joined = docs.join(spans, (docs[id_col] == spans["__d"]) & (F.xxhash64(docs[text_col]) == spans["__x"]), "left").select(*(docs[c] for c in names), "__spans")
    at = names.index(text_col)

    def cut(batches):
        for batch in (part for whole in batches for part in row_runs(whole, at)):
            texts = [t if not s or t is None else without_repeats(t, [(x["first"], x["start_word"], x["n_words"]) for x in s]) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, docs.schema)
