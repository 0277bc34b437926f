"""ops 2 and 8 against the tokenizers library, and packing's rules."""

import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verbflow.llm import bpe, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("aA b  \t\n\r\x0b\x1c\x85\xa0 　éÉßİΣςσ'sS'tll12²½_-漢🙂​") + ["<|endoftext|>", "the ", "ing", " ''re"]


@pytest.fixture(scope="module")
def texts(prose):
    rng = random.Random(3)
    fuzz = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(800)]
    return [None, "", " ", "a  <|endoftext|>", "<|startoftext|>x  Y<|endoftext|>", "it's ''s I'LL", "aaaaaaaa" * 20, prose(3000, 1), "word " * 1500, "x" * 5000, *fuzz]


def plain(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_byte_chunks_equal_the_library(texts):
    encoder, library = packing.ChunkEncoder(open(BYTES, encoding="utf-8").read(), limit=500), plain(BYTES)
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_words_equal_the_library(documents, texts):
    library = plain(WORDS)
    got = {r.doc_id: r for r in bpe.encode_decode(documents(*enumerate(texts)), WORDS, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r.ids == ids and r.decoded == decoded and r.n_tokens == len(ids), repr(t)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_search_for_a_plan_holds_no_copies_of_the_counts():
    """Open branches hold what they take, not all that is left then; before, this took 44 MB."""
    rng = random.Random(5)
    counts = {n: rng.randrange(1, 400) for n in range(2, 1025)}
    tracemalloc.start()
    plan = packing.bin_completion(counts, 1024, nodes=800)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    packed = collections.Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for n in lengths:
            packed[n] += times
    assert packed == counts and peak < 35e6


def test_pack(documents, texts):
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    out = packing.pack(documents(*rows), BYTES, capacity=64).collect()
    library = plain(BYTES)
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted(pieces[i], key=lambda r: r.piece)
        mine = mine[::2] if i == 3 else mine
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 64 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    counts = collections.Counter(r.length for r in out)
    assert len(sequences) <= sum(n for _, n in packing.best_fit(counts, 64))
    assert len(sequences) >= packing.lower_bound(counts, 64)


def test_bin_completion_beats_best_fit():
    rng = np.random.default_rng(0)
    better = 0
    for _ in range(20):
        counts = collections.Counter(rng.integers(200, 500, 60).tolist())
        plan, fit = packing.bin_completion(counts, 1024), packing.best_fit(counts, 1024)
        used = collections.Counter()
        for pattern, n in plan:
            assert sum(pattern) <= 1024
            for k in pattern:
                used[k] += n
        assert used == counts
        assert sum(n for _, n in plan) <= sum(n for _, n in fit)
        better += sum(n for _, n in plan) < sum(n for _, n in fit)
    assert better > 5


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place for every piece."""
    best = len(lengths)

    def put(at, room):
        nonlocal best
        if len(room) >= best:
            return
        if at == len(lengths):
            best = len(room)
            return
        for i, left in enumerate(room):
            if left >= lengths[at] and left not in room[:i]:
                put(at + 1, [*room[:i], left - lengths[at], *room[i + 1 :]])
        put(at + 1, [*room, capacity - lengths[at]])

    put(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(9)
    cases = [([5, 8, 8, 7, 9, 10, 8, 10, 4, 5], 19)] + [([rng.randint(1, c) for _ in range(rng.randint(1, 9))], c) for c in rng.choices(range(8, 40), k=400)]
    for lengths, capacity in cases:
        lengths.sort(reverse=True)
        plan = packing.bin_completion(collections.Counter(lengths), capacity)
        assert sorted((n for p, k in plan for n in p * k), reverse=True) == lengths and all(sum(p) <= capacity for p, _ in plan)
        assert packing.lower_bound(collections.Counter(lengths), capacity) <= sum(k for _, k in plan) == fewest(lengths, capacity), (lengths, capacity)


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), BYTES).collect() == []
