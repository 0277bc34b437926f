"""op 1 against brute force."""

import random

import numpy as np
import pytest

from verbflow.llm import ngram_join
from verbflow.llm.common import WordHashes, ascii_words
from verbflow.llm.graph import components


def brute(rows):
    """doc_id -> (n_shingles, component)"""
    sets = []
    for i, t in rows:
        w = ascii_words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    comp = {i: i for i, _ in rows}
    changed = True
    links = [(i, j) for i, a in sets for j, b in sets if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            least = min(comp[i], comp[j])
            if comp[i] != least or comp[j] != least:
                comp[i] = comp[j] = least
                changed = True
    return {i: (len(s), comp[i]) for i, s in sets}


def edited(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(8)
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  two"), (5, "one two three four five")]
    passage = prose(60, 1)
    texts = [prose(rng.choice([6, 12, 40, 200, 700]), s) for s in range(2, 26)]
    for t in texts:
        out.append((len(out), t))
        for _ in range(rng.randrange(4)):
            out.append((len(out), edited(t, max(1, len(t.split()) // rng.choice([15, 30, 60])), rng)))
    out += [(len(out) + k, prose(120, 100 + k) + " " + passage) for k in range(12)]
    family = prose(150, 77)
    out += [(len(out) + k, edited(family, rng.randrange(1, 7), rng)) for k in range(40)]
    out += [(len(out) + k, texts[3].upper()) for k in range(5)]
    return out


def test_equals_brute_force(documents, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(documents(*rows)).collect()}
    assert got == brute(rows)


def test_large_groups_are_dealt_into_blocks(documents, rows, monkeypatch):
    """Groups of many blocks, by count or by bytes, give the same components."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(ngram_join, "PAIRS", 0.2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(documents(*rows)).collect()}
    assert got == brute(rows)


def test_a_block_hands_on_a_forest(prose):
    """Links of a family of near copies: one fewer than the sets, whatever the number of linked pairs."""
    rng, hashes, bands = random.Random(5), WordHashes(), ngram_join.Bands(75, 100)
    family = prose(200, 1)
    sets = [ngram_join.shingles(hashes.of(ascii_words(edited(family, 2, rng))), 5) for _ in range(60)] + [ngram_join.shingles(hashes.of(ascii_words(prose(200, 2))), 5)]
    names, every, labels = list(range(len(sets))), np.arange(len(sets)), ngram_join.Labels()
    links = ngram_join.block_links(every, every, names, names, np.array([len(s) for s in sets]), [ngram_join.sketch(s) for s in sets], [s.tobytes() for s in sets], bands, labels)
    assert len(links) == 59 and len({labels.find(i) for i in range(60)}) == 1 and labels.find(60) == 60
    assert all(ngram_join.reaches(sets[a], sets[b], 75, 100) for a, b in links)


def test_clashing_columns(spark, prose):
    t = prose(50, 7)
    df = spark.createDataFrame([(5, t, 1, 2, 3), (4, t + " end", 1, 2, 3)], "doc_id bigint, text string, n int, component_id int, g int")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df).collect()) == [(4, 4), (5, 4)]


def test_repeated_rows_and_null_ids(documents, prose):
    t = prose(50, 5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in ngram_join.jaccard_components(documents((7, t), (7, t), (None, t), (3, t + " end"))).collect())
    assert got == [(False, 3, 3), (False, 7, 3), (False, 7, 3), (True, 0, 3)]


def test_blank_text_that_the_bitmap_lets_through(documents, prose):
    """A blank row that shares a representative's id leaves the ids of the other texts of its batch alone."""
    t = prose(50, 6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(documents((1, " "), (1, t), (2, t + " end"), (3, "")).coalesce(1)).collect())
    assert got == [(1, 0, 1), (1, 46, 1), (2, 47, 1), (3, 0, 3)]


def test_components_of_few_and_of_many_edges(spark):
    """One task and rounds of stars agree: paths, stars, loops, repeated edges."""
    rng = random.Random(3)
    edges = [(rng.randrange(-40, 200), rng.randrange(-40, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (1, 2), (2, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, many = (sorted(map(tuple, components(df, at_once=k).collect())) for k in (10**6, 0))
    assert one == many and (340, 300) in one
    assert components(df.where("false")).collect() == []


def test_empty_table(documents, spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.2], rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)]))
        x = ngram_join.folded([ngram_join.sketch(a), ngram_join.sketch(b)])
        assert ngram_join.apart(x[0], x[1]) <= len(np.setxor1d(a, b))


def test_links_share_a_signature():
    """Any choice of frequent shingles leaves a common key, and as many as promised."""
    rng = np.random.default_rng(2)
    bands = ngram_join.Bands(75, 100)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(len(a) * rng.random() * 0.25)
        b = a[drop:]
        if rng.random() < 0.5:
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, max(0, int(0.3 * len(a)) - drop)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(rng.choice(a, int(len(a) * rng.random()), replace=False))
        (ka, qa), (kb, qb) = (ngram_join.signatures(s, bands, frequent) for s in (a, b))
        assert len(np.intersect1d(ka, kb)) >= max(qa, qb, 1)


def test_words_are_ascii_words():
    assert ascii_words("A b\x1cc\tÉ d") == ["a b\x1cc".encode(), "É".encode(), b"d"]
    h = WordHashes(limit=2)
    assert h.of([b"a", b"b", b"c", b"a"])[0] == h.of([b"a"])[0]
