"""op 6 against brute force."""

import collections
import random

import numpy as np
import pytest

from verbflow.llm import suffix_dedup


def brute(rows, size=50):
    """(doc_id, first) -> covered word positions"""
    places = collections.defaultdict(set)
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        for k in range(len(w) - size + 1):
            places[tuple(w[k : k + size])].add((i, k))
    out = collections.defaultdict(set)
    for occ in places.values():
        if len(occ) > 1:
            for i, k in occ:
                out[(i, (i, k) == min(occ))].update(range(k, k + size))
    return out


def rows_of(prose):
    passage, other = prose(70, 1), prose(51, 2)
    rows = [(k, f"{prose(40 + k, 10 + k)} {passage} {prose(30, 50 + k)}") for k in range(6)]
    rows += [(20, f"{passage.upper()}\n{other}"), (21, f"x {other} y"), (22, other), (23, prose(300, 99)), (24, prose(300, 99)), (25, None), (26, ""), (27, "a " * 120), (28, "p q r s " * 30), (29, prose(49, 3)), (30, prose(49, 3)), (31, prose(4000, 4) + " " + other)]
    return rows


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_equals_brute_force(documents, prose, hot):
    """Grams dealt as suffixes, and all that occur more than twice as single passages."""
    rows = rows_of(prose)
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeated_spans(documents(*rows), hot=hot).collect():
        got[(r.doc_id, r.first)].update(range(r.start_word, r.start_word + r.n_words))
    assert got == brute(rows)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_short_passages_and_colliding_grams(documents, monkeypatch, hot):
    """Few different words and eight hashes for all grams: words decide, not hashes."""
    real = suffix_dedup.gram_hashes
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda words, n: real(words, n) if n > 4 else real(words, n) >> np.uint64(61) << np.uint64(61))
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(5, 60)))) for k in range(40)]
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeated_spans(documents(*rows), words=8, gram=4, hot=hot).collect():
        got[(r.doc_id, r.first)].update(range(r.start_word, r.start_word + r.n_words))
    assert got == brute(rows, 8)


def test_anchors_depend_on_the_passage_alone():
    rng = np.random.default_rng(4)
    for _ in range(50):
        grams = rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64)
        at, first, last = suffix_dedup.anchors(grams, 7)
        of = {s: a for a, f, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(f, e + 1)}
        for s in range(len(grams) - 6):
            run = grams[s : s + 7]
            assert of[s] == s + int(np.flatnonzero(run == run.min())[-1])
        assert len(of) == max(0, len(grams) - 6)


def test_rows_that_share_an_id(documents, prose):
    """Texts of one id are neither mixed nor lost, and clashing columns take no part."""
    t, other = prose(80, 1), prose(90, 2)
    rows = [(1, t), (1, f"{other} x"), (2, f"{prose(20, 3)} {t}"), (3, other), (1, t)]
    out = sorted((r.doc_id, r.text) for r in suffix_dedup.remove_repeats(documents(*rows)).collect())
    assert out == sorted([(1, t), (1, f"{other} x"), (2, f"{prose(20, 3)} "), (3, ""), (1, t)])
    df = documents(*rows).selectExpr("doc_id", "text", "1 as mark", "2 as id", "3 as bucket", "4 as first")
    assert suffix_dedup.repeated_spans(df).count() == 4


def test_removal_keeps_first_places(documents, prose):
    rows = rows_of(prose)
    spans = brute(rows)
    out = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(documents(*rows)).collect()}
    for i, t in rows:
        gone = spans[(i, False)] - spans[(i, True)]
        if t is None:
            assert out[i] is None
        else:
            assert out[i].split() == [w for k, w in enumerate(t.split()) if k not in gone]
    assert out[23] == prose(300, 99) and out[24] == ""
    assert out[29] == out[30] == prose(49, 3)


def test_string_ids_and_repeated_rows(spark, prose):
    t = prose(80, 1)
    df = spark.createDataFrame([("a", t), ("a", t), ("b", t), (None, t)], "doc_id string, text string")
    got = sorted((r.doc_id, r.first, r.n_words) for r in suffix_dedup.repeated_spans(df).collect())
    assert got == [("a", True, 80), ("b", False, 80)]


def test_empty(spark):
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
