"""ops 4, 7, 9 and 10: accuracy on held-out cases and defined results at the edges."""

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from verbflow.llm import html_extract, langid, lm_score, toxicity
from verbflow.llm.common import ascii_words


def test_factorization_machine_learns_a_pair():
    """Neither term alone is toxic, both together are: no additive model can tell."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        noise = rng.integers(10, 60, 6).tolist()
        rows.append(noise + [1] * a + [2] * b)
        labels.append(int(a and b))
    model = toxicity.FactorizationMachine.fit(rows, np.array(labels))
    p = model.score([[1, 20], [2, 20], [1, 2, 20], [20]])
    assert p[2] > 0.5 and max(p[0], p[1], p[3]) < 0.5


def test_terms_that_tell_nothing_alone():
    """Toxic where exactly one of two terms occurs: each alone is as frequent in both classes."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        words = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in rng.choice(300, 25, replace=False)] + ["left"] * a + ["right"] * b
        rows.append(toxicity.term_buckets(" ".join(words)))
        labels.append(int(a != b))
    model = toxicity.FactorizationMachine.fit(rows[:900], np.array(labels[:900]))
    assert set(toxicity.term_buckets("left right")) <= set(model.buckets.tolist())
    assert np.mean((model.score(rows[900:]) >= 0.5) == np.array(labels[900:])) > 0.95


def test_pairs_are_counted_in_strips():
    """The same terms however wide the strips are, and never a matrix of all pairs."""
    rng = np.random.default_rng(4)
    n, terms, each = 1500, 2000, 20
    owner, column = np.repeat(np.arange(n), each), np.concatenate([np.sort(rng.choice(terms, each, replace=False)) for _ in range(n)])
    both = np.isin(np.arange(n), owner[column == 3]) ^ np.isin(np.arange(n), owner[column == 1900])
    column[owner < 200] = np.tile(np.r_[3, 1900, 100:118], 200)
    residual = np.where(np.arange(n) < 200, 0.5, np.where(both, -0.3, 0.3 * rng.choice([-1, 1], n)))
    variance = np.full(n, 0.25)
    wide = toxicity.unexplained_pairs(owner, column, residual, variance, terms, terms, strip=terms)
    tracemalloc.start()
    narrow = toxicity.unexplained_pairs(owner, column, residual, variance, terms, terms, strip=100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {3, 1900} <= set(wide.tolist()) and wide.tolist() == narrow.tolist()
    assert peak < terms * terms * 4


def test_toxicity(spark, documents, prose):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        bad = rng.random() < 0.2
        rows.append((i, prose(60, i) + (" you IDIOT!! " if bad else " ") + prose(10, 1000 + i)))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks[:300], (5, None), (None, 1)], "doc_id bigint, toxic int")
    docs = documents(*rows, (900, None), (901, ""))
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 402
    assert all(got[i].predicted == y for i, y in marks[300:])
    assert got[900].score == got[901].score


def test_toxicity_without_labels(spark, documents):
    docs = documents((1, "a"), (2, None))
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r.predicted for r in toxicity.score_toxicity(docs, model).collect()] == [0, 0]


def language(parts, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


PARTS = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["ção", "lho", "nha"]}


def test_langid(spark):
    rows = [(i, language(PARTS[k], i), k) for i in range(150) for k in PARTS if i % 3 == "aabbcc".index(k) // 2]
    train = spark.createDataFrame([*rows[:100], (900, "ka", None), (901, None, "aa")], "doc_id bigint, text string, lang string")
    model = langid.fit_langid(train, steps=250)
    test = spark.createDataFrame([*rows[100:], (902, None, "aa"), (903, "12 $$$", "aa"), (904, "ung" * 4000, "bb"), (905, "", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.predict_langid(test, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[100:])
    assert [got[i].lang_pred for i in (902, 903, 905)] == ["und"] * 3 and got[904].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit_langid(test.where("false")) is None


@pytest.mark.parametrize("kind", ["language", "toxicity"])
def test_maps_hold_a_run_of_texts(spark, documents, prose, monkeypatch, kind):
    """A batch of long texts is read run by run, none left out: 24 MB of text never stand beside each other."""
    if kind == "language":
        stage = lambda docs: langid.predict_langid(docs, langid.BiGru(["aa", "bb"]))
    else:
        stage = lambda docs: toxicity.score_toxicity(docs, toxicity.FactorizationMachine(np.arange(3), 0.5, np.ones(3), np.ones((3, 2))))
    long = prose(15_000, 1)
    texts = [None, "", *(f"{long} {prose(3, i)}" for i in range(300)), "ka lo", prose(300_000, 2)]
    assert sum(len(t or "") for t in texts) > 24 << 20
    monkeypatch.setattr(type(documents((1, ""))), "mapInArrow", lambda self, run, schema: run)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    run = stage(documents((1, "")).select("text"))
    alone = [r for i in (0, 1, 2, 301, 302, 303) for out in run([batch.slice(i, 1)]) for r in out.drop_columns("text").to_pylist()]
    tracemalloc.start()
    try:
        outs = list(run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pa.Table.from_batches(outs).column("text").to_pylist() == texts
    rows = pa.Table.from_batches(outs).drop_columns("text").to_pylist()
    for got, want in zip([rows[i] for i in (0, 1, 2, 301, 302, 303)], alone, strict=True):
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-5 if isinstance(want[c], float) else got[c] == want[c] for c in want)
    assert peak < 24 << 20


def test_langid_learns_from_all_of_a_long_word(spark, monkeypatch):
    """Texts without spaces count with all their pieces, as they are read when predicting."""
    seen = {}
    monkeypatch.setattr(langid.BiGru, "learn", lambda self, words, **_: seen.update(words))
    text = "日本語" * 9
    langid.fit_langid(spark.createDataFrame([(1, text + " ka", "ja")], "doc_id bigint, text string, lang string"))
    assert b"".join(seen["ja"]) == text.encode() + b"ka" and max(map(len, seen["ja"])) == langid.SPAN


def test_langid_gradient():
    """Backpropagation through time against finite differences."""
    model = langid.BiGru(["a", "b"], embed=3, hidden=4, seed=1)
    for arrays in (model.arrays(),):
        for a in arrays:
            a[...] = np.random.default_rng(len(a)).normal(0, 0.5, a.shape)
    codes, lengths = langid.padded([b"abc", b"ba"])
    p0 = model.label(codes, lengths)
    assert np.allclose(p0.sum(1), lengths, atol=1e-4)
    words = {"a": [b"kala", b"lo"], "b": [b"ungs", b"ber"]}
    before = model.label(*langid.padded(words["a"]))[:, 0].sum()
    model.learn(words, steps=60, batch=4)
    assert model.label(*langid.padded(words["a"]))[:, 0].sum() > max(before, 0.8 * 6)


def test_lm_score(spark, prose):
    rows = [(i, prose(80, i) + (" Zebra" if i % 2 else "")) for i in range(60)] + [(100, None), (101, "unseenword unseen2"), (102, "x" * 3000)]
    df = spark.createDataFrame([(i, t, i % 3 != 0, "k") for i, t in rows], "doc_id bigint, text string, learn boolean, lang string")
    got = {r.doc_id: r for r in lm_score.score_texts(df, learn_col="learn").collect()}
    tokens = {i: [*(t or "").encode().lower().split(), "END"] for i, t in rows}
    counts = collections.Counter(w for i, ws in tokens.items() if i % 3 != 0 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        assert abs(r.base_score - base) < 1e-6 and r.n_tokens == len(ws) and r.train_tokens == total
        assert r.n_known == sum(counts[w] > 0 for w in ws) and r.held_out == (i % 3 == 0)
        assert np.isfinite(r.score) and r.score < 0
    held = [r for i, r in got.items() if i % 3 == 0 and i < 60]
    # the unigram model is this source itself (even draws from 42 words), so none can be better by more than chance
    assert sum(r.score for r in held) > 1.01 * sum(r.base_score for r in held)


def test_lm_beats_unigram_on_new_words(spark):
    """Words made of syllables: the unigram score knows nothing of those it hasn't met."""
    parts = ["ka", "lo", "mi", "ber", "sch", "ung", "nha", "ta", "vo", "rin", "pe", "dul"]
    df = spark.createDataFrame([(i, language(parts, i, 80), i % 4 != 0, "k") for i in range(160)], "doc_id bigint, text string, learn boolean, lang string")
    held = [r for r in lm_score.score_texts(df, learn_col="learn").collect() if r.held_out]
    assert len(held) == 40 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_tables_and_stream_grow_with_the_training_words(spark, monkeypatch):
    """More distinct words get more slots, every class has its own counts, and longer corpora a longer stream."""
    assert lm_score.doublings(10) == 0 and lm_score.doublings(3 << 19) == 2 and lm_score.doubled(int(lm_score.BASE[-1]) << 3) == 3
    words = [b"%d" % i for i in range(3000)]
    h = lm_score.contexts(words)
    taken = [len(np.unique(lm_score.all_lines(h[2], h[0], 0, extra)[1, 4])) for extra in (0, 3)]
    assert taken[0] < taken[1]
    monkeypatch.setattr(lm_score, "SLOTS", (8, 8, 8, 8, 8, 8))
    monkeypatch.setattr(lm_score, "BASE", np.arange(7) * 256)
    monkeypatch.setattr(lm_score, "TOKENS_PER_STEP", 2)
    streams, sizes, least = [], [], []
    real, of = lm_score.Mixer.merge, lm_score.Mixer.of

    def merge(self, parts):
        real(self, parts)
        streams.append(self.used.sum())
        least.append(self.classes)

    monkeypatch.setattr(lm_score.Mixer, "merge", merge)
    monkeypatch.setattr(lm_score.Mixer, "of", classmethod(lambda cls, tables, classes: sizes.append(tables.shape[1]) or of(tables, classes)))
    for n in (20, 200):
        df = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20)), True, f"k{i % 9}") for i in range(n)], "doc_id bigint, text string, learn boolean, lang string")
        assert df.count() == lm_score.score_texts(df, learn_col="learn", stream_words=10).count()
    assert sizes[1] > sizes[0] and streams[1] > 5 * streams[0] and least == [10, 10]


def test_lm_weights_learn_from_all_training_tokens(spark, monkeypatch):
    """What the merged weights have used adds up to every bit of every training token, as often as it occurs."""
    counts = np.array([0, 1, 64, 65, 200, 0])
    whose, tokens = lm_score.learning_pieces(counts, 64, [1])
    assert np.bincount(whose, tokens, 6).tolist() == counts.tolist() and tokens.min() > 0 and tokens.max() <= 64 and len(whose) == 8
    used, real = [], lm_score.Mixer.merge

    def merge(self, parts):
        real(self, parts)
        used.append(self.used.sum())

    monkeypatch.setattr(lm_score.Mixer, "merge", merge)
    texts = [" ".join(["the"] * (i % 70) + [f"rare{i}"]) for i in range(300)]
    df = spark.createDataFrame([(i, t, i % 5 != 0, f"k{i % 2}") for i, t in enumerate(texts)], "doc_id bigint, text string, learn boolean, lang string")
    assert lm_score.score_texts(df, learn_col="learn", stream_words=10).count() == 300
    bits = 8 * sum(len(w) + 1 for i, t in enumerate(texts) if i % 5 for w in [*t.split(), "."])
    assert abs(used[0] * 64 - bits) < 1e-6 * bits


def test_lm_map_stays_a_probability():
    """Steps in which hundreds of bytes share a gate and a cell of the map don't overshoot."""
    words = [b"aaaaaaaaaaaa", b"aaaaaaaaaaab"] * 6400
    tables = np.zeros((2, lm_score.BASE[-1]), np.float32)
    lm_score.count_bits(words[:2], np.full((2, 1), 6400), tables)
    mixer = lm_score.Mixer(np.empty(0), np.empty(0), 1)
    mixer.learn(words, np.zeros(len(words), np.int64), np.ones(len(words)), tables)
    assert np.isfinite(mixer.weights).all()
    used = mixer.mapped > 0
    assert np.isfinite(mixer.refine).all() and mixer.refine[4 * 3 + 2, 0] < 0.01 and used.any()


def test_lm_probabilities_add_up():
    """Over all first bytes, and over all next bytes of a prefix, probabilities sum to one."""
    tables = np.zeros((2, lm_score.BASE[-1]), np.float32)
    lm_score.count_bits([b"kalo", b"kami", b"ta"], np.array([[3], [1], [2]]), tables)
    mixer = lm_score.Mixer.of(tables, 1)
    first = mixer.log10_words([bytes([b]) for b in range(256)], [0], first=True)[:, 0]
    assert abs((10.0**first).sum() - 1) < 1e-3
    counts = np.random.default_rng(1).integers(0, 3, (lm_score.ROWS + 1) * 256)
    assert np.allclose(np.exp(lm_score.after_word(counts)).sum(1), 1)


def test_lm_evaluates_a_prefix_once(monkeypatch):
    """Words that begin alike are evaluated once as far as they do, with the result each has alone."""
    rng = random.Random(5)
    words = sorted({("stem" * 5 + "".join(rng.choice("abxyz") for _ in range(rng.randrange(6)))).encode() for _ in range(400)} | {b"\x00", "é€".encode(), b"stem"})
    rng.shuffle(words)
    tables = np.zeros((2, lm_score.BASE[-1]), np.float32)
    lm_score.count_bits(words, np.full((len(words), 2), 3), tables)
    assert tables.sum() == 2 * 3 * 6 * 8 * sum(len(w) + 1 for w in words)
    mixer = lm_score.Mixer.of(tables, 2)
    alone = np.concatenate([mixer.log10_words([w], [0, 1]) for w in words[:40]])
    sizes, real = [], lm_score.salted
    monkeypatch.setattr(lm_score, "salted", lambda h, cls: sizes.append(h.shape[1]) or real(h, cls))
    together = mixer.log10_words(words, [0, 1])
    assert np.allclose(alone, together[:40], atol=1e-4)
    assert sum(sizes) <= 2 * 2 * len({(w + b" ")[: i + 1] for w in words for i in range(len(w) + 1)})


def test_lm_words_are_those_of_ascii_words():
    rng = random.Random(6)
    letters = [chr(i) for i in range(0x180)] + [" "] * 60 + [" ", "　", "\U0001f600"]
    texts = [None, "", " \t", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300))]
    for kind in (pa.string(), pa.large_string()):
        words, number, many = lm_score.numbered_words(pa.array(["x", *texts], kind).slice(1))
        expected = [ascii_words(t) for t in texts]
        assert many.tolist() == list(map(len, expected))
        assert [words[i] for i in number] == [w for x in expected for w in x] and len(set(words)) == len(words)


def test_lm_reads_in_order():
    """A text's probability is that of its words one after the other, by a plain loop."""
    rng = np.random.default_rng(2)
    vocabulary, k = 12, 3
    ways = np.log(rng.dirichlet(np.ones(vocabulary), k).T)
    entry, first, row = np.log(rng.dirichlet(np.ones(k))), rng.integers(0, 4, vocabulary), rng.integers(0, 5, vocabulary)
    first_of_way = np.log(np.stack([np.bincount(first, np.exp(ways[:, j]), 256) + 1e-300 for j in range(k)], 1))
    follows = np.log(rng.dirichlet(np.ones(256), lm_score.ROWS + 1))
    odds = rng.uniform(0.1, 0.9, lm_score.REPEAT_GATES * lm_score.BINS)
    texts = [rng.integers(0, vocabulary, n) for n in (1, 40, 7, 90)]
    word, starts = np.concatenate(texts), np.cumsum([0, 1, 40, 7])
    doc = np.repeat(np.arange(4), [1, 40, 7, 90])
    code = lm_score.repeats(word, doc)
    got = lm_score.read_in_order(word, starts, ways, entry, first_of_way, first, row, follows, code, odds)
    at = 0
    for t, total in zip(texts, got, strict=True):
        weight, log_p, met = np.exp(np.r_[entry, entry]) / 2, 0.0, {}
        before, pair = lm_score.ROWS, (None, None)
        for i, w in enumerate(t.tolist()):
            own = np.exp(ways[w])
            primed = own * np.exp(follows[before, first[w]]) / np.exp(first_of_way[first[w]])
            each = np.r_[own, primed]
            p = (weight * each).sum() / weight.sum()
            weight = weight * each
            guess = met.get(pair, met.get(pair[1:]))
            assert (guess is None) == (code[at] == 0)
            if guess is not None:
                q = odds[(int(code[at]) - 1) // 2]
                assert (code[at] - 1) % 2 == (guess == w)
                p = q * (guess == w) + (1 - q) * p
            log_p += np.log(p)
            met[pair] = met[pair[1:]] = w
            before, pair, at = row[w], (pair[1], w), at + 1
        assert abs(total - log_p) < 1e-6 * abs(log_p) + 1e-9


def test_lm_order_and_odd_words(spark, prose):
    """Another order of the same words has another score; a NUL byte is a word like any other."""
    rows = [(i, " ".join(["alpha beta gamma delta"] * 5)) for i in range(30)] + [(100, "alpha beta gamma delta"), (101, "delta gamma beta alpha"), (102, "a \0 b"), (103, "alpha beta alpha beta alpha beta"), (104, "alpha beta beta alpha alpha beta")]
    df = spark.createDataFrame([(i, t, i < 30, "k") for i, t in rows], "doc_id bigint, text string, learn boolean, lang string")
    got = {r.doc_id: r for r in lm_score.score_texts(df, learn_col="learn").collect()}
    assert got[100].score > got[101].score and got[103].score > got[104].score
    assert abs(got[102].base_score - (3 * np.log10(1 / (630 + 6)) + np.log10(31 / (630 + 6)))) < 1e-9


def test_lm_score_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, learn boolean, lang string")
    assert lm_score.score_texts(df, learn_col="learn").collect() == []
    df = spark.createDataFrame([(1, "a b", False, None)], "doc_id bigint, text string, learn boolean, lang string")
    r = lm_score.score_texts(df, learn_col="learn").collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and np.isfinite(r.score)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-banner"><p>We use cookies on this site.</p></div>
<article><h1>Kabel &amp; lodor</h1><p>First  paragraph of&nbsp;the text, long enough to count.<br>Its second line.<p>Second <b>bold</b> paragraph follows here.
<div class="ad">Buy now!</div><p>Last paragraph of this article.</p></article>
<div class="comments"><p>Nice post, thanks a lot!</p></div><footer>&copy; 2020 example</footer></body></html>"""


def test_blocks():
    texts = [b.text for b in html_extract.blocks_of(PAGE)]
    assert texts == ["Home", "News", "We use cookies on this site.", "Kabel & lodor", "First paragraph of the text, long enough to count. Its second line.", "Second bold paragraph follows here.", "Buy now!", "Last paragraph of this article.", "Nice post, thanks a lot!", "© 2020 example"]
    assert html_extract.blocks_of(None) == html_extract.blocks_of("") == html_extract.blocks_of("<p> </p>") == []
    assert [b.text for b in html_extract.blocks_of("plain < text")] == ["plain < text"]


def test_blocks_of_pages_that_leave_tags_out():
    text = lambda page: [b.text for b in html_extract.blocks_of(page)]
    assert text("<html><head><title>T</title><body><article><p>Hello world.</p></article></body></html>") == ["Hello world."]
    assert text("<head><title>T</title><meta charset=utf-8><p>No body tag.") == ["No body tag."]
    assert text('<p>One</p><script src="x" />var a = 1;</script><p>Two</p>') == ["One", "Two"]
    assert text("<p>One</p><select><option>A<p>Two</p>") == ["One", "A", "Two"]
    assert text("<p>One</p><svg width=1 /><p>Two</p><svg><text>no</text></svg><noscript>no</noscript>") == ["One", "Two"]


def test_lstm_gradient():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(3)
    way = html_extract.Lstm(*(rng.normal(0, 0.5, s) for s in ((3, 8), (2, 8), 8)))
    x, mask, want = rng.normal(0, 1, (5, 2, 3)), np.ones((5, 2)), rng.normal(0, 1, (5, 2, 2))
    mask[3:, 1] = 0
    loss = lambda: float((way.forward(x, mask) * want).sum())
    keep: list = []
    way.forward(x, mask, keep)
    grads, d_x = way.backward(x, want, keep)
    for array, grad in zip((way.W, way.U, way.b, x), (*grads, d_x), strict=True):
        for at in rng.integers(0, array.size, 6).tolist():
            old = array.flat[at]
            array.flat[at] = old + 1e-2
            up = loss()
            array.flat[at] = old - 1e-2
            down, array.flat[at] = loss(), old
            assert abs((up - down) / 2e-2 - grad.flat[at]) < 2e-2 * max(1, abs(grad.flat[at]))


def test_extract(spark, prose):
    pages = [(i, "u", PAGE if i == 0 else f"<html><body><nav><a>{prose(3, i)}</a></nav><article><p>{prose(30, i)}.</p></article></body></html>") for i in range(40)]
    df = spark.createDataFrame([*pages, (50, "u", None), (51, "u", "")], "page_id bigint, text string, html string")
    model = html_extract.fit_labeller(df)
    got = {r.page_id: r for r in html_extract.extract(df, model).collect()}
    assert got[0].text.split("\n") == ["Kabel & lodor", "First paragraph of the text, long enough to count. Its second line.", "Second bold paragraph follows here.", "Last paragraph of this article."]
    assert got[50].text == got[51].text == "" and got[50].n_chars == 0
    assert sum(got[i].text == f"{prose(30, i)}." for i in range(1, 40)) >= 38
    assert all(len(r.text) == r.n_chars for r in got.values())
