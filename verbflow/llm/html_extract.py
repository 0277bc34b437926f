"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  Each block is a vector: hashed tags and
attribute words of its path, hashed words of its text, and a few numbers (length, share
of links, ...).  A bidirectional LSTM in numpy reads the whole sequence and classifies
every block, so a block's verdict depends on the whole page.

The network is trained here, on pages put together from the text of a bounded sample of
the given pages and a list of layouts: the same words occur in articles and around them,
and only structure, lengths and neighbours tell which is which.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, with_fields

#: Comments, elements whose content is no text (of the second kind only if they are closed), and single tags.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<svg\b[^>]*/>|<(noscript|template|svg|select)\b[^>]*>.*?</\2\s*>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 512, 512, 6


@dataclass
class Block:
    path: tuple[str, ...]  # tags and attribute words from the root down
    text: str
    link: int  # characters inside links


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space runs as one space, empty ones left out."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links, link_depth, in_head = 0, 0, False

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = tuple(w for tag, names in stack for w in (tag, *names))
                out.append(Block(path, text, links))
            parts.clear()
        links = 0

    def close(tag: str) -> None:
        nonlocal link_depth
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                link_depth -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return

    last = 0
    for m in TOKEN.finditer(page):
        if m.start() > last and not in_head:
            piece = page[last : m.start()]
            parts.append(piece)
            if link_depth > 0:
                links += len(piece)
        last = m.end()
        tag = m.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head" or in_head and tag in BLOCK and tag != "title":
            in_head = tag == "head" and not m.group(3)  # its end may be left out
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m.group(3):
            close(tag)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and any(t == "p" for t, _ in stack[-6:]):
            close("p")  # a paragraph ends where another block begins
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and any(t == tag for t, _ in stack[-2:]):
            close(tag)
        names: tuple[str, ...] = ()
        if m.group(5) and "=" in m.group(5):
            names = tuple(w for a, b, c in NAMES.findall(m.group(5)) for w in PART.findall((a or b or c).lower()))
        if tag == "a":
            link_depth += 1
        stack.append((tag, names))
        if len(stack) > 200:
            close(stack[1][0])
    if last < len(page) and not in_head:
        parts.append(page[last:])
    flush()
    return out


class Hashes(dict):
    def __init__(self, buckets: int, limit: int = 200_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, word) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % self.buckets
        return value


def features(pages: list[list[Block]], path_hash: Hashes, word_hash: Hashes, share_paths: bool = True):
    """For all blocks in a row: path buckets of the distinct paths and their owners, each block's path; word
    buckets and their owners; numbers.  Without ``share_paths`` paths are distinct within a page only."""
    paths, path_of, words, word_of, numbers, which = [], [], [], [], [], []
    seen: dict = {}
    for page in pages:
        total = len(page)
        if not share_paths:
            seen = {}
        for k, b in enumerate(page):
            mine = seen.get(b.path)
            if mine is None:
                mine = seen[b.path] = path_of[-1] + 1 if path_of else 0
                ids = [path_hash[w] for w in b.path] + [path_hash["last:" + w] for w in b.path[-3:]] or [path_hash[""]]
                paths += ids
                path_of += [mine] * len(ids)
            which.append(mine)
            split = b.text.split(" ")
            words += split
            word_of.append(len(split))
            size = len(b.text)
            numbers.append((np.log1p(size) / 6, min(1.0, b.link / size), (k + 0.5) / total, b.text[-1] in ".!?…:;\"'", min(1.0, len(split) / 20), np.log1p(total) / 5))
    word_ids = np.fromiter(map(word_hash.__getitem__, words), np.int64, len(words))
    return np.array(paths, np.int64), np.array(path_of, np.int64), np.array(which, np.int64), word_ids, np.repeat(np.arange(len(word_of)), word_of), np.array(numbers, np.float32).reshape(-1, NUMBERS)


def mean_rows(table: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean of the table's rows by owner; every dimension is one weighted count."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.stack([np.bincount(owner, table[ids, k], n) / count for k in range(table.shape[1])], 1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Lstm:
    """One direction: gates input, forget, output and candidate in one matrix over (x, h)."""

    W: np.ndarray
    U: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        steps, batch, _ = x.shape
        hidden = self.U.shape[0]
        z = x @ self.W + self.b
        h = c = np.zeros((batch, hidden), np.float32)
        out = np.empty((steps, batch, hidden), np.float32)
        for t in range(steps):
            a = z[t] + h @ self.U
            g = sigmoid(a[:, : 3 * hidden])
            i, f, o = g[:, :hidden], g[:, hidden : 2 * hidden], g[:, 2 * hidden :]
            u = np.tanh(a[:, 3 * hidden :])
            m = mask[t][:, None]
            new_c = m * (f * c + i * u) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep is not None:
                keep.append((h, c, i, f, o, u, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out

    def backward(self, x: np.ndarray, d_out: np.ndarray, keep: list) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of W, U, b and of x, by backpropagation through time."""
        steps, batch, hidden = d_out.shape
        d_z = np.empty((steps, batch, 4 * hidden), np.float32)
        d_u = np.zeros_like(self.U)
        dh = dc = np.zeros((batch, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, u, tc, m = keep[t]
            dh = dh + d_out[t]
            live = m * dh
            dc_t = dc * m + live * o * (1 - tc * tc)
            d_a = np.concatenate([dc_t * u * i * (1 - i), dc_t * c * f * (1 - f), live * tc * o * (1 - o), dc_t * i * (1 - u * u)], 1)
            d_z[t] = d_a
            d_u += h.T @ d_a
            dh = d_a @ self.U.T + (1 - m) * dh
            dc = dc_t * f + (1 - m) * dc
        return [np.einsum("tbi,tbj->ij", x, d_z), d_u, d_z.sum((0, 1))], d_z @ self.W.T


class BlockLabeller:
    def __init__(self, path_dim: int = 12, word_dim: int = 6, hidden: int = 16, seed: int = 23):
        rng = np.random.default_rng(seed)
        make = lambda a, b: (rng.normal(0, 1, (a, b)) / np.sqrt(a)).astype(np.float32)
        self.path = rng.normal(0, 0.3, (PATH_BUCKETS, path_dim)).astype(np.float32)
        self.word = rng.normal(0, 0.1, (WORD_BUCKETS, word_dim)).astype(np.float32)
        width = path_dim + word_dim + NUMBERS
        self.ways = [Lstm(make(width, 4 * hidden), make(hidden, 4 * hidden), np.zeros(4 * hidden, np.float32)) for _ in range(2)]
        self.out = make(2 * hidden + width, 1)
        self.bias = np.zeros(1, np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.path, self.word, self.out, self.bias, *(a for g in self.ways for a in (g.W, g.U, g.b))]

    def _sequence(self, x: np.ndarray, sizes: np.ndarray):
        """Rows (blocks of all pages) as (longest, pages, width), the mask, and where each row went."""
        steps = int(sizes.max())
        page = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seq = np.zeros((steps, len(sizes), x.shape[1]), np.float32)
        seq[at, page] = x
        return seq, (np.arange(steps)[:, None] < sizes[None, :]).astype(np.float32), at, page

    def logits(self, seq: np.ndarray, mask: np.ndarray, keeps: list[list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for way, g in enumerate(self.ways):
            flip = slice(None, None, -1) if way else slice(None)
            parts.append(g.forward(seq[flip], mask[flip], None if keeps is None else keeps[way])[flip])
        h = np.concatenate([*parts, seq], 2)
        return (h @ self.out)[:, :, 0] + self.bias[0], h

    def vectors(self, f) -> np.ndarray:
        paths, path_of, which, words, word_of, numbers = f
        n = len(numbers)
        return np.concatenate([mean_rows(self.path, paths, path_of, int(which.max()) + 1)[which], mean_rows(self.word, words, word_of, n), numbers], 1)

    def label(self, pages: list[list[Block]], path_hash: Hashes, word_hash: Hashes) -> list[np.ndarray]:
        """Probability of every block to belong to the article; pages of like length share a batch."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= 16_384:
                end += 1
            some = [pages[i] for i in order[at:end]]
            sizes = np.array([len(p) for p in some])
            seq, mask, row, col = self._sequence(self.vectors(features(some, path_hash, word_hash)), sizes)
            p = sigmoid(self.logits(seq, mask)[0])[row, col]
            for i, part in zip(order[at:end], np.split(p, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = part
            at = end
        return out

    def learn(self, pages: list[list[Block]], labels: list[np.ndarray], epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 29) -> None:
        """Adam on the cross-entropy of every block; parts of the paths are hidden at random."""
        rng = np.random.default_rng(seed)
        path_hash, word_hash = Hashes(PATH_BUCKETS), Hashes(WORD_BUCKETS)
        params = self.arrays()
        first, second = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
        step, steps = 0, max(1, epochs * -(-len(pages) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                step += 1
                some = [pages[i] for i in order[a : a + batch]]
                y = np.concatenate([labels[i] for i in order[a : a + batch]]).astype(np.float32)
                sizes = np.array([len(p) for p in some])
                paths, path_of, which, words, word_of, numbers = features(some, path_hash, word_hash, share_paths=False)
                keep_some = rng.random(len(paths)) > 0.15
                paths, path_of = paths[keep_some], path_of[keep_some]
                n = len(numbers)
                x = self.vectors((paths, path_of, which, words, word_of, numbers))
                seq, mask, row, col = self._sequence(x, sizes)
                keeps: list[list] = [[], []]
                logit, h = self.logits(seq, mask, keeps)
                d = np.zeros_like(logit)
                d[row, col] = (sigmoid(logit[row, col]) - y) / len(y)
                grads = [None, None, np.einsum("tbh,tb->h", h, d)[:, None], np.array([d.sum()], np.float32)]
                d_h = d[:, :, None] * self.out[:, 0]
                hidden = self.ways[0].U.shape[0]
                d_seq = d_h[:, :, 2 * hidden :].copy()
                for way, g in enumerate(self.ways):
                    flip = slice(None, None, -1) if way else slice(None)
                    more, d_x = g.backward(seq[flip], d_h[:, :, way * hidden : (way + 1) * hidden][flip], keeps[way])
                    grads += more
                    d_seq += d_x[flip]
                d_rows = d_seq[row, col]
                ways = int(which.max()) + 1
                d_path = np.stack([np.bincount(which, d_rows[:, k], ways) for k in range(self.path.shape[1])], 1)
                for at, (table, ids, owner, d_of) in enumerate(((self.path, paths, path_of, d_path), (self.word, words, word_of, d_rows[:, self.path.shape[1] :]))):
                    each = d_of[:, : table.shape[1]] / np.maximum(np.bincount(owner, minlength=len(d_of)), 1)[:, None]
                    grads[at] = np.stack([np.bincount(ids, each[owner, k], len(table)) for k in range(table.shape[1])], 1).astype(np.float32)
                speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


# --- training pages ---------------------------------------------------------------------

#: Where articles stand, and what stands around them: tag, attribute words, kind of content.
ARTICLE = [("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("div", "entry content"), ("div", "article text"), ("section", "story"), ("div", "main column"), ("div", "page wrap content"), ("article", "post hentry"), ("div", "article"), ("div", "text"), ("main", "content main"), ("section", "article body"), ("td", "content")]
AROUND_BEFORE = [("nav", "", "links"), ("ul", "menu", "links"), ("div", "navbar", "links"), ("header", "", "short"), ("div", "header top", "short"), ("div", "breadcrumb", "links"), ("div", "ad", "line"), ("div", "advert sponsored", "line"), ("div", "cookie notice", "line"), ("div", "cookie banner consent", "line"), ("form", "search", "short"), ("div", "banner promo", "line"), ("div", "topbar login", "links"), ("div", "alert notice", "line"), ("header", "site masthead", "short"), ("div", "popup modal newsletter", "line")]
AROUND_AFTER = [("footer", "", "line"), ("div", "footer", "line"), ("div", "footer copyright", "short"), ("aside", "", "links"), ("aside", "sidebar", "lines"), ("div", "sidebar widget", "links"), ("div", "related posts", "links"), ("div", "comments", "lines"), ("section", "comments", "lines"), ("ol", "comment list", "lines"), ("div", "comment thread reply", "lines"), ("div", "share social", "links"), ("form", "subscribe newsletter", "short"), ("form", "comment reply", "short"), ("div", "ad", "line"), ("div", "advertisement", "line"), ("div", "tags meta", "links"), ("nav", "pagination", "links"), ("div", "author bio", "line"), ("div", "disclaimer legal", "line"), ("ul", "links bottom", "links"), ("section", "recommended more", "lines")]
INSIDE = [("div", "ad", "line"), ("aside", "", "line"), ("div", "share social", "links"), ("figure", "promo", "short"), ("form", "newsletter signup", "short"), ("div", "related inline", "links"), ("nav", "toc", "links")]


def made_pages(sentences: list[str], count: int, seed: int = 31) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages of random layouts with the label of every block."""
    rng = np.random.default_rng(seed)
    pages, labels = [], []
    text = lambda: sentences[rng.integers(len(sentences))]

    def around(kind: tuple[str, str, str], parent: tuple[str, ...]) -> list[Block]:
        tag, names, content = kind
        path = (*parent, tag, *names.split())
        if content == "links":
            inner = ("ul", "li") if rng.random() < 0.6 else ()
            words = text().split() or ["x"]
            return [Block((*path, *inner, "a"), w, len(w)) for w in words[: rng.integers(1, 9)]]
        if content == "short":
            return [Block((*path, *(() if rng.random() < 0.5 else ("p",))), " ".join(text().split()[: rng.integers(1, 7)]) or "x", 0) for _ in range(rng.integers(1, 3))]
        many = 1 if content == "line" else int(rng.integers(2, 7))
        return [Block((*path, *(("p",) if rng.random() < 0.5 else ("div", "item") if rng.random() < 0.3 else ())), text(), 0) for _ in range(many)]

    for _ in range(count):
        parent: tuple[str, ...] = ("html", "body") if rng.random() < 0.7 else ("html", "body", "div", "wrapper")
        page: list[Block] = []
        label: list[int] = []

        def add(blocks: list[Block], good: int) -> None:
            page.extend(blocks)  # noqa: B023
            label.extend([good] * len(blocks))  # noqa: B023

        for k in rng.choice(len(AROUND_BEFORE), rng.integers(0, 5), replace=False):
            add(around(AROUND_BEFORE[k], parent), 0)
        tag, names = ARTICLE[rng.integers(len(ARTICLE))]
        home = (*parent, tag, *names.split())
        if rng.random() < 0.8:
            add([Block((*home, *(("header",) if rng.random() < 0.1 else ()), "h1" if rng.random() < 0.8 else "h2"), " ".join(text().split()[:10]) or "x", 0)], 1)
        if rng.random() < 0.15:
            add(around(("div", "byline meta", "short"), home), 0)
        for _ in range(int(rng.integers(1, 16))):
            r = rng.random()
            if r < 0.8:
                add([Block((*home, "p", *(("b",) if rng.random() < 0.1 else ())), " ".join(text() for _ in range(rng.integers(1, 5))), 0)], 1)
            elif r < 0.87:
                add([Block((*home, "h2" if rng.random() < 0.5 else "h3"), " ".join(text().split()[:6]) or "x", 0)], 1)
            elif r < 0.93:
                add([Block((*home, "ul" if rng.random() < 0.5 else "ol", "li"), text(), 0) for _ in range(rng.integers(1, 5))], 1)
            elif r < 0.96:
                add([Block((*home, "blockquote", *(("p",) if rng.random() < 0.5 else ())), text(), 0)], 1)
            else:
                add(around(INSIDE[rng.integers(len(INSIDE))], home), 0)
        for k in rng.choice(len(AROUND_AFTER), rng.integers(0, 6), replace=False):
            add(around(AROUND_AFTER[k], parent if rng.random() < 0.85 else home), 0)
        pages.append(page)
        labels.append(np.array(label))
    return pages, labels


def fit_labeller(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample_rows: int = 200, sentences: int = 20_000, sentence_words: int = 40, layouts: int = 700) -> BlockLabeller:
    """Train on layouts filled with text from ``sample_rows`` pages at most, picked by a hash of the id.

    Of their sentences ``sentences`` at most are used, with ``sentence_words`` words at most each: they fill
    training pages only.  Null pages are left out; an empty table gives layouts filled with one word.
    """
    rows = hash_sample(pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(html_col).alias("h")), "__id", pages.count(), sample_rows).orderBy("__id", "h").collect()
    texts = [b.text for r in rows for b in blocks_of(r.h)]
    filling = sorted({s.strip() for t in texts for s in re.split(r"(?<=[.!?])\s", t) if s.strip()})[:sentences] or ["text"]
    model = BlockLabeller()
    model.learn(*made_pages([" ".join(s.split()[:sentence_words]) for s in filling], layouts))
    return model


def extract(pages: DataFrame, model: BlockLabeller, *, html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """All columns of ``pages`` with ``text`` and ``n_chars``.

    The blocks labelled as article, joined by a line feed; empty if there are none or the
    page is null.  Columns of ``pages`` named text or n_chars are replaced.  Repeated rows and rows that share
    an id are extracted each; very long pages are read whole.
    """
    pages = pages.drop("text", "n_chars")
    names = pages.columns
    at = names.index(html_col)

    def run(batches):
        path_hash, word_hash = Hashes(PATH_BUCKETS), Hashes(WORD_BUCKETS)
        for batch in batches:
            texts: list[str] = []
            for a in range(0, batch.num_rows, 256):
                parsed = [blocks_of(p) for p in batch.column(at).slice(a, 256).to_pylist()]
                for page, p in zip(parsed, model.label(parsed, path_hash, word_hash), strict=True):
                    texts.append("\n".join(b.text for b, q in zip(page, p, strict=True) if q >= threshold))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.mapInArrow(run, with_fields(pages.schema, text=T.StringType(), n_chars=T.LongType()))
