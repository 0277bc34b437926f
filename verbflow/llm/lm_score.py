"""Language-model scores by online logistic context mixing.

A text is its words in order, each word its bytes and a space, then one end mark.  Every
bit of a byte is predicted by several predictors, each of which counts zeros and ones in
a hashed context (the last one to four bytes of the word, or all of it so far).  Their
log odds are combined by weights that a gate (bit number and counts behind the longest contexts) selects
and that learn online, bit by bit, and the result is refined by an adaptive map from
(gate, probability) to what came true.  The product over all bits is the probability of a word
under a class (the language of training documents), evaluated once for each distinct word.

A text is then read in order, and what it has shown so far adapts every next prediction:

* Ways to draw its words (one for each class, and fresh draws) are weighted by how well they have
  predicted the text so far.  Each also comes with the first byte of a word predicted from the word before,
  by counts in hashed rows that all training texts filled.
* The last word and the last two words are hashed contexts: was the word that followed them last
  time in this text right or wrong?  The odds that it is right again are a mix, with weights by gate (what
  both contexts have seen), of the text's own record so far, refined by an adaptive map.

The counts come from all training documents: blocks of documents hand on their distinct
words, packed by hash buckets; a bucket sums them up, evaluates its words and answers each
block.  No word list, of the corpus or of a block, comes to the driver or is broadcast.  The
hashed tables double until they have a slot for each distinct training word of a class, and the
weights are learned in every bucket from all training tokens there, those of a word up to
TOKENS_PER_STEP at once, then merged by how often each was used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import InitVar, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_checkpoint_dir, mix64, release, shuffle_width

#: The end mark: white space, so no word is spelt like it.
END = b"\x0b"
#: Rows of counts of first bytes, picked by a hash of the word before; one more for the start of a text.
ROWS = 1 << 13
#: What the contexts of the last word and the last two have seen (3 x 3 x agreement), and bins of a text's record.
REPEAT_GATES, BINS = 18, 24
#: Tokens that are read at once, few enough for the processor's cache; a longer text is read whole.
AT_ONCE = 20_000
#: log2 of the least slots of each predictor's table (they double together): last 1, 2, 3, 4 bytes, the whole word so far, the same for all classes together.
SLOTS = (16, 18, 19, 19, 19, 19)
SIZES = tuple(1 << s for s in SLOTS)
BASE = np.concatenate([[0], np.cumsum(SIZES)])
GATES = 8 * 5 * 3
STEPS = 33
BITS = np.arange(8)
#: Training tokens that make one step of the weights: a word's tokens are learned from so many at once.
TOKENS_PER_STEP = 64


class Numbers(dict):
    """Numbers of words from 0 by first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (those of ``ascii_words``) by first sight, every word's number in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(words), 0)  # next to white space at either end there is an empty one
    before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    ends = np.cumsum(np.r_[0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
    coded = words.filter(full).dictionary_encode()
    kind = pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()
    return coded.dictionary.cast(kind).to_pylist(), coded.indices.to_numpy(), np.diff(before[ends])


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all bytes of the words, each with its closing space: byte, owner, context hashes (6, n)."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), size)
    starts = np.cumsum(size) - size
    place = np.arange(len(flat)) - starts[owner]
    h = np.empty((6, len(flat)), np.uint64)
    past = np.zeros(len(flat), np.uint64)
    for k in range(4):
        shifted = np.zeros(len(flat), np.uint64)
        shifted[k + 1 :] = flat[: -(k + 1)]
        past = past * np.uint64(257) + np.where(place > k, shifted + np.uint64(1), np.uint64(0))
        h[k] = past * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
    longest = int(size.max()) if len(size) else 1
    powers = np.multiply.accumulate(np.full(longest, 0xD1342543DE82EF95, np.uint64))
    terms = (flat + np.uint64(1)) * powers[place]
    total = np.cumsum(terms, dtype=np.uint64) - terms
    h[4] = (total - total[starts][owner]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)
    h[5] = h[4] + np.uint64(78)
    return flat.astype(np.int64), owner, h


def halves(byte: np.ndarray, owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by half bytes: four bits, owner, context hashes that for a low half know the high one."""
    both = np.repeat(h, 2, 1)
    both[:, 1::2] += after_high(byte)
    return np.stack([byte >> 4, byte & 15], 1).ravel(), np.repeat(owner, 2), both


def after_high(byte: np.ndarray) -> np.ndarray:
    return (byte >> 4 | 16).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)


def shared_prefixes(byte: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the (half) bytes of sorted words those whose word so far is new, and for each which of these says the same.

    Contexts are all within the word so far, so equal prefixes need one evaluation.
    """
    size = np.bincount(owner)
    starts = np.cumsum(size) - size
    place = np.arange(len(byte)) - starts[owner]
    same = (owner > 0) & (place < size[owner - 1])
    same &= byte[np.where(same, starts[owner - 1] + place, 0)] == byte
    shared = np.minimum.reduceat(np.where(same, len(byte), place), starts)  # with the word before
    new = place >= shared[owner]
    order = np.argsort(place.astype(np.uint16) if size.max() < 1 << 16 else place, kind="stable")
    last = np.maximum.accumulate(np.where(new[order], np.arange(len(byte)), 0))
    node = np.empty(len(byte), np.int64)
    node[order] = (np.cumsum(new) - 1)[order][last]
    return np.flatnonzero(new), node


def salted(h: np.ndarray, cls) -> np.ndarray:
    """Context hashes of a class (one for all columns, or one each)."""
    return h + (np.atleast_1d(np.asarray(cls, np.uint64)) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019)


def doublings(distinct: float) -> int:
    """How often the least tables double until the largest have a slot for each of ``distinct`` words."""
    return max(0, int(np.ceil(np.log2(max(1, distinct)))) - max(SLOTS))


def doubled(size: int) -> int:
    """How often tables of ``size`` slots in all were doubled."""
    return (size // int(BASE[-1])).bit_length() - 1


def lines(h: np.ndarray, byte: np.ndarray, first: int, extra: int = 0) -> np.ndarray:
    """A counter of predictors from ``first`` on (one row of ``h`` each) for either half of each byte.

    A half's four bits are predicted from counters whose numbers differ from it in their last four bits (``node``), so a
    context is hashed twice a byte and its counters are neighbours.
    """
    return np.stack([line_numbers(h, first, extra), line_numbers(h + after_high(byte), first, extra)])


def line_numbers(h: np.ndarray, first: int, extra: int) -> np.ndarray:
    out = np.empty(h.shape, np.int64)
    for k, mixed in enumerate(h, first):
        mixed = mixed ^ mixed >> np.uint64(29)
        out[k - first] = (mixed * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - SLOTS[k] - extra)).astype(np.int64) + (BASE[k] << extra)
    return out


def node(byte: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """1 to 15: a bit's place in its half and the bits of the half before it."""
    return (byte >> 4 * (bit < 4) & 15 | 16) >> 4 - bit % 4


def slots_of(line: np.ndarray, byte: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """(predictors, bytes, bits): a byte's bits side by side, as their counters are, so that memory is met once for each half."""
    return np.bitwise_xor(line[bit // 4].transpose(1, 2, 0), node(byte[:, None], bit), order="C")


def all_lines(h: np.ndarray, byte: np.ndarray, cls, extra: int = 0) -> np.ndarray:
    return np.concatenate([lines(salted(h[:5], cls), byte, 0, extra), lines(h[5:], byte, 5, extra)], 1)


def count_bits(words: list[bytes], counts: np.ndarray, tables: np.ndarray) -> None:
    """Add (words, classes) counts to tables (2, slots)."""
    extra = doubled(tables.shape[1])
    flat = tables.reshape(-1, order="A")
    to_one, to_next = (x // tables.itemsize for x in tables.strides)
    for a in range(0, len(words), 100_000):
        part, weight = words[a : a + 100_000], counts[a : a + 100_000]
        order = sorted(range(len(part)), key=part.__getitem__)
        part, weight = [part[i] for i in order], weight[order]
        for cls in range(counts.shape[1]):
            mine = np.flatnonzero(weight[:, cls])
            if not len(mine):
                continue
            four, owner, h = halves(*contexts([part[i] for i in mine]))
            new, prefix = shared_prefixes(four, owner)
            w = np.repeat(np.bincount(prefix, weight[mine, cls][owner]).astype(np.float32), 4)
            four, h = four[new, None], h[:, new]
            inner, ones = (four | 16) >> 4 - BITS[:4], (four >> 3 - BITS[:4] & 1) * to_one
            for line in (*line_numbers(salted(h[:5], cls), 0, extra), *line_numbers(h[5:], 5, extra)):
                np.add.at(flat, ((line[:, None] ^ inner) * to_next + ones).ravel(), w)


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds after adding a little to either count."""
    return np.log((ones + 0.02) / (zeros + 0.02)).astype(np.float32)


def trust_of(n: np.ndarray) -> np.ndarray:
    """How much was counted, in five steps."""
    return (n > 0.5).astype(np.int64) + (n > 1.5) + (n > 7.5) + (n > 63.5)


@dataclass
class Mixer:
    """Log odds and trust of all slots, the gated weights, and the adaptive map.

    The last three of the 32 bits of log odds hold the trust, so that memory is met once for both (``trust`` None: they do already).
    """

    odds: np.ndarray
    trust: InitVar[np.ndarray | None]
    classes: int
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, 6), 0.25))
    refine: np.ndarray = field(default_factory=lambda: np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, STEPS))), (GATES, 1)))
    used: np.ndarray = field(default_factory=lambda: np.zeros((GATES, 1)))
    mapped: np.ndarray = field(default_factory=lambda: np.zeros((GATES, STEPS)))

    def __post_init__(self, trust: np.ndarray | None) -> None:
        if trust is not None:
            self.odds = self._with_trust(self.odds, trust)

    @staticmethod
    def _with_trust(odds: np.ndarray, trust: np.ndarray) -> np.ndarray:
        bits = np.where(odds == 0, 1e-6, odds).astype(np.float32).view(np.uint32)  # 0 would become a slow subnormal number
        return (bits & np.uint32(0xFFFFFFF8) | trust.astype(np.uint32)).view(np.float32)

    @classmethod
    def of(cls, tables: np.ndarray, classes: int) -> Mixer:
        odds = np.empty(tables.shape[1], np.float32)
        for a in range(0, len(odds), 1 << 20):
            zeros, ones = tables[:, a : a + (1 << 20)]
            odds[a : a + (1 << 20)] = cls._with_trust(log_odds(zeros, ones), trust_of(zeros + ones))
        return cls(odds, None, classes)

    def learned(self) -> bytes:
        """What ``learn`` has found, for ``merge``."""
        return np.concatenate([x.ravel() for x in (self.weights, self.refine, self.used, self.mapped)]).tobytes()

    def merge(self, parts: list[bytes]) -> None:
        """Weights and map become the means of what several streams found, by how often each used them; unused ones stay."""
        cuts = np.cumsum([GATES * 6, GATES * STEPS, GATES])
        for total, name, of in ((self.used, "weights", 2), (self.mapped, "refine", 3)):
            mine = getattr(self, name)
            mean = np.zeros_like(mine)
            for part in parts:
                x = np.split(np.frombuffer(part), cuts)
                count = x[of].reshape(total.shape)
                mean += x[0 if of == 2 else 1].reshape(mine.shape) * count
                total += count
            setattr(self, name, np.where(total > 0, mean / np.where(total > 0, total, 1), mine))

    @staticmethod
    def _gate(bit: int, whole, four):
        """Weights are chosen by the bit's number and by what was seen of the whole word so far and of four bytes."""
        return (bit * 5 + whole.astype(np.int64)) * 3 + (four > 0) + (four > 2)

    @staticmethod
    def _place(s: np.ndarray):
        """Where the map is read: the step below, and how far beyond it."""
        at = (np.clip(s, -7.999, 7.999) + 8) * ((STEPS - 1) / 16)
        low = at.astype(np.int64)
        return low, at - low

    def _refined(self, s: np.ndarray, gate: np.ndarray):
        """Probability of a one: the mean of the mixer's and the map's (between its steps linearly)."""
        low, part = self._place(s)
        mapped = self.refine[gate, low] * (1 - part) + self.refine[gate, low + 1] * part
        return np.clip(0.5 * mapped + 0.5 / (1 + np.exp(-np.clip(s, -7.999, 7.999))), 1e-6, 1 - 1e-6)

    def learn(self, words: list[bytes], classes: np.ndarray, share: np.ndarray, tables: np.ndarray, rate: float = 0.02) -> None:
        """Online over a stream of words: every step corrects the weights and the map of the gates it used.

        A word counts as much as its ``share`` (0 to 1) says; words whose shares make 64 are one step.
        Each word is predicted from the counts without its own one, as an unseen text's would be.
        """
        extra = doubled(tables.shape[1])
        pairs = np.ascontiguousarray(tables.T, np.float32).view(np.complex64).ravel()  # zeros and ones side by side
        reach = np.cumsum(share, dtype=np.float64)
        steps = max(1, int(reach[-1]) // 64) if len(reach) else 0
        mapped, refine = self.mapped.reshape(-1), self.refine.reshape(-1)  # changed in place
        cuts = [0, *np.searchsorted(reach, 64.0 * np.arange(1, steps), "right").tolist(), len(words)]
        for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a == b:
                continue
            now = rate * (1 - 0.9 * t / steps)
            byte, owner, h = contexts(words[a:b])
            w = share[a:b][owner].astype(np.float64)
            line = all_lines(h, byte, classes[a:b][owner], extra)
            # gates of different bits are different, so a step takes all bits together (one by one where words are very long)
            for bit in BITS.reshape(1 if len(byte) < 1 << 16 else 8, -1):
                at = slots_of(line, byte, bit)
                y = byte[:, None] >> 7 - bit & 1
                one = y.astype(np.float32)
                seen = pairs.take(at)
                zeros, ones = np.maximum(seen.real - (1 - one), 0), np.maximum(seen.imag - one, 0)
                x = log_odds(zeros, ones).reshape(6, -1)
                gate = self._gate(bit, trust_of(zeros[4] + ones[4]), trust_of(zeros[3] + ones[3])).ravel()
                y, much = one.ravel(), np.repeat(w, len(bit))
                s = np.zeros(len(gate))
                for k in range(6):
                    s += self.weights[:, k].take(gate) * x[k]
                error = (y - 1 / (1 + np.exp(-np.clip(s, -30, 30)))) * much
                step = np.stack([np.bincount(gate, row * error, GATES) for row in np.clip(x, -8, 8)], 1)
                used = np.bincount(gate, much, GATES)[:, None]
                self.used += used
                self.weights += now * step / np.maximum(1, used) ** 0.5
                low, part = self._place(s)
                low += gate * STEPS
                part *= much
                for at, much in ((low, much - part), (low + 1, part)):
                    hits = np.bincount(at, much, len(mapped))
                    mapped += hits
                    # as steps of 0.01 one after the other: many bytes of one cell can't overshoot
                    refine += (1 - 0.99**hits) * (np.bincount(at, much * y, len(refine)) / np.maximum(hits, 1e-300) - refine)
        np.clip(self.refine, 1e-5, 1 - 1e-5, out=self.refine)

    def log10_words(self, words: list[bytes], wanted: list[int], first: bool = False) -> np.ndarray:
        """log10 of the probability of each word (``first``: of its first byte alone) under the wanted classes; -99 under the others."""
        out = np.full((len(words), self.classes), -99, np.float32)
        weights = np.ascontiguousarray(self.weights.T, np.float32)
        table = self._log_table().ravel()
        extra = doubled(len(self.odds))
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        for a in range(0, len(words), 1_000):
            mine = order[a : a + 1_000]
            byte, owner, h = contexts([words[i] for i in mine])
            counted = np.repeat(np.r_[True, owner[1:] != owner[:-1]], 2) if first else None
            four, owner, h = halves(byte, owner, h)
            new, prefix = shared_prefixes(four, owner)
            four, h, bit = four[new, None], h[:, new], new[:, None] % 2 * 4 + BITS[:4]
            inner, y = (four | 16) >> 4 - BITS[:4], four >> 3 - BITS[:4] & 1
            shared = self.odds.take(line_numbers(h[5:], 5, extra)[0][:, None] ^ inner)
            for cls in wanted:
                at = line_numbers(salted(h[:5], cls), 0, extra)[:, :, None] ^ inner
                odds = [self.odds.take(x) for x in at]
                gate = self._gate(bit, odds[4].view(np.uint32) & 7, odds[3].view(np.uint32) & 7)
                s = weights[5].take(gate) * shared
                for k in range(5):
                    s += weights[k].take(gate) * odds[k]
                np.clip(s, -7.999, 7.999, out=s)
                s += 8
                s *= 64
                total = table.take((gate * 1024 + s.astype(np.int64)) * 2 + y).sum(1)[prefix]
                out[mine, cls] = np.bincount(owner, total if counted is None else total * counted, len(mine))
        return out

    def _log_table(self) -> np.ndarray:
        """log10 probability of a zero or one by gate and log odds in steps of 1/64 (both sides add up to 1)."""
        s = (np.arange(1024) + 0.5) / 64 - 8
        gate = np.repeat(np.arange(GATES), len(s))
        p = self._refined(np.tile(s, GATES), gate).reshape(GATES, -1)
        return np.log10(np.stack([1 - p, p], 2)).astype(np.float32)


# --- what a text has shown so far ---------------------------------------------------------


def last_time(context: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same context, or -1; contexts are compared by 32 bits of a hash."""
    n = np.uint64(len(context))
    there = np.sort(mix64(context) >> np.uint64(32) << np.uint64(32) | np.arange(n, dtype=np.uint64))
    place = (there & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out = np.full(len(context), -1)
    same = np.flatnonzero(there[1:] >> np.uint64(32) == there[:-1] >> np.uint64(32)) + 1
    out[place[same]] = place[same - 1]
    return out


def repeats(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each token of texts in a row 0 if neither context has been met in its text, else 1 + 2 * cell + right.

    The cell is the gate and the bin of the text's record; ``right`` says that the word that
    followed the longer known context last time follows again.
    """
    w, d = word.astype(np.uint64) + np.uint64(2), doc.astype(np.uint64) << np.uint64(40)
    start = np.r_[True, doc[1:] != doc[:-1]]
    one = np.where(start, np.uint64(1), np.r_[np.uint64(0), w[:-1]])
    two = np.where(start, np.uint64(0), np.r_[np.uint64(0), one[:-1]])
    state, guess = [], []
    for context in (mix64(one + d), mix64(one + d) + two * np.uint64(0x9E3779B97F4A7C15)):
        j = last_time(context)
        guess.append(np.where(j >= 0, word[j], -1))
        right = guess[-1] == word
        state.append((j >= 0) * (1 + (right[j] & (j >= 0))))
    known = state[0] > 0  # two known words mean that one is
    best = np.where(state[1] > 0, guess[1], guess[0])
    gate = (state[1] * 3 + state[0]) * 2 + (guess[0] == guess[1])
    right = known & (best == word)
    base = np.flatnonzero(start)[np.cumsum(start) - 1]
    before = lambda x: np.cumsum(x) - x - (np.cumsum(x) - x)[base]
    n, hits = before(known.astype(np.int64)), before(right.astype(np.int64))
    s = np.clip(stretch((hits + 0.4) / (n + 2.0)), -3.99, 3.99)
    cell = gate * BINS + (s + 4).astype(np.int64) * 3 + (n > 3) + (n > 30)
    return np.where(known, 1 + 2 * cell + right, 0).astype(np.uint16)


def stretch(p):
    return np.log(p / (1 - p))


def repeat_odds(counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Probability that the word follows again, by cell, from counts (cells, wrong and right) of all training texts.

    Logistic weights of each gate for the text's record, then the map: what came true in the cell.
    """
    n = counts.reshape(REPEAT_GATES, BINS, 2).astype(np.float64)
    x = np.tile(np.repeat(np.arange(8) - 3.5, 3), (REPEAT_GATES, 1))
    share = n / np.maximum(1, n.sum((1, 2), keepdims=True))
    weight, bias = np.ones((REPEAT_GATES, 1)), np.zeros((REPEAT_GATES, 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(weight * x + bias)))
        error = share[:, :, 1] - share.sum(2) * p
        weight += 0.2 * (error * x).sum(1, keepdims=True)
        bias += 0.5 * error.sum(1, keepdims=True)
    p = 1 / (1 + np.exp(-np.clip(weight * x + bias, -8, 8)))
    return np.clip((n[:, :, 1] + 4 * p) / (n.sum(2) + 4), 1e-4, 1 - 1e-4).ravel()


def after_word(counts: np.ndarray) -> np.ndarray:
    """Natural log of the probability of a word's first byte by row, smoothed as much as suits counts less one."""
    n = counts.reshape(ROWS + 1, 256).astype(np.float64)
    every = n.sum(0) + 1 / 256
    every /= every.sum()
    at = np.nonzero(n)
    of = lambda smooth: (n[at] * np.log((n[at] - 1 + smooth * every[at[1]]) / (n.sum(1)[at[0]] - 1 + smooth))).sum()
    smooth = max((4.0**k for k in range(1, 9)), key=of)
    return np.log((n + smooth * every) / (n.sum(1, keepdims=True) + smooth))


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return np.log(np.exp(x - top[:, None]).sum(1)) + top


def read_in_order(word: np.ndarray, starts: np.ndarray, ways: np.ndarray, entry: np.ndarray, first_of_way: np.ndarray, first: np.ndarray, row: np.ndarray, follows: np.ndarray, code: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Natural log of the probability of every text (whose words begin at ``starts``), its words in order.

    ``ways``: log probability of each word by way; ``entry``: of each way; ``first_of_way``: of each first byte by
    way; ``first`` and ``row``: each word's first byte and row; ``follows``: log probability of a first byte
    by row; ``code`` and ``odds``: what ``repeats`` and ``repeat_odds`` say.
    """
    n, many = len(word), len(entry)
    begins = np.zeros(n, bool)
    begins[starts] = True
    before = np.where(begins, ROWS, np.r_[ROWS, row[word[:-1]]])
    x = first[word]
    total = np.empty((2 * many, n))  # as drawn, and primed by the word before
    total[:many] = ways.take(word, 0).T
    np.subtract(total[:many], first_of_way.take(x, 0).T, out=total[many:])
    total[many:] += follows[before, x]
    np.cumsum(total, 1, out=total)
    base = np.concatenate([np.zeros((2 * many, 1)), total[:, starts[1:] - 1]], 1) - (np.r_[entry, entry] - np.log(2))[:, None]
    total -= np.repeat(base, np.diff(np.r_[starts, n]), 1)
    top = total.max(0)
    total -= top
    seen = np.log(np.exp(total, out=total).sum(0)) + top
    each = seen - np.where(begins, 0, np.r_[0, seen[:-1]])
    some = np.flatnonzero(code)
    p, right = odds[(code[some].astype(np.int64) - 1) // 2], (code[some] - 1) % 2 == 1
    each[some] = np.where(right, np.log(p + (1 - p) * np.exp(each[some])), np.log1p(-p) + each[some])
    return np.add.reduceat(each, starts)


def pack(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def unpack(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def pack_ints(x: np.ndarray) -> bytes:
    return pack(x.tobytes())


def unpack_ints(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(unpack(b), kind)


def in_parts(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs of texts of about AT_ONCE tokens."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > AT_ONCE:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if sizes else []


def gather(docs: DataFrame, id_col: str, text_col: str, class_col: str, learn_col: str, classes: int, block_chars: int = 32 << 20) -> DataFrame:
    """Rows for buckets (distinct words of a block, counts by class in training texts), rows for
    blocks (documents as word numbers in order, and their repeats), and what training texts tell of words' followers."""
    width = 4 * shuffle_width(docs.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId()
        number = Numbers()
        rows: list[tuple] = []
        size, serial = 0, 0

        def flush():
            block = (part << 24) + serial
            words = list(number)
            bucket = np.fromiter((zlib.crc32(w) % width for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            new = np.empty(len(words), np.int64)
            new[order] = np.arange(len(words))
            total = np.zeros((len(words), classes), np.int64)
            for cls in {c for _, _, c, _ in rows if c is not None}:
                total[:, cls] = np.bincount(np.concatenate([ids for _, _, c, ids in rows if c == cls]), minlength=len(words))
            total = total[order]
            starts = np.searchsorted(bucket[order], np.arange(width + 1))
            out = []
            for b in range(width):
                lo, hi = int(starts[b]), int(starts[b + 1])
                if hi > lo:
                    out.append((0, b, block, lo, None, None, pack(b" ".join([words[i] for i in order[lo:hi]])), pack_ints(total[lo:hi].T.astype(np.uint32).copy())))
            first = np.fromiter((w[0] for w in words), np.int64, len(words))
            row = np.fromiter((zlib.crc32(w) // width % ROWS for w in words), np.int64, len(words))
            follow, again = np.zeros((ROWS + 1) * 256, np.int64), np.zeros(REPEAT_GATES * BINS * 2, np.int64)
            for a, b in in_parts([len(r[3]) for r in rows]):
                word, size = np.concatenate([r[3] for r in rows[a:b]]), [len(r[3]) for r in rows[a:b]]
                learns = np.repeat([r[2] is not None for r in rows[a:b]], size)
                code = repeats(word, np.repeat(np.arange(b - a), size))
                starts = np.cumsum([0, *size[:-1]])
                before = np.r_[ROWS, row[word[:-1]]]
                before[starts] = ROWS
                np.add.at(follow, (before * 256 + first[word])[learns], 1)
                seen = code[learns & (code > 0)].astype(np.int64) - 1
                again += np.bincount(seen, minlength=len(again))
                for (doc, held, _, ids), codes in zip(rows[a:b], np.split(code, starts[1:]), strict=True):
                    out.append((1, block, block, 0, doc, held, pack_ints(new[ids].astype(np.uint32)), pack_ints(codes)))
            at = np.flatnonzero(follow)
            out.append((2, block, block, 0, None, None, pack_ints(np.stack([at, follow[at]])), pack_ints(again)))
            for a in range(0, len(out), 2000):
                columns = list(zip(*out[a : a + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind, pa.bool_(), pa.binary(), pa.binary()), strict=True)], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(chars // (block_chars // 8))) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                few = batch.slice(a, b - a)
                words, word, many = numbered_words(few.column(1))
                word = np.fromiter(map(number.__getitem__, words), np.int32, len(words))[word]
                end = np.array([number[END]], np.int32)
                for doc, cls, learns, ids in zip(*(few.column(i).to_pylist() for i in (0, 2, 3)), np.split(word, np.cumsum(many)[:-1]), strict=True):
                    rows.append((doc, not learns, cls if learns else None, np.concatenate([ids, end])))
                size += int(chars[b - 1] - (chars[a - 1] if a else 0))
                if size >= block_chars:
                    yield from flush()
                    number, rows, size, serial = Numbers(), [], 0, serial + 1
        if rows:
            yield from flush()

    names = ["kind", "key", "block", "first", "doc", "held", "x", "y"]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("key", "block", "first")), T.StructField("doc", docs.schema[id_col].dataType), T.StructField("held", T.BooleanType()), T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType())])
    return docs.select(id_col, text_col, class_col, learn_col).mapInArrow(run, schema)


def bucket_counts(rows: list[tuple[bytes, bytes]], classes: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Distinct words of a bucket, their counts by class, and the word numbers of each packet."""
    lists = pc.split_pattern(pa.array([unpack(x) for x, _ in rows], pa.large_binary()), b" ")
    coded = pc.list_flatten(lists).dictionary_encode()
    at = np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
    total = np.zeros((len(coded.dictionary), classes), np.int64)
    for ids, (_, y) in zip(at, rows, strict=True):
        total[ids] += unpack_ints(y, "<u4").reshape(classes, -1).T.astype(np.int64)  # words of a packet are distinct
    return coded.dictionary, total, at


def together(buckets: Iterable[list[tuple]], most: int = 4 << 20) -> Iterator[list[tuple]]:
    """Packets of several small buckets (words come last but one), as more words share more of their prefixes."""
    held, size = [], 0
    for packs in buckets:
        held, size = held + packs, size + sum(len(p[-2]) for p in packs)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def learning_pieces(counts: np.ndarray, most: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All counts, in pieces of at most ``most`` and in random order: whose each is, and its tokens."""
    whose = np.repeat(np.arange(len(counts)), -(-counts // most))
    tokens = np.full(len(whose), most, np.int64)
    some = np.flatnonzero(counts)
    tokens[np.cumsum(-(-counts // most))[some] - 1] = (counts[some] - 1) % most + 1
    order = np.random.default_rng(seed).permutation(len(whose))
    return whose[order], tokens[order]


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", learn_col: str, class_col: str | None = "lang", max_classes: int | None = None, stream_words: int = 40_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row.

    ``learn_col`` is a boolean column: rows to learn from.  ``base_score`` is the unigram
    score with add-one smoothing, ``score`` the log10 probability by context mixing.
    ``class_col`` names classes of training documents (all of them, or the ``max_classes`` most
    frequent; the rest and nulls are one more); a scored text's class is never read.  All counts cover all
    training rows; the mixing weights and the map of bytes learn online in every bucket from all
    training tokens, those of a word up to TOKENS_PER_STEP at once (fewer, and tokens several times, where
    that made less than ``stream_words`` steps in all).  Null and empty texts are one end mark; without
    training rows all counts are zero.  Repeated rows and rows that share an id are scored each; very long texts are
    read whole.  Other columns take no part.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    known = []
    if class_col:
        named = docs.where(F.col(learn_col) & F.col(class_col).isNotNull()).groupBy(F.col(class_col).cast("string").alias("c")).count().orderBy(F.desc("count"), "c")
        known = [r[0] for r in (named if max_classes is None else named.limit(max_classes)).collect()]
    classes = len(known) + 1
    cls = F.lit(len(known))
    if known:
        number = F.create_map(*(F.lit(x) for pair in zip(known, range(classes - 1), strict=True) for x in pair))
        cls = F.coalesce(F.try_element_at(number, F.col(class_col).cast("string")), cls)
    width = shuffle_width(spark)
    rows = gather(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), cls.cast("int").alias("__c"), F.col(learn_col).alias("__l")), "__id", "__t", "__c", "__l", classes)
    rows = rows.repartition(width, "kind", "key").checkpoint()
    release(spark)
    buckets = rows.where("kind = 0").select("key", "block", "first", "x", "y")

    def packets(batches):
        """Packets of one partition by bucket (a bucket is whole within a partition)."""
        held: dict[int, list] = {}
        for batch in batches:
            for key, block, first, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(key, []).append((block, first, x, y))
        return held

    def counted(batches):
        """Distinct training words of the buckets, once for each class that has them."""
        n = sum(int((bucket_counts([p[2:] for p in packs], classes)[1] > 0).sum()) for packs in packets(batches).values())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    extra = doublings(buckets.mapInArrow(counted, "n long").agg(F.sum("n")).first()[0] or 0)
    slots_all = int(BASE[-1]) << extra

    def summed(batches):
        tables = np.zeros((slots_all, 2), np.float32).T
        tokens, distinct = np.zeros(classes, np.int64), 0
        held_words: list[bytes] = []
        held_counts: list[np.ndarray] = []
        for packs in packets(batches).values():
            words, total, _ = bucket_counts([p[2:] for p in packs], classes)
            held_words += words.to_pylist()
            held_counts.append(total)
            if len(held_words) >= 100_000:
                count_bits(held_words, np.concatenate(held_counts), tables)
                held_words, held_counts = [], []
            tokens += total.sum(0)
            distinct += int((total.sum(1) > 0).sum())
        if held_words:
            count_bits(held_words, np.concatenate(held_counts), tables)
        if not tokens.any():
            return
        step = 1 << 15
        for a in range(0, slots_all, 100 * step):
            at = [b for b in range(a, min(a + 100 * step, slots_all), step) if tables[:, b : b + step].any()]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([pack_ints(tables[:, b : b + step].copy()) for b in at], pa.binary())], ["at", "data"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([pack_ints(np.array([distinct, *tokens]))], pa.binary())], ["at", "data"])

    # each task hands on tables of its own, so tasks are joined until they have work to match
    volume = buckets.agg(F.sum(F.length("x"))).first()[0] or 0
    joined = buckets.coalesce(max(1, min(width, int(volume // (8 << 20)) + 1)))

    def add(key, t):
        total = None
        for b in t.column("data").to_pylist():
            x = unpack_ints(b, "<i8" if key[0].as_py() < 0 else "<f4")
            total = x.copy() if total is None else total + x
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    tables = np.zeros((slots_all, 2), np.float32).T  # as ``learn`` reads them
    vocabulary, by_class = 0, np.zeros(classes)
    for r in joined.mapInArrow(summed, "at long, data binary").groupBy("at").applyInArrow(add, "at long, data binary").toLocalIterator():
        if r.at < 0:
            vocabulary, *by_class = np.frombuffer(r.data, "<i8").tolist()
            by_class = np.array(by_class, np.float64)
        else:
            x = np.frombuffer(r.data, "<f4").reshape(2, -1)
            tables[:, r.at : r.at + x.shape[1]] = x
    release(spark)
    n_train = int(by_class.sum())
    counts_sent = spark.sparkContext.broadcast(tables)

    def fit(batches):
        """Weights and map of one stream, drawn from all training words of the task's buckets."""
        words: list[bytes] = []
        counts: list[np.ndarray] = []
        held = packets(batches)
        for key in sorted(held):
            own, total, _ = bucket_counts([p[2:] for p in sorted(held[key], key=lambda p: p[:2])], classes)
            words += own.to_pylist()
            counts.append(total)
        tokens = np.concatenate(counts).ravel() if counts else np.empty(0, np.int64)
        if not tokens.any():
            return
        most = max(1, min(TOKENS_PER_STEP, n_train // stream_words))
        passes = max(1, -(-stream_words // n_train))
        whose, n = learning_pieces(np.tile(tokens, passes), most, [3, min(held)])
        whose %= len(tokens)
        own = Mixer(np.empty(0), np.empty(0), classes)
        own.learn([words[i] for i in (whose // classes).tolist()], whose % classes, n / most, counts_sent.value)
        yield pa.RecordBatch.from_arrays([pa.array([min(held)], pa.int64()), pa.array([own.learned()], pa.binary())], ["key", "data"])

    def told(batches):
        """Sums of what blocks tell of followers."""
        follow, again = np.zeros((ROWS + 1) * 256, np.int64), np.zeros(REPEAT_GATES * BINS * 2, np.int64)
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, n = unpack_ints(x, "<i8").reshape(2, -1)
                follow[at] += n
                again += unpack_ints(y, "<i8")
        at = np.flatnonzero(follow)
        yield pa.RecordBatch.from_arrays([pa.array([pack_ints(np.stack([at, follow[at]]))], pa.binary()), pa.array([pack_ints(again)], pa.binary())], ["x", "y"])

    follow, again = np.zeros((ROWS + 1) * 256, np.int64), np.zeros(REPEAT_GATES * BINS * 2, np.int64)
    for r in rows.where("kind = 2").select("x", "y").mapInArrow(told, "x binary, y binary").toLocalIterator():
        at, n = unpack_ints(r.x, "<i8").reshape(2, -1)
        follow[at] += n
        again += unpack_ints(r.y, "<i8")

    mixer = Mixer.of(tables, classes)
    mixer.merge([r.data for r in sorted(joined.mapInArrow(fit, "key long, data binary").collect(), key=lambda r: r.key)] if n_train else [])
    counts_sent.destroy()
    del tables
    # a class without training words says nothing; with none at all one stands for all
    wanted = np.flatnonzero(by_class).tolist() or [0]
    prior = np.log10(np.maximum(by_class, 1e-30) / max(1, by_class.sum()))
    sent = spark.sparkContext.broadcast((mixer.odds, None, classes, mixer.weights, mixer.refine))
    first_of_class = mixer.log10_words([bytes([b]) for b in range(256)], wanted, first=True).astype(np.float64)
    sent_texts = spark.sparkContext.broadcast((after_word(follow), repeat_odds(again), first_of_class))
    release(spark)

    def answer(batches):
        mixer = Mixer(*sent.value)
        for packs in together(packets(batches).values()):
            words, total, at = bucket_counts([p[2:] for p in packs], classes)
            words = words.to_pylist()
            log_p = mixer.log10_words(words, wanted)
            c = total.sum(1)
            size = np.fromiter(map(len, words), np.int64, len(words)) << 32 | np.fromiter((zlib.crc32(w) // (4 * width) % ROWS << 8 | w[0] for w in words), np.int64, len(words))
            for (block, first, _, _), ids in zip(packs, at, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([pack_ints(c[ids])], pa.binary()), pa.array([pack_ints(size[ids])], pa.binary()), pa.array([pack_ints(log_p[ids])], pa.binary())], ["block", "first", "c", "size", "p"])

    answers = buckets.mapInArrow(answer, "block long, first long, c binary, size binary, p binary")
    kind = docs.schema[id_col].dataType

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("first").to_numpy())
        packed = {c: right.column(c).to_pylist() for c in ("c", "size", "p")}
        part = lambda c, k: np.concatenate([unpack_ints(packed[c][i], k) for i in order])
        c, size, p = part("c", "<i8"), part("size", "<i8"), part("p", "<f4").reshape(-1, classes).astype(np.float64)
        # small kinds, as they are read in the order of the texts
        size, row, first = (size >> 32).astype(np.int32) + np.int32(1), (size >> 8 & ROWS - 1).astype(np.uint16), (size & 255).astype(np.uint8)
        known, unigram = c > 0, np.log10((c + 1) / (n_train + vocabulary + 1))
        follows, odds, first_of_class = sent_texts.value

        def with_fresh(x: np.ndarray) -> np.ndarray:
            """Natural logs by class, and of a fresh draw of the class."""
            x = x[:, wanted] * np.log(10)
            return np.column_stack([x, log_sum(x + prior[wanted] * np.log(10))])

        ways, first_of_way = with_fresh(p), with_fresh(first_of_class)
        entry = np.r_[prior[wanted] * np.log(10), 0] - np.log(2)  # half for one class throughout, half for fresh draws
        texts, codes = left.column("x").to_pylist(), left.column("y").to_pylist()
        out = [[] for _ in range(6)]
        at = 0
        while at < len(texts):
            held, sizes, some = [], [], []
            while at < len(texts) and (not held or sum(sizes) < AT_ONCE):
                held.append(unpack_ints(texts[at], "<u4").astype(np.int64))
                some.append(unpack_ints(codes[at], "<u2"))
                sizes.append(len(held[-1]))
                at += 1
            word, starts = np.concatenate(held), np.cumsum([0, *sizes[:-1]])
            total = read_in_order(word, starts, ways, entry, first_of_way, first, row, follows, np.concatenate(some), odds) / np.log(10)
            added = lambda v: np.add.reduceat(v[word], starts, dtype=np.float64 if v.dtype.kind == "f" else np.int64)  # noqa: B023, E731
            for column, value in zip(out, (np.array(sizes), added(known), np.full(len(sizes), n_train), added(unigram), total, -total / np.log10(2) / added(size)), strict=True):
                column += value.tolist()
        return pa.Table.from_arrays([left.column("doc").combine_chunks(), left.column("held").combine_chunks(), *(pa.array(v, pa.int64()) for v in out[:3]), *(pa.array(v, pa.float64()) for v in out[3:])], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(x, T.DoubleType()) for x in ("base_score", "score", "bits_per_byte"))])
    texts = rows.where("kind = 1").select("block", "doc", "held", "x", "y")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
