"""N-gram Jaccard join by parity sketches.

A set of word shingles is split by hash into parts, and each part is summed up by the XOR
of its shingles' hashes.  Two sets that differ in d shingles differ in at most d parts, and
sets of Jaccard similarity t or more differ in at most (1-t)/(1+t) * (a+b) shingles, so
with more parts than that at least one part has equal sums (pigeonhole).  Parts are
joined on their sums within size bands.  The same count says in how many parts a set must
meet others if it has any link, and sets that meet fewer drop out; the Hamming distance of
parity sketches (a bit per slot, flipped by every shingle that hashes there), a lower
bound of the symmetric difference, drops false pairs, and the rest is verified on the
sets themselves.

Exactness does not rest on the choice of shingles that are left out of the parts because
they occur in very many documents: leaving the same ones out on both sides only shrinks the
difference.  A set with so many empty parts that a link could hide in them also enters
with parts of all its shingles, and if that is not enough with its empty parts.

Only pairs that can connect what isn't connected yet are verified, so a group of copies
costs links in proportion to its size: each set is first held against the one set that
meets others most often, as the original of many copies does, then against its largest
group, and at last against all its groups.  Sets are verified where they meet, and a task
hands on a spanning forest of the links it finds rather than all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, ascii_words, bucket_keys, ensure_checkpoint_dir, gram_hashes, mix64, release, row_runs, shuffle_width
from .graph import components

#: At most so many shingles are set apart as very frequent; any choice gives the same links.
FREQUENT = 65_536
#: Sets of a group that meet in a task: so many, and with so many bytes of shingles, on either side.
BLOCK = 4096
BLOCK_BYTES = 32 << 20
#: A block's pairs that may link travel as pairs if there are at most so many for each of its sets.
PAIRS = 2


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(n, len(words))))


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set, as signed integers."""
    one = np.bitwise_xor.reduce(mix64(s + np.uint64(0x632BE59BD9B4E019)))
    two = np.sum(mix64(s ^ np.uint64(0x9FB21C651E98DF25)), dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def sketch(s: np.ndarray, least: int = 1024) -> bytes:
    """Parity of the number of shingles in each of ``least`` slots, or as many more (doubling) as shingles ask for."""
    bits = least
    while bits < 2 * len(s) and bits < 1 << 16:
        bits *= 2
    slot = (s >> np.uint64(24)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(slot, minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all as short as the shortest: halves are XORed, which keeps the bound."""
    words = min(map(len, sketches)) // 8
    rows = np.empty((len(sketches), words), np.uint64)
    for i, b in enumerate(sketches):
        x = np.frombuffer(b, np.uint64)
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows[i] = x
    return rows


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


class Bands:
    """Size bands that grow by 1/t, the parts of each, and the difference that a link allows."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def up_to(self, n: int) -> None:
        while self.low[-1] <= n * self.den // self.num + 1:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * self.den // self.num)))

    def difference(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, parts, largest difference of a link of this set there) for each band that a set of n shingles joins."""
        self.up_to(n)
        out = []
        k = int(np.searchsorted(self.low, n, "right")) - 1
        while self.low[k] * self.num <= n * self.den:
            high = self.low[k + 1] - 1
            most = self.difference(high, high)
            parts = most + 1 + (max(-(-most // 5), min(most, 4) + 1) if most else 0)
            out.append((k, parts, self.difference(n, min(high, n * self.den // self.num))))
            k += 1
        return out


def part_sums(s: np.ndarray, mixed: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that hold shingles and the XOR of each one's ``mixed``."""
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    part = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # s is sorted, so part is
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return part[starts], np.bitwise_xor.reduceat(mixed, starts)


def signatures(s: np.ndarray, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of a set, and how many of them a link makes it share at least.

    Of a band's parts at most ``difference`` differ, so parts - difference - empty ones that
    hold shingles are equal.
    """
    mixed = mix64(s * np.uint64(0xA24BAED4963EE407))
    rare, rare_mixed = s, mixed
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        keep = frequent[at] != s
        rare, rare_mixed = s[keep], mixed[keep]
    keys, shared = [], []

    def key(kind: int, band: int, part: np.ndarray, total: np.ndarray) -> None:
        keys.append(mix64(total ^ mix64(part.astype(np.uint64) + np.uint64((kind << 56) + (band << 32) + 1))))

    for band, parts, difference in bands.of(len(s)):
        part, total = part_sums(rare, rare_mixed, parts)
        key(0, band, part, total)
        shared.append(max(1, len(part) - difference))
        if len(part) <= difference:  # a link could hide in empty parts
            part, total = part_sums(s, mixed, parts)
            key(1, band, part, total)
            if len(part) <= difference:
                empty = np.setdiff1d(np.arange(parts), part)
                key(2, band, empty, np.zeros(len(empty), np.uint64))
    return np.concatenate(keys), min(shared)


def profile(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, n, f1, f2, sketch) of each row, and rows (h, c): shingles that many texts of a block share."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, rows, block, held, members = batch.column(0), [], [], 0, 0
            h, c = [], []

            def common(block, members):
                value, count = np.unique(np.concatenate(block), return_counts=True)
                often = count >= max(8, members // 64)
                h.extend(value[often].astype(np.int64).tolist())
                c.extend(count[often].tolist())

            for text in (t for part in row_runs(batch, 1) for t in part.column(1).to_pylist()):
                s = shingles(hashes.of(ascii_words(text)), n)
                rows.append((len(s), *fingerprints(s), sketch(s)) if len(s) else (0, None, None, None))
                block.append(s)
                held += len(s)
                members += 1
                if held > 1_000_000:
                    common(block, members)
                    block, held, members = [], 0, 0
            if held:
                common(block, members)
            size, f1, f2, bits = zip(*rows, strict=True) if rows else ((), (), (), ())
            none = lambda k, t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, none(len(h), ids.type)]),
                    pa.array([*size, *[None] * len(h)], pa.int32()),
                    pa.array([*f1, *[None] * len(h)], pa.int64()),
                    pa.array([*f2, *[None] * len(h)], pa.int64()),
                    pa.array([*bits, *[None] * len(h)], pa.binary()),
                    pa.array([*[None] * len(rows), *h], pa.int64()),
                    pa.array([*[None] * len(rows), *c], pa.int64()),
                ],
                ["__id", "n", "f1", "f2", "bits", "h", "c"],
            )

    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("f1", "f2")), T.StructField("bits", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("h", "c"))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def frequent_shingles(counted: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """At most ``most`` of the shingles with the highest counts, sorted; counts are cut at a power of two."""
    total = counted.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).withColumn("p", F.floor(F.log2("c")).cast("int")).where("c >= 16")
    levels = {r.p: r["count"] for r in total.groupBy("p").count().collect()}
    least, held = None, 0
    for p in sorted(levels, reverse=True):
        if held + levels[p] > most:
            break
        least, held = p, held + levels[p]
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(np.array([r.h for r in total.where(F.col("p") >= least).select("h").collect()], np.int64).astype(np.uint64))


def collisions(docs: DataFrame, text_col: str, n: int, bands: Bands, frequent: np.ndarray) -> DataFrame:
    """Rows (g, members): the sets (as packed f1) that share a signature, each distinct group of a task once;
    and rows (g null) of the sets that met others there, packed by bucket with how often and how often they must.

    Signatures travel packed by bucket, one bucket to a partition: 5 bytes each, and for
    every set of a packet its name and number.
    """
    width = shuffle_width(docs.sparkSession)
    home = np.array(bucket_keys(docs.sparkSession, width))

    def sign(batches):
        hashes, seen = WordHashes(), set()
        held: list[np.ndarray] = []
        names: list[int] = []
        must: list[int] = []
        size = 0

        def flush():
            keys = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(k) for k in held])
            bucket = ((keys >> np.uint64(40)) % np.uint64(width)).astype(np.uint16 if width <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, owner, bucket = keys[order], owner[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows: list[list] = [[], [], [], [], []]
            name, least = np.array(names, np.int64), np.array(must, np.uint16)
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                own, local = np.unique(owner[a:b], return_inverse=True)
                rows[0].append(int(home[bucket[a]]))
                rows[1].append(keys[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                rows[2].append(np.diff(local, prepend=0).astype(np.uint8).tobytes())  # 0 or 1 each
                rows[3].append(name[own].tobytes())
                rows[4].append(least[own].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["bucket", "k", "d", "s", "q"])

        for batch in (part for whole in batches for part in row_runs(whole, 0)):
            for text in batch.column(0).to_pylist():
                s = shingles(hashes.of(ascii_words(text)), n)
                if not len(s):
                    continue
                name = fingerprints(s)
                if name in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(name)
                keys, least = signatures(s, bands, frequent)
                held.append(keys)
                names.append(name[0])
                must.append(min(least, 65_535))
                size += len(keys)
                if size >= 3_000_000:
                    yield flush()
                    held, names, must, size = [], [], [], 0
        if held:
            yield flush()

    def meet(batches):
        keys, owners, names, musts, base = [], [], [], [], 0
        for batch in batches:
            for _, k, d, s, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = np.zeros((len(k) // 5, 8), np.uint8)
                full[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
                keys.append(full.view(np.uint64).ravel())
                owners.append((np.cumsum(np.frombuffer(d, np.uint8), dtype=np.int64) + base).astype(np.int32))
                names.append(np.frombuffer(s, np.int64))
                musts.append(np.frombuffer(q, np.uint16))
                base += len(names[-1])
        if not keys:
            return
        # sets that came in several packets are one
        name, first, alias = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        must = np.concatenate(musts)[first].astype(np.int32)
        key, owner = np.concatenate(keys), alias.ravel()[np.concatenate(owners)].astype(np.int32)
        keys = owners = names = None
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        key, owner = key[fresh], owner[fresh]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[begins, len(key)])
        met = np.bincount(owner[np.repeat(sizes > 1, sizes)], minlength=len(name)).astype(np.int32)
        found: dict[bytes, None] = {}
        for a, m in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            found[name[owner[a : a + m]].tobytes()] = None
        some = np.flatnonzero(met > 0)
        target = (name[some].view(np.uint64) % np.uint64(width)).astype(np.int64)
        some, target = some[np.argsort(target, kind="stable")], np.sort(target)
        cuts = np.searchsorted(target, np.arange(width + 1))
        for b in range(width):
            part = some[cuts[b] : cuts[b + 1]]
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array([int(home[b])], pa.int32()), pa.array([name[part].tobytes()], pa.binary()), pa.array([met[part].tobytes()], pa.binary()), pa.array([must[part].tobytes()], pa.binary())], ["bucket", "members", "met", "must"])
        rows = list(found)
        for at in range(0, len(rows), 2000):
            part = rows[at : at + 2000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int32()), pa.array(part, pa.binary()), pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.binary())], ["bucket", "members", "met", "must"])

    packets = docs.select(text_col).mapInArrow(sign, "bucket int, k binary, d binary, s binary, q binary").repartition(width, "bucket")
    return packets.mapInArrow(meet, "bucket int, members binary, met binary, must binary").select("bucket", F.when(F.col("met").isNull(), F.xxhash64("members")).alias("g"), "members", "met", "must")


def meeting_sets(found: DataFrame) -> DataFrame:
    """(f, met): the sets that share as many signatures with others as a link would make them share."""

    def add(batches):
        parts = [(np.frombuffer(x, np.int64), np.frombuffer(m, np.int32), np.frombuffer(q, np.int32)) for batch in batches for x, m, q in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        if not parts:
            return
        name, met, must = (np.concatenate(z) for z in zip(*parts, strict=True))
        f, first, which = np.unique(name, return_index=True, return_inverse=True)
        total = np.bincount(which.ravel(), met, len(f)).astype(np.int64)
        keep = total >= must[first]  # a set's number is the same wherever it came from
        f, total = f[keep], total[keep]
        for at in range(0, len(f), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(f[at : at + 20_000]), pa.array(total[at : at + 20_000])], ["f", "met"])

    width = shuffle_width(found.sparkSession)
    return found.where("g is null").select("bucket", "members", "met", "must").repartition(width, "bucket").mapInArrow(add, "f long, met long")


def unpack(groups: DataFrame) -> DataFrame:
    """(g, f): one row per member."""

    def run(batches):
        for batch in batches:
            for g, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = np.frombuffer(m, np.int64)
                for at in range(0, len(f), 50_000):
                    part = f[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), g)), pa.array(part)], ["g", "f"])

    def packed(batches):
        """Small record batches joined, so that rows travel in thousands."""
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return groups.select("g", "members").mapInArrow(packed, "g long, f long")


def may_link(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b, met) that sizes and the Hamming bound of the sketches leave."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            if not len(na):
                continue
            keep = np.array([spare(*z, bands) >= 0 for z in zip(na.tolist(), nb.tolist(), batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)], bool)
            yield batch.select(["a", "b", "met"]).filter(pa.array(keep))

    known = lambda c: sets.select(F.col("f1").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    return pairs.join(known("a"), "a").join(known("b"), "b").select("a", "b", "met", "na", "xa", "nb", "xb").mapInArrow(run, "a long, b long, met long")


def read_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(f1, packed): the sorted shingles of the wanted sets (f1, rep), each once.

    Only texts that stand for a wanted set are read into shingles again.  They are picked by
    a bitmap of their ids of fixed size (1 MB); what it lets through by chance falls out in
    the join.
    """
    spark = docs.sparkSession
    bits = 1 << 23
    words = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(bits)).alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("v").to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)

    def read(batches):
        hashes = WordHashes()
        for batch in batches:
            h = batch.column(0).to_numpy()
            picked = np.flatnonzero((sent.value[h >> 6] >> (h & 63)) & 1)
            kept, names, packed = [], [], []
            for i in picked.tolist():
                s = shingles(hashes.of(ascii_words(batch.column(1)[i].as_py())), n)
                if len(s):  # the bitmap also lets texts without words through
                    kept.append(i)
                    names.append(fingerprints(s)[0])
                    packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(kept, pa.int64())), pa.array(names, pa.int64()), pa.array(packed, pa.binary())], ["__id", "f1", "packed"])

    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(bits)).alias("h"), text_col, id_col)
    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("f1", T.LongType()), T.StructField("packed", T.BinaryType())])
    # rows that the bitmap let through by chance, or that share an id but not the set, fall out here
    met = texts.mapInArrow(read, schema).join(wanted, "f1").where(F.col("__id") == F.col("rep"))
    return met.select("f1", "packed").dropDuplicates(["f1"])


def reaches(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have Jaccard similarity num / den or more."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def verify(pairs: DataFrame, shingled: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity reaches the threshold."""
    num, den = bands.num, bands.den

    def compare(batches):
        """Rows come sorted by pair: both sets of a pair follow each other."""
        pair, left = None, b""
        for batch in batches:
            found = []
            for a, b, second, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not second:
                    pair, left = (a, b), packed
                elif pair == (a, b) and reaches(np.frombuffer(left, np.uint64), np.frombuffer(packed, np.uint64), num, den):
                    found.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    sides = pairs.select(F.col("a").alias("f1"), "a", "b", F.lit(False).alias("second")).union(pairs.select("b", "a", "b", F.lit(True)))
    met = sides.join(shingled, "f1").select("a", "b", "second", "packed")
    return met.repartition(shuffle_width(pairs.sparkSession), "a", "b").sortWithinPartitions("a", "b", "second").mapInArrow(compare, "a long, b long")


def spare(na: int, nb: int, x: bytes, y: bytes, bands: Bands) -> int:
    """How much less two sets differ, at the least, than a link allows; -1 if their sizes forbid one."""
    if min(na, nb) * bands.den < max(na, nb) * bands.num:
        return -1
    if len(x) == len(y):
        return bands.difference(na, nb) - (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
    return bands.difference(na, nb) - int(apart(*folded([x, y])))


class Labels(dict):
    """Union-find over the labels that a task meets: what is found linked need not be compared again."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root and x != root:
            self[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def hopeful(left: np.ndarray, right: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, bands: Bands):
    """Chunk by chunk the pairs (p, q, difference still allowed) of two lists of rows whose labels differ and which may link."""
    step = max(1, 200_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        p, q = np.nonzero(root[some][:, None] != root[right][None, :])
        p, q = some[p], right[q]
        sizes = (np.minimum(n[p], n[q]) * bands.den >= np.maximum(n[p], n[q]) * bands.num)
        p, q = p[sizes], q[sizes]
        room = bands.difference(n[p], n[q]) - apart(bits[p], bits[q])
        yield p[room >= 0], q[room >= 0], room[room >= 0]


def block_links(left: np.ndarray, right: np.ndarray, f: list[int], l: list[int], n: np.ndarray, sketches: list[bytes], packed: list[bytes], bands: Bands, labels: Labels) -> list[tuple[int, int]]:
    """Links between two blocks (lists of rows) of a group, as many as join labels: a spanning forest."""
    bits, out = folded(sketches), []
    distinct, local = np.unique(np.array(l, np.int64), return_inverse=True)
    local = local.ravel()

    def roots() -> np.ndarray:
        return np.array([labels.find(x) for x in distinct.tolist()], np.int64)[local]

    for p, q, room in hopeful(left, right, roots(), n, bits, bands):
        order = np.lexsort((-room, p))
        p, q = p[order], q[order]
        while len(p):  # every row is held against its likeliest partner that is still apart
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            for i, j in zip(p[first].tolist(), q[first].tolist(), strict=True):
                if labels.find(l[i]) != labels.find(l[j]) and reaches(np.frombuffer(packed[i], np.uint64), np.frombuffer(packed[j], np.uint64), bands.num, bands.den):
                    labels.join(l[i], l[j])
                    out.append((f[i], f[j]))
            rest = np.ones(len(p), bool)
            rest[first] = False
            root = roots()
            rest &= root[p] != root[q]
            p, q = p[rest], q[rest]
    return out


def cross_links(members: DataFrame, labels: DataFrame, sets: DataFrame, shingled: DataFrame, bands: Bands) -> DataFrame:
    """Links (a, b) within groups (g, f) between sets of different labels: enough of them to join all that links join.

    Members are dealt into blocks, every two of which meet in a task of their own, whatever
    the group's size.  First sketches alone tell which sets may have a link to another label.
    Where that leaves few pairs, they are verified once for all groups in which they meet.
    Where it leaves many, the sets travel with their shingles, are verified where they meet, and a
    task hands on a link only if it joins labels that nothing before it has joined.  So
    no pass makes more rows than PAIRS times those it reads.
    """
    width, most = shuffle_width(members.sparkSession), 2 * PAIRS  # within a block each pair comes from both sides
    named = members.select("g", "f").join(labels.select(F.col("node").alias("f"), F.col("component").alias("l")), "f", "left").select("g", "f", F.coalesce("l", "f").alias("l"))

    def dealt(rows: DataFrame, each: DataFrame, by_bytes: bool) -> DataFrame:
        """Rows of groups with several labels with what is known of ``each`` set (f), once for each two blocks, sorted by them."""
        size = F.ceil(F.count(F.lit(1)) / BLOCK)
        if by_bytes:
            rows = rows.join(sets.select(F.col("f1").alias("f"), "n"), "f")
            size = F.greatest(size, F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
        open_ = rows.groupBy("g").agg(size.cast("int").alias("blocks"), F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo <> hi").select("g", "blocks")
        rows = rows.select("g", "f", "l").join(open_, "g").withColumn("block", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
        rows = rows.join(each, "f")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        keyed = rows.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("g", "i", "j", "block", "f", "l", *(c for c in each.columns if c != "f"))
        return keyed.repartition(width, "g", "i", "j").sortWithinPartitions("g", "i", "j")

    def groups(batches):
        """Tables of one group's two blocks; a group's last rows may come with the next batch."""
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            g, i, j = (t.column(c).to_numpy() for c in ("g", "i", "j"))
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            rest = t.slice(int(starts[-1]))
            yield t, starts
        if rest is not None:
            yield rest, np.array([0, rest.num_rows])

    def columns(t: pa.Table, *more: str):
        i, j, block, f, l, n = (t.column(c).to_numpy() for c in ("i", "j", "block", "f", "l", "n"))
        return i, j, block, f, l, n.astype(np.int64), *(t.column(c).to_pylist() for c in ("bits", *more))

    def sides(i: int, j: int, block: np.ndarray):
        left = np.flatnonzero(block == i)
        return left, left if i == j else np.flatnonzero(block == j)

    def hopes(batches):
        """Pairs (a, b) that may link, or of a block with many of them its sets (a) and the group; each once in a task (as far as it remembers)."""
        told: set[tuple] = set()
        for t, starts in groups(batches):
            i, j, block, f, l, n, sketches = columns(t)
            fresh: set[tuple] = set()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                if b - a == 2:  # most groups are pairs
                    if l[a] != l[a + 1] and spare(int(n[a]), int(n[a + 1]), sketches[a], sketches[a + 1], bands) >= 0:
                        fresh.add((int(min(f[a], f[a + 1])), int(max(f[a], f[a + 1])), None))
                    continue
                own, some, many = f[a:b], [], np.zeros(b - a, bool)
                found, bits = 0, folded(sketches[a:b])
                for p, q, _ in hopeful(*sides(int(i[a]), int(j[a]), block[a:b]), l[a:b], n[a:b], bits, bands):
                    many[p] = many[q] = True
                    found += len(p)
                    if found <= most * (b - a):
                        some.append(np.stack([np.minimum(own[p], own[q]), np.maximum(own[p], own[q])], 1))
                if found <= most * (b - a):
                    fresh.update((x, y, None) for z in some for x, y in z.tolist())
                else:
                    group = t.column("g")[a].as_py()
                    fresh.update((x, None, group) for x in own[many].tolist())
            fresh -= told
            told = fresh if len(told) > 500_000 else told | fresh
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in fresh], pa.int64()) for k in range(3)], ["a", "b", "g"])

    def link(batches):
        labels = Labels()
        for t, starts in groups(batches):
            i, j, block, f, l, n, sketches, packed = columns(t, "packed")
            f, l, out = f.tolist(), l.tolist(), []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a == 2:
                    if labels.find(l[a]) != labels.find(l[a + 1]) and reaches(np.frombuffer(packed[a], np.uint64), np.frombuffer(packed[a + 1], np.uint64), bands.num, bands.den):
                        labels.join(l[a], l[a + 1])
                        out.append((f[a], f[a + 1]))
                elif b - a > 2:
                    out += block_links(*sides(int(i[a]), int(j[a]), block[a:b]), f[a:b], l[a:b], n[a:b], sketches[a:b], packed[a:b], bands, labels)
            if len(labels) > 1_000_000:
                labels = Labels()
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    known = sets.select(F.col("f1").alias("f"), "n", "bits")
    hoped = dealt(named, known, False).mapInArrow(hopes, "a long, b long, g long").checkpoint()
    met = verify(hoped.where("b is not null").select("a", "b").distinct(), shingled, bands)
    many = hoped.where("g is not null").select("g", F.col("a").alias("f"))
    if many.isEmpty():
        return met
    found = dealt(named.join(many.distinct(), ["g", "f"]), known.join(shingled.select(F.col("f1").alias("f"), "packed"), "f"), True).mapInArrow(link, "a long, b long")
    return met.union(found)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    Two rows link when den * |A and B| >= num * |A or B| for their sets of n-word shingles;
    component_id is the smallest id reachable by links.  Rows with equal sets are one node,
    so repeated rows and copies cost nothing more.  Null, empty and white texts have no
    shingles, link with nothing and are their own component; a null id is kept as null and
    never the smallest.  Columns of ``docs`` other than id and text take no part.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    bands = Bands(num, den)
    rows = profile(docs, id_col, text_col, n).checkpoint()
    of_docs = rows.where("n is not null")
    frequent = frequent_shingles(rows)
    sets = of_docs.where("n > 0").groupBy("f1").agg(F.min("__id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")).checkpoint()
    found = collisions(docs, text_col, n, bands, frequent).checkpoint()
    alive = meeting_sets(found)
    members = unpack(found.where("g is not null").select("g", "members").dropDuplicates(["g"])).join(alive, "f").select("g", "f", "met").checkpoint()
    del found, alive
    release(docs.sparkSession)

    sizes = members.groupBy("g").agg(F.max(F.struct("met", "f")).alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1").checkpoint()
    stars = members.join(sizes, "g").where(F.col("f") != F.col("top.f")).groupBy(F.col("top.f").alias("a"), F.col("f").alias("b")).agg(F.max("top.met").alias("met")).checkpoint()
    shingled = read_sets(sets.join(stars.select(F.col("a").alias("f1")).union(stars.select("b")).distinct(), "f1").select("f1", "rep"), docs, id_col, text_col, n).checkpoint()
    first = may_link(stars, sets, bands).groupBy("b").agg(F.max(F.struct("met", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    linked = verify(first, shingled, bands).checkpoint()
    release(docs.sparkSession)
    # most sets that the busiest one doesn't hold find a partner in their largest group; what is then still apart is compared in all groups
    held = linked.select(F.col("b").alias("node"), F.col("a").alias("component"))  # every set has one busiest partner at most
    largest = members.join(sizes.select("g", "m"), "g").groupBy("f").agg(F.max(F.struct("m", "g")).alias("top")).select(F.col("top.g").alias("g"), "f")
    linked = linked.union(cross_links(largest, held, sets, shingled, bands)).checkpoint()
    release(docs.sparkSession)
    linked = linked.union(cross_links(members, components(linked).checkpoint(), sets, shingled, bands)).checkpoint()
    release(docs.sparkSession)

    nodes = components(linked)
    named = of_docs.join(nodes.withColumnRenamed("node", "f1"), "f1", "left").select("__id", "n", F.coalesce("component", "f1").alias("c"))
    least = named.where("c is not null").groupBy("c").agg(F.min("__id").alias("least"))
    return named.join(least, "c", "left").select(F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "__id").alias("component_id"))
