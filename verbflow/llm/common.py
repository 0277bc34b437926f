"""Pieces that several operators share: folds, bounded samples, text chunks, word hashes."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the column as text, modulo ``folds``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def hash_sample(df: DataFrame, key: str, rows: int, bound: int, salt: int = 17) -> DataFrame:
    """At most ``bound`` of ``rows`` rows, those with the least hashes of ``key``: the same rows at every run.

    A threshold on all 63 bits of the hash keeps about four times the bound before the sort, so
    that the sort is small however many rows there are; ``rows`` may be an overcount.
    """
    if rows <= bound:
        return df
    hashed = df.withColumn("__h", F.xxhash64(F.lit(salt), F.col(key)).bitwiseAND((1 << 63) - 1))
    near = hashed.where(F.col("__h") <= F.lit(min((1 << 63) - 1, (1 << 63) * (4 * bound + 64) // rows)))
    return near.orderBy("__h").limit(bound).drop("__h")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_fields(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])


def bucket_keys(spark: SparkSession, width: int) -> list[int]:
    """For each partition of a repartition to ``width`` by an int column, an int that lands there."""
    found: dict[int, int] = {}
    at = 0
    while len(found) < width:
        for r in spark.range(at, at + 16 * width).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(width)).alias("p")).collect():
            found.setdefault(r.p, r.i)
        at += 16 * width
    return [found[p] for p in range(width)]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; set one of our own only where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(shared)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    Spark does so when the driver's garbage is collected, of its own accord every 30 minutes only.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8.

    ``bytes.lower`` touches A-Z only and ``bytes.split`` splits on exactly these six bytes.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def text_chunks(texts: Iterable[str | None], budget: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive runs of whole texts of about ``budget`` characters, with the index of the first.

    A text longer than the budget is a run of its own; none is cut.
    """
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        if run and size + len(text or "") > budget:
            yield start, run
            start, size, run = i, 0, []
        run.append(text)
        size += len(text or "")
    if run:
        yield start, run


def row_runs(batch: pa.RecordBatch, column: int, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of whole rows with about ``budget`` bytes of text in ``column``; a longer text is a run of its own.

    Spark's batches are counted in rows, so as Python objects the texts of one take whatever the rows are long.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + budget, "right")))
        yield batch.slice(at, until - at)
        at = until


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``limit`` words and then begun anew."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit given."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-word runs; the order of the words matters."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(n):
        total += words[i : i + count] * np.uint64(factor)
        factor = (factor * 0xD1342543DE82EF95 + 2) & MASK64 | 1
    return mix64(total)
