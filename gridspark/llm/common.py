"""Helpers shared by the text operators: reading tables, checkpoints, components and numpy word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from tempfile import mkdtemp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 2_000_000
#: Spark's setting that an execution deletes its shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_row(doc_id: str = "doc_id"):
    """True for rows that models may learn from: crc32 of the id's text, mod 4, is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: str = "doc_id"):
    """True where that remainder is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def row_key():
    """A key of a document row by content; repeated rows share it on purpose."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def wide_row_key():
    """The same in 128 bits, so that no two rows of a large corpus meet by chance."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("")))
    return F.unhex(F.md5(text))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own where none is set, in local mode only."""
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or mkdtemp(prefix="spark-checkpoint-"))
        now = context._jsc.sc().getCheckpointDir()
    return now.get()


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one struct `row` with the columns `more` beside it, so that no name of the caller's can clash with ours."""
    return docs.select(F.struct("*").alias("row"), *more)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint, which cuts lineage and survives lost executors.

    The step's shuffle files go as soon as it is written, so that long chains of steps don't hold all their
    files to the end. Only this execution is set so: df itself may be read again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), long or binary: rows (id, comp), comp the smallest id.

    While some id points to several smaller ones, large-star and small-star steps; once each points to
    one, ids point to where that one points, which takes three stages instead of eight. It ends as soon
    as no id both points and is pointed to. Every step is a grouped minimum with
    map-side combine and a join, so that a hub is no group in one task.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        most, longer = ends.agg(F.max("up"), F.max(F.least("up", "down"))).first()
        if not longer and (most or 0) <= 1:
            return now.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        if most == 1:
            up = now.select(F.col("a").alias("of"), F.col("b").alias("up"))
            now = cut(now.join(up, now["b"] == up["of"], "left").select("a", F.coalesce("up", "b").alias("b")))
            continue
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.where("a <> b").distinct())


def table_of_bytes(excluded: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(excluded.encode("latin-1"), np.uint8)] = True
    return out


#: Bytes that end a word: white space for the first, all of ASCII but digits and letters for the second.
BLANKS = table_of_bytes("\x20\x09\x0a\x0b\x0c\x0d")
NOT_ALNUM = table_of_bytes("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
_RNG = np.random.default_rng(20240613)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_SECOND = U64(0xC2B2AE3D27D4EB4F)
_SECOND_INVERSE = U64(pow(int(_SECOND), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base^position modulo 2^64, one longer than the data."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:], dtype=U64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever it stands."""
    return (prefix[end] - prefix[start]) * inverse[start]


def inverse_powers(n: int) -> np.ndarray:
    return powers(_INVERSE, n)


def second_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums under another base and another coding of bytes, and the inverse powers."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(mix(np.arange(1, 257, dtype=U64))[data] * powers(_SECOND, len(data)), out=out[1:], dtype=U64)
    return out, powers(_SECOND_INVERSE, len(data) + 1)


@dataclass
class Words:
    """The words of a chunk of texts, in order; `first[i]:first[i+1]` are those of text i."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def second(self) -> np.ndarray:
        """Hashes of the words that don't depend on `hash`."""
        return word_hash(np.frombuffer(self.data, np.uint8), self.start, self.end, 2)


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Of each word the sum of its eight-byte pieces, each mixed with the seed and its place. No polynomial, so no word of a pattern cancels out."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    count = (size + 7) // 8
    first = np.cumsum(count) - count
    place = np.arange(count.sum()) - np.repeat(first, count)
    left = np.minimum(np.repeat(size, count) - 8 * place, 8)
    # Every eight bytes of the data, wherever they begin.
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    x = eight[np.repeat(start, count) + 8 * place] & (U64(2**64 - 1) >> (8 * (8 - left)).astype(U64))
    key = mix((place.astype(U64) + U64(1)) * U64(0xA24BAED4963EE407) + U64(seed))
    return mix(np.add.reduceat(mix(x ^ key), first) + size.astype(U64))


def words_of(texts: list[bytes | None], ends_word: np.ndarray) -> Words:
    """Lower-case A-Z and cut into words, for all texts at once."""
    texts = [x or b"" for x in texts]
    data = b" ".join([*texts, b""]).lower()
    raw = np.frombuffer(data, np.uint8)
    bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = ends_word[raw]
    start = np.flatnonzero(gap[:-1] & ~gap[1:])
    end = np.flatnonzero(~gap[:-1] & gap[1:])
    hashes = word_hash(raw, start, end, 1)
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), hashes, first)


def window_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbouring words; also across texts, which the caller masks."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.full(m, U64(n))
    for k in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + hashes[k : k + m])
    return out


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes sum to `most` at most; a larger one stands alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with CHUNK_BYTES of text each at most; a longer text stands alone. Only a slice's texts become Python objects."""
    texts = batch.column(column).cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 1
    for at, to in pieces(sizes, CHUNK_BYTES):
        yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
