"""Nearest neighbours by cosine over randomly rotated one-bit codes.

The index keeps of each row, beside its vector, one bit for each coordinate of the rotated unit vector
o: the code c holds the signs over sqrt(d). From the bits and the correction scalar a = <c, o> the
inner product with a rotated unit query q is estimated as <c, q> / a. Under a random rotation the
estimate is off by t * sqrt(1 - a^2) / a at most, where t is a coordinate of a random unit vector of
d - 1 dimensions: beyond ERRORS / sqrt(d - 1) with a chance of about one in a thousand, and never beyond 1.
A task goes through its rows by batch, estimates all of a batch against a block of queries from the
packed bits, and reranks by exact cosine the rows whose upper bound reaches the query's k-th best
exact cosine so far. Its k best for each query go out; the lists of all tasks merge to the result.

The rotation depends on the number of dimensions alone, so nothing is fitted and every row is indexed.
Query blocks of bounded size are broadcast one after another: a stated query set against all rows.

Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components take
no part. Vectors meet those of their own length only. Rows that repeat an id count as one row: as a query by the
least of its vectors, as a neighbour by the nearest. Ties go to the smaller id. Fewer than k other
rows give fewer ranks; an empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import cut
from gridspark.llm.vectors import TILE, BestOf, blocks, matrices

#: Standard deviations of the estimate that its bound allows for.
ERRORS = 3.0
#: What 32-bit arithmetic may add to an estimate.
ROUNDING = 1e-4
#: Pairs whose exact cosines are taken at once.
PAIRS = 4096
#: Rows of the highest estimates, in multiples of k, that are reranked first, so that the others have a bound to reach.
AHEAD = 8


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng([7, dim]).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1, 1)


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square leaves the range of doubles; cosines keep every bit."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def units(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the columns of a and b, (dimension, pair), summed from the first coordinate to the last, so that every run gives the same bits."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


@dataclass
class Exact:
    """Vectors as columns with their lengths, for exact cosines."""

    columns: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, m: np.ndarray) -> Exact:
        columns = np.ascontiguousarray(scaled(m).T)
        return cls(columns, np.sqrt(products(columns, columns)))

    def cosines(self, mine: np.ndarray, other: Exact, theirs: np.ndarray) -> np.ndarray:
        """Of pairs of columns, some thousand at a time."""
        out = np.empty(len(mine))
        for at in range(0, len(mine), PAIRS):
            i, j = mine[at : at + PAIRS], theirs[at : at + PAIRS]
            out[at : at + PAIRS] = products(self.columns[:, i], other.columns[:, j]) / (self.length[i] * other.length[j])
        return out


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with the packed signs of their rotated vector and the correction scalar."""
    for batch in batches:
        for rows, m in matrices(batch.column("embedding")):
            keep = np.abs(m).max(axis=1) > 0
            rows, m = rows[keep], m[keep]
            turned = units(m) @ rotation(m.shape[1])
            bits = np.packbits(turned >= 0, axis=1)
            a = np.abs(turned).sum(axis=1) / np.sqrt(m.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(a)], names=["vec_id", "embedding", "code", "a"])


def index(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, code, a) of all rows of vectors (vec_id, embedding) that take part."""
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(coded, "vec_id long, embedding array<double>, code binary, a double")


def queries_of(block: pa.Table) -> dict[int, tuple[np.ndarray, Exact, np.ndarray]]:
    """By length: ids, vectors, rotated unit vectors."""
    ids, out = block.column("vec_id").to_numpy(), {}
    for rows, m in matrices(block.column("embedding")):
        keep = np.abs(m).max(axis=1) > 0
        m = m[keep]
        out[m.shape[1]] = ids[rows[keep]], Exact.of(m), (units(m) @ rotation(m.shape[1])).astype(np.float32)
    return out


def searched(block, k: int):
    """The k best of each query of the broadcast block among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        found = {dim: BestOf(len(q[0]), k) for dim, q in asked.items()}
        for batch in batches:
            ids, codes, scalar = batch.column("vec_id").to_numpy(), batch.column("code"), batch.column("a").to_numpy()
            for rows, m in matrices(batch.column("embedding")):
                dim = m.shape[1]
                if dim not in asked:
                    continue
                names, exact, turned = asked[dim]
                bits = np.frombuffer(b"".join(codes.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
                a, own, rows = scalar[rows], ids[rows], Exact.of(m)
                away = min(1.0, ERRORS / max(1.0, dim - 1.0) ** 0.5) * np.sqrt(np.maximum(0, 1 - a * a)) / a + ROUNDING
                per = max(1, TILE // len(own))
                for at in range(0, len(names), per):
                    tile = slice(at, at + per)
                    estimate = (turned[tile] @ signs.T) / a.astype(np.float32)
                    allowed = own != names[tile, None]

                    def rerank(which: np.ndarray, row: np.ndarray) -> None:
                        scores = exact.cosines(at + which, rows, row)
                        enough = scores >= found[dim].least[at + which]
                        found[dim].add(at + which[enough], own[row[enough]], scores[enough])

                    if len(own) > AHEAD * k and np.isinf(found[dim].least[tile]).any():
                        row = np.argpartition(-estimate, AHEAD * k - 1, axis=1)[:, : AHEAD * k]
                        ahead = np.zeros(estimate.shape, bool)
                        np.put_along_axis(ahead, row, True, axis=1)
                        rerank(*np.nonzero(ahead & allowed))
                        allowed &= ~ahead
                    estimate += away.astype(np.float32)
                    rerank(*np.nonzero((estimate >= found[dim].least[tile, None]) & allowed))
        for dim, lists in found.items():
            which, ids, scores = lists.entries()
            yield pa.RecordBatch.from_arrays([pa.array(asked[dim][0][which]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) its k nearest rows of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = cut(index(vectors))
    asked = queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for block in blocks(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))):
        sent = spark.sparkContext.broadcast(queries_of(block))
        out = out.unionByName(rows.mapInArrow(searched(sent, k), out.schema))
    best = out.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
