"""Hard negatives by blocked dense matrix products.

Vectors become whole numbers, floor(256 * component), and a score is their inner product. Blocks of
anchors of bounded size are broadcast; each task multiplies a block with its rows, batch by batch, as
doubles, which is exact while every sum stays under 2^53 (checked by a bound for each product, beyond
which whole numbers of any size are taken). The first pass keeps each anchor's best positives, rows
of its label, in lists that merge across tasks. The second pass keeps for each anchor and positive the
best rows of other labels within the window that the positive's score opens. Only such lists are shuffled.

Rows without an id or label, and vectors that are null, empty or hold null or non-finite components
take no part. Vectors meet those of their own length only. Rows that repeat an id count as one row: as
an anchor by the least of its labels and vectors, as a positive or negative by the best that qualifies. Ties go to the
smaller id. Scores beyond 2^53 either way are rounded to a double, beyond 2^56 they count as 2^56. An anchor without positives, or a window
without rows, gives no row, as does an empty table. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.vectors import TILE, BestOf, blocks, matrices

#: Whole numbers that doubles hold exactly, and the most that a score may be.
EXACT, MOST = 2.0**53, 1 << 56


def whole(m: np.ndarray) -> np.ndarray:
    return np.floor(256 * m)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact below EXACT, else summed as whole numbers of any size and then rounded to doubles."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(exact(a) @ exact(b).T, -MOST, MOST).astype(np.float64)


def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and whole vectors of the rows of a batch, by length."""
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    for rows, m in matrices(batch.column("embedding")):
        yield ids[rows], labels[rows], whole(m)


def anchors_of(block: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return {m.shape[1]: (ids, labels, m) for ids, labels, m in parts(block)}


def batch_of(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


POSITIVE = ["anchor_id", "positive_id", "positive_score"]
NEGATIVE = [*POSITIVE, "negative_id", "negative_score"]
longs = lambda names: ", ".join(f"{n} long" for n in names)


def positives_of(block, k: int):
    """First pass: each anchor's k best rows of its own label among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        found = {dim: BestOf(len(x[0]), k) for dim, x in anchors.items()}
        for batch in batches:
            for ids, labels, m in parts(batch):
                if (dim := m.shape[1]) not in anchors:
                    continue
                names, own, vectors = anchors[dim]
                for label in np.intersect1d(own, labels):
                    rows, mine = np.flatnonzero(labels == label), np.flatnonzero(own == label)
                    per = max(1, TILE // len(rows))
                    for at in range(0, len(mine), per):
                        tile = mine[at : at + per]
                        scores = products(vectors[tile], m[rows])
                        which, row = np.nonzero((scores >= found[dim].least[tile, None]) & (ids[rows] != names[tile, None]))
                        found[dim].add(tile[which], ids[rows[row]], scores[which, row])
        for dim, lists in found.items():
            which, ids, scores = lists.entries()
            yield batch_of(POSITIVE, anchors[dim][0][which], ids, scores)

    return run


def negatives_of(block, windows, k: int):
    """Second pass: the k best rows of other labels in each window among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, opened = block.value, windows.value
        found = {dim: BestOf(len(opened[dim][0]), k) for dim in anchors}
        for batch in batches:
            for ids, labels, m in parts(batch):
                if (dim := m.shape[1]) not in anchors:
                    continue
                _, own, vectors = anchors[dim]
                of, _, _, low, high = opened[dim]
                per = max(1, TILE // len(ids))
                for at in range(0, len(of), per):
                    tile = slice(at, at + per)
                    lines, line = np.unique(of[tile], return_inverse=True)
                    scores = products(vectors[lines], m)[line]
                    least = np.maximum(low[tile], found[dim].least[tile])
                    which, row = np.nonzero((scores >= least[:, None]) & (scores <= high[tile, None]) & (labels != own[of[tile], None]))
                    found[dim].add(at + which, ids[row], scores[which, row])
        for dim, lists in found.items():
            which, ids, scores = lists.entries()
            of, positive, score, _, _ = opened[dim]
            yield batch_of(NEGATIVE, anchors[dim][0][of[which]], positive[which], score[which], ids, scores)

    return run


def windows_of(anchors: dict, positives: pa.Table, low: int, high: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, for each anchor and positive: the anchor's place, the positive's id and score, and the window in percent of its score."""
    names, ids, scores = (positives.column(n).to_numpy() for n in POSITIVE)
    out = {}
    for dim, (own, _, _) in anchors.items():
        order = np.argsort(own)
        place = np.searchsorted(own[order], names)
        mine = (place < len(own)) & (own[order][np.minimum(place, len(own) - 1)] == names)
        s = scores[mine]
        at = np.argsort(order[place[mine]], kind="stable")
        out[dim] = tuple(x[at] for x in (order[place[mine]], ids[mine], s, -((-low * s) // 100), (high * s) // 100))
    return out


def ranked(rows: DataFrame, group: list[str], name: str, k: int) -> DataFrame:
    """The k best of each group's merged lists, an id once."""
    best = rows.repartition(*group).groupBy(*group, f"{name}_id").agg(*(F.max(c).alias(c) for c in rows.columns if c not in (*group, f"{name}_id")))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(f"{name}_score"), f"{name}_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors and anchors (vec_id, embedding, label); an anchor's own id is no positive of it. A negative's
    score is from low to high percent of the positive's.
    """
    spark = vectors.sparkSession
    typed = lambda df: df.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows, out = typed(vectors), spark.createDataFrame([], longs(NEGATIVE))
    one = typed(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    for table in blocks(one):
        block = anchors_of(table)
        sent = spark.sparkContext.broadcast(block)
        # A block's positives are a few rows for each of its anchors.
        first = ranked(rows.mapInArrow(positives_of(sent, positives), longs(POSITIVE)), ["anchor_id"], "positive", positives).select(*POSITIVE).toArrow()
        opened = spark.sparkContext.broadcast(windows_of(block, first, low, high))
        out = out.unionByName(rows.mapInArrow(negatives_of(sent, opened, negatives), longs(NEGATIVE)))
    found = ranked(out, ["anchor_id", "positive_id"], "negative", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
