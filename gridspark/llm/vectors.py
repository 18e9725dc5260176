"""Vectors in Arrow batches, query blocks of bounded size that are broadcast to them, and mergeable best-of lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import cut

#: Bytes of query vectors (as doubles) that are collected and broadcast at once.
BLOCK_BYTES = 8_000_000
#: Scores that are held at once: queries of a tile times rows of a batch.
TILE = 2_000_000


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their vectors as doubles, by length; null or empty lists and lists with a null or non-finite entry are left out."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(lists).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        m = flat.reshape(-1, size) if len(flat) == size * len(rows) else flat[starts[rows, None] + np.arange(size)]
        good = np.isfinite(m).all(axis=1)
        yield (rows, m) if good.all() else (rows[good], m[good])


def blocks(rows: DataFrame) -> Iterator[pa.Table]:
    """rows (vec_id, embedding, ...), one for each id, as tables of about BLOCK_BYTES of vectors."""
    rows = cut(rows)
    n, longest = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    many = -(-n * 8 * (longest or 0) // BLOCK_BYTES)
    for b in range(many):
        yield rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(many)) == b).toArrow()


def best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the k best of their group, and their ranks: higher scores first, ties by smaller id; of entries with the same id the best counts."""
    order = np.lexsort((-scores, ids, group))
    first = np.ones(len(order), bool)
    first[1:] = (group[order[1:]] != group[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
    order = order[first]
    order = order[np.lexsort((ids[order], -scores[order], group[order]))]
    sorted_group = group[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
    return order[rank < k], rank[rank < k]


class BestOf:
    """The k best (id, score) of each of n groups, over what has been added so far; empty places score minus infinity."""

    def __init__(self, n: int, k: int):
        self.ids, self.scores = np.zeros((n, k), np.int64), np.full((n, k), -np.inf)

    @property
    def least(self) -> np.ndarray:
        """What a score has to reach."""
        return self.scores[:, -1]

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(group):
            return
        k = self.ids.shape[1]
        touched, group = np.unique(group, return_inverse=True)
        old = self.scores[touched]
        held = np.flatnonzero(old > -np.inf)
        group, ids, scores = np.concatenate([held // k, group]), np.concatenate([self.ids[touched].ravel()[held], ids]), np.concatenate([old.ravel()[held], scores])
        take, rank = best(group, ids, scores, k)
        old[:], new = -np.inf, np.zeros_like(self.ids[touched])
        old[group[take], rank], new[group[take], rank] = scores[take], ids[take]
        self.ids[touched], self.scores[touched] = new, old

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, place = np.nonzero(self.scores > -np.inf)
        return group, self.ids[group, place], self.scores[group, place]
