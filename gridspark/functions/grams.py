"""Which pieces of texts meet in a near-distance join: few rare ones of one side, all of the other.

Under k edits destroy at most k - 1 of k disjoint pieces of a text, so one piece stands in the other text too, moved
by k - 1 places at most. Any k disjoint pieces will do: of all grams of a text the k disjoint ones with the least
sum of counts are taken, counts being those of the other side by hash bucket. Grams are named by a 64-bit hash
with their length; that different ones may share a name costs a comparison, never a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gridspark.functions.edit import code_points

U64 = np.uint64
#: Buckets of the counts, and the longest gram.
BUCKETS, LONGEST = 1 << 16, 24
_STEP, _MIX = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def gram_size(length: int, k: int) -> int:
    """Of a text: k grams take two thirds of it, the rest leaves room to choose. 0 where it is too short for k pieces."""
    return 0 if length < k else min(LONGEST, max(1, 2 * length // (3 * k)))


def gram_sizes(length: int, k: int) -> list[int]:
    """The sizes that texts within k - 1 edits may have chosen."""
    return sorted({gram_size(n, k) for n in range(max(0, length - k + 1), length + k)})


def names(rows: np.ndarray, q: int) -> np.ndarray:
    """The names of the grams at all places of texts of one length; of size 0 there is one, the same for all texts."""
    if not q:
        return np.full((len(rows), 1), _MIX, U64)
    n = rows.shape[1] - q + 1
    out = np.full((len(rows), max(0, n)), U64(q))
    for i in range(q):
        out *= _STEP
        out += rows[:, i : i + max(0, n)].astype(U64)
        out ^= out >> U64(29)
    out *= _MIX
    return out ^ (out >> U64(32))


def counts(k: int):
    """A task's numbers of grams by bucket: (bucket, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, rows in code_points(batch.column(0).to_pylist()):
                for q in gram_sizes(rows.shape[1], k):
                    total += np.bincount((names(rows, q) % U64(BUCKETS)).astype(np.int64).ravel(), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def rarest(cost: np.ndarray, q: int, k: int) -> np.ndarray:
    """Of each row of costs the starts of k disjoint grams of size q with the least sum."""
    n, starts = cost.shape
    length = starts + q - 1
    best = np.full((k + 1, length + 1, n), np.iinfo(np.int64).max // 2)
    best[0] = 0
    for p in range(q, length + 1):
        best[1:, p] = np.minimum(best[1:, p - 1], best[:-1, p - q] + cost[:, p - q])
    out, at, every = np.zeros((n, k), np.int64), np.full(n, length), np.arange(n)
    for j in range(k, 0, -1):
        moving = np.ones(n, bool)
        while moving.any():
            moving = (at > q) & (best[j, np.maximum(at - 1, 0), every] == best[j, at, every])
            at = at - moving
        at = at - q
        out[:, j - 1] = at
    return out


def chosen(table, k: int):
    """(key, at, text) of the k pieces of each text; one for a text that is too short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for place, rows in code_points(texts.to_pylist()):
                q = gram_size(rows.shape[1], k)
                grams = names(rows, q)
                starts = rarest(table.value[(grams % U64(BUCKETS)).astype(np.int64)], q, k) if q else np.zeros((len(rows), 1), np.int64)
                yield posted(texts, place, starts, np.take_along_axis(grams, starts, axis=1))

    return run


def posted(texts: pa.Array, place: np.ndarray, starts: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
    of = pa.array(np.repeat(place, starts.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(grams.ravel().view(np.int64)), pa.array(starts.ravel().astype(np.int32)), texts.take(of)], names=["key", "at", "text"])


def bit_of(key: np.ndarray, bits: int) -> np.ndarray:
    """The place of a name in the bit map; the same as pmod in Spark."""
    return key.view(np.int64) % bits


def met(bitmap, bits: int, k: int):
    """(key, at, text) of all grams of a text whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for place, rows in code_points(texts.to_pylist()):
                for q in gram_sizes(rows.shape[1], k):
                    grams = names(rows, q)
                    if not grams.size:
                        continue
                    bit = bit_of(grams, bits)
                    row, at = np.nonzero((bitmap.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    yield pa.RecordBatch.from_arrays([pa.array(grams[row, at].view(np.int64)), pa.array(at.astype(np.int32)), texts.take(pa.array(place[row]))], names=["key", "at", "text"])

    return run
