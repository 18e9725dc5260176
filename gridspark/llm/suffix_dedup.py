"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of LENGTH bytes that starts at two places is repeated; every byte that such a string
covers goes. Each window of LENGTH bytes has an anchor, the leftmost of its smallest hashes of
GRAM bytes, which equal windows share at the same offset. Windows with one anchor and offsets of
one cell of GRID values form a row whose key hashes the bytes that all of them hold (the core):
equal windows meet under one key. Keys are counted with map-side combine; rows of keys that
stand once are dropped.

Rows with the same bytes in and around them (their context) are one class; two rows in a class
are repeated throughout. Where a key has several classes, one context of each goes to a task by
key, which sorts the suffixes at the window starts: prefix polynomial hashes and a binary search
give the common extension of two suffixes, so that a comparison in the mergesort takes
logarithmic time; neighbours with LENGTH bytes in common are verified byte by byte. Keys of more
than GROUP classes (a passage in very many texts) are dealt out as single windows instead, which
meet by a 128-bit hash, so that no task holds such a group.

What hashes alone have matched (rows of one class, windows of a frequent key) is a claim: these
bytes equal those of the class's or window's first place. Claims of one text and shift are merged
into runs, each run gets the bytes of its first place by a join, and the text's own task compares
them before anything goes. Bytes that differ stop the job: no result rests on a hash collision.
Joins on keys that many rows share have tables of one row a key on the other side, so that Spark
can split them.

Null texts are empty; texts under LENGTH bytes lose nothing. A long text comes in pieces that
overlap. Repeated rows repeat all their strings; ties between places go to the least row key and
place, which changes no result. An empty table gives an empty result. Only doc_id and text are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import CHUNK_BYTES, U64, chunks, cut, inverse_powers, mix, prefix_hash, row_key, second_hash, span_hash

LENGTH, GRAM, GRID, GROUP = 400, 16, 128, 2000
#: Bytes of text that are cut into windows at once; a byte takes about a hundred bytes of arrays.
CELL_BYTES = 1_000_000


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    pad = -len(x) % w
    rows = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, U64)]).reshape(-1, w)
    up = np.minimum.accumulate(rows, 1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(down[:m], up[w - 1 : w - 1 + m])


def cells(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows of windows: text, first start in it, number of windows, key and hash of the context."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 5
    gram, grid = min(GRAM, length), min(GRID, max(1, length // 3))
    prefix, back = prefix_hash(raw), inverse_powers(len(raw) + 1)
    at = np.arange(len(raw) - gram + 1)
    h = mix(span_hash(prefix, at, at + gram, back))
    least = sliding_least((h >> U64(24) << U64(24)) | at.astype(U64), length - gram + 1)
    anchor = (least & U64((1 << 24) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    p = np.arange(len(anchor))
    valid = doc[p] == doc[p + length - 1]
    cell = (anchor - p) // grid
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1]) | (doc[1 : len(p)] != doc[: len(p) - 1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(p)))
    keep = valid[first]
    first, n = first[keep], n[keep]
    core = anchor[first] - grid * cell[first]
    key = mix(span_hash(prefix, core, core + length - grid + 1, back) + cell[first].astype(U64))
    full = mix(span_hash(prefix, first, first + n - 1 + length, back) + n.astype(U64))
    return doc[first], first - starts[doc[first]], n, key.view(np.int64), full.view(np.int64)


def all_cells(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                texts = [x or b"" for x in texts]
                # A long text comes in pieces that share length - 1 bytes.
                pieces = [(i, s, x[s : s + CELL_BYTES + length - 1]) for i, x in enumerate(texts) for s in range(0, max(1, len(x) - length + 1), CELL_BYTES)]
                groups, size = [[]], 0
                for piece in pieces:
                    if size + len(piece[2]) > CELL_BYTES and groups[-1]:
                        groups.append([])
                        size = 0
                    groups[-1].append(piece)
                    size += len(piece[2])
                for group in groups:
                    got = cells(b"".join(x for _, _, x in group), np.cumsum([0, *(len(x) for _, _, x in group)]), length)
                    text, shift = (np.array([g[k] for g in group], np.int64) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([rows.column("rk").take(pa.array(text[got[0]])), pa.array(got[1] + shift[got[0]]), *map(pa.array, got[2:])], names=["rk", "p", "n", "key", "full"])

    return run


class Suffixes:
    """Compares suffixes of a buffer, up to `length` bytes, by hashes of their prefixes."""

    def __init__(self, data: bytes, length: int):
        self.data, self.length = data, length
        raw = np.frombuffer(data, np.uint8)
        self.raw, self.prefix, self.back = raw, prefix_hash(raw), inverse_powers(len(raw) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes two suffixes have in common, by binary search over hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        pa_, pb, ia, ib = self.prefix[a], self.prefix[b], self.back[a], self.back[b]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (self.prefix[a + mid] - pa_) * ia == (self.prefix[b + mid] - pb) * ib
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def below(self, a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffix a comes before suffix b; `equal` for those with length bytes in common."""
        n = self.common(a, b)
        at = np.minimum(n, self.length - 1)
        return np.where(n == self.length, equal, self.raw[a + at] < self.raw[b + at])

    def sorted(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order of suffixes within buckets (which must ascend): a bottom-up mergesort over all buckets at once."""
        base = np.searchsorted(bucket, bucket)
        size = np.searchsorted(bucket, bucket, side="right") - base
        order = np.arange(len(start))
        width = 1
        while (size > width).any():
            active = np.flatnonzero(size > width)
            slot = active - base[active]
            mate = (slot // width ^ 1) * width  # where the run to merge with begins
            lo, hi = np.minimum(mate, size[active]), np.minimum(mate + width, size[active])
            left = slot // width % 2 == 0
            begin = lo.copy()
            own = start[order[active]]
            while (open_ := lo < hi).any():
                k = np.flatnonzero(open_)
                mid = (lo[k] + hi[k]) // 2
                mates = start[order[base[active[k]] + mid]]
                before = np.where(left[k], self.below(mates, own[k], False), self.below(mates, own[k], True))
                lo[k], hi[k] = np.where(before, mid + 1, lo[k]), np.where(before, hi[k], mid)
            to = base[active] + slot // (2 * width) * 2 * width + slot % width + lo - begin
            moved = order.copy()
            moved[to] = order[active]
            order, width = moved, 2 * width
        return order

    def repeated(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Which starts have a neighbour in the sorted order with length bytes in common, verified on the bytes."""
        order = self.sorted(start, bucket)
        a, b = order[:-1], order[1:]
        near = bucket[a] == bucket[b]
        a, b = a[near], b[near]
        same = self.common(start[a], start[b]) == self.length
        a, b = a[same], b[same]
        # Neighbouring windows of two contexts are verified in one comparison.
        by = np.lexsort((start[a], start[b] - start[a]))
        a, b = a[by], b[by]
        x, y = start[a], start[b]
        new = np.ones(len(x), bool)
        new[1:] = (np.diff(x) != 1) | (np.diff(y) != 1)
        first = np.flatnonzero(new)
        out = np.zeros(len(start), bool)
        for i, j in zip(first, np.append(first[1:], len(x)), strict=True):
            if self.data[x[i] : x[j - 1] + self.length] == self.data[y[i] : y[j - 1] + self.length]:
                out[a[i:j]] = out[b[i:j]] = True
            else:
                for k in range(i, j):
                    out[a[k]] |= (true := self.data[x[k] : x[k] + self.length] == self.data[y[k] : y[k] + self.length])
                    out[b[k]] |= true
        return out


MARK = "key long, full long, lo long, hi long"


def sorted_marks(length: int):
    """Contexts in order of key: the ranges of their windows that another context of the key repeats, where the class has no other row."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = b"".join(r[3] for r in rows)
        at = np.cumsum([0, *(len(r[3]) for r in rows)])[:-1]
        n = np.array([len(r[3]) - length + 1 for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        key = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        # Equal windows lie equally far before their anchor.
        bucket = key[row] * (1 << 20) + np.array([r[2] for r in rows])[row] - offset + length
        order = np.argsort(bucket, kind="stable")
        flag = np.zeros(len(row), bool)
        flag[order] = Suffixes(data, length).repeated((at[row] + offset)[order], bucket[order])
        lo, hi = ranges_by(flag & (np.array([r[4] for r in rows]) == 1)[row], n)
        which = np.searchsorted(np.cumsum(n), lo, side="right")
        first = np.cumsum(n) - n
        return pa.RecordBatch.from_arrays([pa.array([rows[i][k] for i in which], pa.int64()) for k in range(2)] + [pa.array(lo - first[which]), pa.array(hi - first[which])], names=["key", "full", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for part, context in chunks(batch, "context"):
                columns = [part.column(c).to_pylist() for c in ("key", "full", "ahead", "c")]
                for key, full, ahead, c, data in zip(*columns, context, strict=True):
                    if size > CHUNK_BYTES and key != rows[-1][0]:
                        yield solve(rows)
                        rows, size = [], 0
                    rows.append((key, full, ahead, data, c))
                    size += len(data)
        if rows:
            yield solve(rows)

    return run


def merged_runs(*keys: str):
    """Rows of keys with a list of spans (lo, hi): one row for each run of spans that touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            sizes = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            lo, hi = (np.asarray(spans.flatten().field(c)) for c in ("lo", "hi"))
            by = np.lexsort((lo, row))
            row, lo, hi = row[by], lo[by], hi[by]
            new = np.ones(len(row), bool)
            # Spans of one shift are windows of equal length or rows of them: in order of lo, ends by row rise too once carried on.
            end = carried(row, hi)
            new[1:] = (row[1:] != row[:-1]) | (lo[1:] > end[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[first])) for k in keys), pa.array(lo[first]), pa.array(end[last])], names=[*keys, "lo", "hi"])

    return run


def carried(row: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest end so far within each row (rows ascend)."""
    if not len(hi):
        return hi
    wide = int(hi.max()) + 1
    return np.maximum.accumulate(row * wide + hi) - row * wide


def ranges_by(flag: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True, broken where a context ends."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    edge = np.ones(len(flag) + 1, bool)
    edge[1:-1] = (flag[1:] != flag[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(edge)
    lo, hi = at[:-1], at[1:]
    return lo[flag[lo]], hi[flag[lo]]


CONTEXT = "key long, full long, c long, d long, rk long, p long, ahead long, context binary"


def contexts(length: int):
    """Bytes of rows: texts with the list of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                for rk, x, wanted in zip(rows.column("rk").to_pylist(), texts, rows.column("rows").to_pylist(), strict=True):
                    # A row is LENGTH + GRID bytes at most; a text's rows come in slices of about CHUNK_BYTES.
                    for k in range(0, len(wanted), CHUNK_BYTES // (length + GRID)):
                        part = wanted[k : k + CHUNK_BYTES // (length + GRID)]
                        context = [x[r["p"] : r["p"] + r["n"] - 1 + length] for r in part]
                        longs = [[r[c] for r in part] for c in ("key", "full", "c", "d")] + [[rk] * len(part), [r["p"] for r in part], [anchor_of(c, length) for c in context]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in longs), pa.array(context, pa.binary())], names=[c.split()[0] for c in CONTEXT.split(", ")])

    return run


def anchor_of(context: bytes, length: int) -> int:
    """How far the anchor of a context's windows lies after its first byte."""
    gram = min(GRAM, length)
    raw = np.frombuffer(context[:length], np.uint8)
    at = np.arange(length - gram + 1)
    h = mix(span_hash(prefix_hash(raw), at, at + gram, inverse_powers(length + 1))) >> U64(24)
    return int(np.argmin(h))


def window_hashes(length: int):
    """One row for each window of a context, with two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, context in chunks(batch, "context"):
                keys = [part.column(c) for c in ("key", "full", "c", "rk", "p")]
                for i, c in enumerate(context):
                    raw = np.frombuffer(c, np.uint8)
                    at = np.arange(len(raw) - length + 1)
                    prefix, back = prefix_hash(raw), inverse_powers(len(raw) + 1)
                    other, other_back = second_hash(raw)
                    a = mix(span_hash(prefix, at, at + length, back)).view(np.int64)
                    b = mix((other[at + length] - other[at]) * other_back[at]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(k.take(pa.array(np.full(len(at), i))) for k in keys), pa.array(at), pa.array(a), pa.array(b)], names=["key", "full", "c", "rk", "p", "at", "a", "b"])

    return run


def removed(texts: list[bytes | None], marks: list[list | None]) -> Iterator[tuple[bytes, int, int]]:
    """(rest, removed bytes, removed runs) of each text, once the bytes that come with a mark are found in it."""
    for x, spans in zip(texts, marks, strict=True):
        x, rest, end, runs = x or b"", [], -1, 0
        for s in sorted(spans or [], key=lambda s: (s["lo"], s["hi"])):
            lo, hi, proof = s["lo"], s["hi"], s["proof"]
            if proof is not None and x[lo:hi] != proof:
                raise RuntimeError("two strings of one hash differ: nothing was removed")
            if lo > end:  # ranges that touch are one run
                rest.append(x[max(end, 0) : lo])
                runs += 1
            end = max(end, hi)
        rest.append(x[max(end, 0) :])
        kept = b"".join(rest)
        yield kept, len(x) - len(kept), runs


def spans_of(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """rk, marks array<struct<lo, hi, proof>>: byte ranges to remove of rows with any; docs (rk, text)."""
    rows = docs.select("rk", "text").where(F.octet_length("text") >= length).mapInArrow(all_cells(length), "rk long, p long, n long, key long, full long")
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    near = cut(rows.join(shared, "key"))
    classes = near.groupBy("key", "full").agg(F.count("*").alias("c"), F.min(F.struct("rk", "p", "n")).alias("r"))
    classes = cut(classes.select("key", "full", "c", "r.*"))
    several = cut(classes.groupBy("key").agg(F.count("*").alias("d")).where("d > 1"))
    # Texts that a class begins in: its contexts and the bytes of claims come from them.
    sources = cut(docs.select("rk", "text").join(classes.select("rk").distinct(), "rk", "left_semi").dropDuplicates(["rk"]))
    wanted = classes.join(several, "key").groupBy("rk").agg(F.collect_list(F.struct("key", "full", "c", "d", "p", "n")).alias("rows"))
    context = cut(sources.join(wanted, "rk").select("rk", "text", "rows").mapInArrow(contexts(length), CONTEXT))

    # Marks of a class's windows lo to hi: proven, or equal to those from place p0 of text rk0.
    none = F.lit(None).cast("long")
    whole = classes.where("c > 1").select("key", "full", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), F.col("rk").alias("rk0"), F.col("p").alias("p0"))
    some = context.where(F.col("d") <= group).repartition("key").sortWithinPartitions("key").mapInArrow(sorted_marks(length), MARK).withColumns({"rk0": none, "p0": none})
    single = context.where(F.col("d") > group).mapInArrow(window_hashes(length), "key long, full long, c long, rk long, p long, at long, a long, b long")
    again = single.groupBy("a", "b").agg(F.sum("c").alias("k"), F.min(F.struct("rk", (F.col("p") + F.col("at")).alias("q"))).alias("r")).where("k > 1")
    again = cut(again.select("a", "b", F.col("r.rk").alias("rk0"), F.col("r.q").alias("q")))
    hot = single.where("c = 1").join(again, ["a", "b"]).groupBy("key", "full", "rk0", (F.col("q") - F.col("at")).alias("p0")).agg(F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))).alias("spans"))
    hot = hot.mapInArrow(merged_runs("key", "full", "rk0", "p0"), "key long, full long, rk0 long, p0 long, lo long, hi long")
    marks = whole.unionByName(some).unionByName(hot)
    at = {"lo": F.col("p") + F.col("lo"), "hi": F.col("p") + F.col("hi") - 1 + length, "shift": F.col("p0") - F.col("p")}
    placed = cut(near.join(marks, ["key", "full"]).select("rk", "rk0", *(c.alias(n) for n, c in at.items())))

    claim = F.col("rk0").isNotNull() & ~((F.col("rk") == F.col("rk0")) & (F.col("shift") == 0))
    runs = placed.where(claim).groupBy("rk", "rk0", "shift").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    runs = runs.mapInArrow(merged_runs("rk", "rk0", "shift"), "rk long, rk0 long, shift long, lo long, hi long")
    first = sources.select(F.col("rk").alias("rk0"), F.col("text").cast("binary").alias("data"))
    claims = runs.join(first, "rk0").select("rk", "lo", "hi", F.substring("data", (F.col("lo") + F.col("shift") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("proof"))
    proven = placed.where(~claim).select("rk", "lo", "hi", F.lit(None).cast("binary").alias("proof")).distinct()
    return claims.unionByName(proven).groupBy("rk").agg(F.collect_list(F.struct("lo", "hi", "proof")).alias("marks"))


def digests(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                got = [(len(x or b""), n, k, hashlib.sha256(kept).hexdigest()) for x, (kept, n, k) in zip(texts, removed(texts, rows.column("marks").to_pylist()), strict=True)]
                columns = [pa.array([g[k] for g in got], pa.int64() if k < 3 else pa.string()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = docs.select("doc_id", "text", row_key().alias("rk"))
    return keyed.join(spans_of(keyed, length, group), "rk", "left").select("doc_id", "text", "marks").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
