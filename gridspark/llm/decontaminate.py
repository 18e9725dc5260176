"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

A window is WINDOW neighbouring words of an item, or all words of a shorter item. Words are ranked
by how rare they are in all documents. A window's prefix is its rarest word, the first of equally
rare ones: a document holds the window only if it holds that word, at the window's offset of it.
So document words are looked up among the prefix words alone; bounds on place and length come
next, then a hash of the whole window, then its words themselves.

Where the benchmark has INDEX_BYTES of text at most, which is checked, its index is broadcast and
documents are read in place. A larger one goes the same way by shuffles: words are ranked in a
table, the windows' prefix words are posted with their windows, document words that may be prefix
words (by a bit map of fixed size) are posted with their neighbours, both meet by the word, and
bounds and words are compared in the join.

Null or wordless texts have no words and no hits; such items have no windows. Items with equal
texts or repeated ids: an item_id counts once. Null item_ids are left out. The sha256 of a clean
document is that of no bytes. Repeated documents are judged row by row; long ones are read whole, a
slice of texts at a time. Empty tables give an empty result, or clean documents. Further columns
of docs, whatever their names, come back as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import NOT_ALNUM, U64, chunks, cut, packed, powers, words_of

WINDOW, INDEX_BYTES = 10, 4_000_000
#: Bits of the map of prefix words (2 MB), whatever their number.
MAP_BITS = 1 << 24
_STEP = U64(0xD6E8FEB86659FD93)
_BACK = U64(pow(int(_STEP), -1, 1 << 64))


def rolling(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over words, and the factors that make a span's hash free of its place."""
    out = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(_STEP, len(hashes)), out=out[1:], dtype=U64)
    return out, powers(_BACK, len(hashes) + 1)


def windows(texts: list[bytes | None]) -> tuple[object, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of items: the words, then item, first word and length of each."""
    w = words_of(texts, NOT_ALNUM)
    item, start, size = [], [], []
    for i in range(len(texts)):
        n = w.first[i + 1] - w.first[i]
        length = min(n, WINDOW)
        for k in range(n - length + 1 if n else 0):
            item.append(i)
            start.append(w.first[i] + k)
            size.append(length)
    return w, np.array(item, np.int64), np.array(start, np.int64), np.array(size, np.int64)


class Index:
    """Windows by the hash of their rarest word."""

    def __init__(self, items: list[tuple[str, str]], frequency: dict[int, int]):
        self.names = [x for x, _ in items]
        w, item, start, size = windows([t.encode() for _, t in items])
        prefix, back = rolling(w.hash)
        rank = np.array([frequency.get(int(h), 0) for h in w.hash], np.int64)
        offset = np.array([int(np.argmin(rank[s : s + n])) for s, n in zip(start, size, strict=True)], np.int64)
        key = w.hash[start + offset] if len(start) else np.zeros(0, U64)
        by = np.lexsort((size, offset, key))
        self.key, self.offset, self.size, self.item = key[by], offset[by], size[by], item[by]
        self.hash = ((prefix[start + size] - prefix[start]) * back[start])[by]
        self.words = [[w.word(k) for k in range(start[j], start[j] + size[j])] for j in by]
        self.keys, self.at = np.unique(self.key, return_index=True)
        self.count = np.diff(np.append(self.at, len(self.key)))

    def hits(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, item) of every place where a window stands."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.keys) or not len(w.hash):
            return none
        k = np.minimum(np.searchsorted(self.keys, w.hash), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[k] == w.hash)
        k = k[place]
        times = self.count[k]
        place = np.repeat(place, times)
        j = np.repeat(self.at[k], times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        start, size = place - self.offset[j], self.size[j]
        # Bounds: the window must lie within the text of its prefix word.
        fit = (start >= w.first[w.doc[place]]) & (start + size <= w.first[w.doc[place] + 1])
        start, size, j = start[fit], size[fit], j[fit]
        prefix, back = rolling(w.hash)
        same = (prefix[start + size] - prefix[start]) * back[start] == self.hash[j]
        start, size, j = start[same], size[same], j[same]
        true = np.array([[w.word(x) for x in range(s, s + n)] == self.words[i] for s, n, i in zip(start, size, j, strict=True)], bool)
        return start[true], size[true], self.item[j[true]]


def digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()


def frequencies(docs: DataFrame, hashes: list[int]) -> dict[int, int]:
    """How often the benchmark's words stand in all documents; one row a benchmark word."""
    known = docs.sparkSession.sparkContext.broadcast(np.array(sorted(hashes), U64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, texts in chunks(batch):
                h = words_of(texts, NOT_ALNUM).hash
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total += np.bincount(at[keys[at] == h], minlength=len(keys))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[used].view(np.int64)), pa.array(total[used])], names=["h", "n"])

    rows = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect() if hashes else []
    return {r["h"] % (1 << 64): r["n"] for r in rows}


def contamination(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text)."""
    found = judged(docs.select("text", F.struct("doc_id").alias("row")), benchmark, index_bytes)
    return found.select("row.doc_id", *(c.split()[0] for c in SCHEMA.split(", ")))


def judged(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs (text, row) without the text, with the columns of SCHEMA."""
    items = items_of(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > index_bytes:
        return joined(docs, items)
    rows = [(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]
    vocabulary = sorted({int(h) for h in words_of([t.encode() for _, t in rows], NOT_ALNUM).hash})
    shared = docs.sparkSession.sparkContext.broadcast(Index(rows, frequencies(docs, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part, texts in chunks(batch):
                w = words_of(texts, NOT_ALNUM)
                start, length, item = index.hits(w)
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                n_hit = covered[w.first[1:]] - covered[w.first[:-1]]
                found: dict[int, set[str]] = {}
                for d, i in set(zip(w.doc[start].tolist(), item.tolist(), strict=True)):
                    found.setdefault(d, set()).add(index.names[i])
                names = [found.get(d, set()) for d in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(np.diff(w.first)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array([digest(x) for x in names], pa.string()), pa.array(n_hit > 0)],
                    names=["row", *(x.split()[0] for x in SCHEMA.split(", "))],
                )

    schema = docs.select("row").schema
    for c in SCHEMA.split(", "):
        schema = schema.add(*c.split())
    return docs.select("text", "row").mapInArrow(run, schema)


def bit_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which bits the hashes h of a task set, as rows of 64 bits each: at most MAP_BITS / 64."""
    bits = np.zeros(MAP_BITS, bool)
    for batch in batches:
        bits[bit_of(batch.column("h").to_numpy())] = True
    words = np.packbits(bits, bitorder="little").view(np.int64)
    used = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], names=["k", "bits"])


def bit_of(h: np.ndarray) -> np.ndarray:
    return (h.view(U64) & U64(MAP_BITS - 1)).astype(np.int64)


def joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: prefix words of windows and words of documents meet in a shuffled join."""
    context = docs.sparkSession.sparkContext

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                w, item, start, size = windows(texts)
                words = [[w.word(k).decode() for k in range(s, s + n)] for s, n in zip(start, size, strict=True)]
                hashes = [w.hash[s : s + n].view(np.int64) for s, n in zip(start, size, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(item)), pa.array(words, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], names=["item_id", "words", "hashes"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch):
                h, n = np.unique(words_of(texts, NOT_ALNUM).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    # Windows once each, with the items that have them.
    found = items.mapInArrow(of_items, "item_id string, words array<string>, hashes array<long>").groupBy("words").agg(F.first("hashes").alias("hashes"), F.collect_set("item_id").alias("items"))
    found = cut(found.withColumn("id", F.xxhash64("words")))
    frequency = docs.select("text").mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    placed = found.select("id", "words", F.posexplode("hashes").alias("offset", "h")).join(frequency, "h", "left")
    rarest = placed.groupBy("id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("r"))
    prefix = cut(rarest.join(found.select("id", "words", "items"), ["id", "words"]).select(F.col("r.h").alias("h"), "r.offset", "words", "items"))
    got = prefix.select("h").distinct().mapInArrow(bit_map, "k long, bits long").groupBy("k").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[got.column("k").to_numpy()] = got.column("bits").to_numpy()
    shared = context.broadcast(bits)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for part, texts in chunks(batch):
                w = words_of(texts, NOT_ALNUM)
                at = np.flatnonzero(known[bit_of(w.hash.view(np.int64))])
                for k in range(0, len(at), 20_000):
                    some = at[k : k + 20_000]
                    lo, hi = np.maximum(some - WINDOW + 1, w.first[w.doc[some]]), np.minimum(some + WINDOW, w.first[w.doc[some] + 1])
                    near = [[w.word(x).decode() for x in range(a, b)] for a, b in zip(lo, hi, strict=True)]
                    columns = [part.column("rk").take(pa.array(w.doc[some])), pa.array(some - w.first[w.doc[some]]), pa.array(some - lo), pa.array(w.hash[some].view(np.int64)), pa.array(near, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["rk", "at", "ahead", "h", "near"])

    keyed = docs.select("row", "text", F.md5("text").alias("rk"))
    # One row a text is enough: equal texts have equal hits.
    texts = keyed.where("text IS NOT NULL").select("rk", "text").dropDuplicates(["rk"])
    places = texts.mapInArrow(of_docs, "rk string, at long, ahead long, h long, near array<string>")
    start, size = F.col("ahead") - F.col("offset"), F.size("words")
    fits = (start >= 0) & (start + size <= F.size("near"))
    hits = places.join(prefix, "h").where(fits & (F.slice("near", F.greatest(start + 1, F.lit(1)).cast("int"), size) == F.col("words")))
    hits = cut(hits.select("rk", (F.col("at") - F.col("offset")).alias("at"), size.alias("size"), "items"))
    named = hits.select("rk", F.explode("items").alias("item")).distinct().groupBy(F.col("rk").alias("rk_n")).agg(F.sort_array(F.collect_list("item")).alias("names"))
    spans = hits.select("rk", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("k")).distinct().groupBy(F.col("rk").alias("rk_s")).agg(F.count("*").alias("hit"))
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = keyed.join(named, F.col("rk") == F.col("rk_n"), "left").join(spans, F.col("rk") == F.col("rk_s"), "left")
    made = (words, zero(F.col("hit")), zero(F.array_size("names")), F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256), zero(F.col("hit")) > 0)
    return out.select("row", *(c.alias(x.split()[0]) for c, x in zip(made, SCHEMA.split(", "), strict=True)))


def clean(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs without a word inside a benchmark window."""
    return judged(packed(docs, F.col("text")), benchmark, index_bytes).where("NOT contaminated").select("row.*")
