"""Near-duplicate groups by MinHash and an inverted join on signature coordinates.

A document's set holds its distinct n-word shingles. Each set of shingles is one class, named by
128 bits of two independent hashes of the set, so that copies never meet in a join. Classes post (coordinate, value) keys; keys that only
one class holds are dropped. Two linked classes agree in at least `matches` of the coordinates
but for a chance of MISS at the threshold itself, so they share one of the rarest
`coordinates - matches + 1` keys of each (the prefix); only those are joined.
Each key's group has a pivot, the member with the fewest coordinates of its own. Each class is
first held against the greatest of its pivots, then against those of other components than its
own, so that a family of copies costs about one link a member. Links unite components; then only
classes of other components than the largest of their group meet the rest of it, each pair under the
least key it shares. For these, shingles that no other such class holds bound what a pair can share.
That join runs in rounds over growing shares of the pairs, to all of them at last: links of one round
unite components before the next, so that a family of many links gives a few of them a member, not their
square. Pairs of components that stay apart are all held against each other.

A class also carries the parities of its shingles by hash bucket. Two sets whose parities differ
in d buckets differ in d shingles at least, which leaves out the many half-similar pairs of a
family of edited copies and never a linked pair. Bounds, parities and signatures are compared
within the join, full sets of words after it.

Null or wordless texts have no shingles and link with nothing. Repeated rows are copies.
A null doc_id never names a component unless all of the component's ids are null; such a row is not kept
if another row of its component has an id. An empty table gives an empty result. Long texts are read
whole, a slice of texts at a time. Of classes that tie for a pivot or a hub the greatest or least
hash is taken; which one it is changes the work, never the links. Further columns of docs, whatever
their names, come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import BLANKS, U64, Words, chunks, components, cut, mix, packed, wide_row_key, window_hash, words_of

MISS = 1e-6
#: 64-bit words of shingle parities a class carries.
PARITY_WORDS = 8
#: Classes of a group whose pairs are all tried at once, and how much the share of pairs grows from round to round.
GROUP, GROWTH = 128, 32


def least_matches(coordinates: int, percent: int) -> int:
    """The largest match threshold that a pair at the similarity falls short of with chance MISS at most."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > MISS:
            return max(1, t)
    return coordinates


def shingles(w: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every shingle, from hashes of the words."""
    h = window_hash(hashes, n)
    inside = w.doc[: len(h)] == w.doc[n - 1 : n - 1 + len(h)]
    out, docs = [h[inside]], [w.doc[: len(h)][inside]]
    counts = np.diff(w.first)
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        part = hashes[w.first[i] : w.first[i + 1]]
        out.append(window_hash(part, len(part)))
        docs.append(np.array([i]))
    return np.concatenate(out), np.concatenate(docs)


def distinct(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles to take, in order of text and hash, and where each text's begin."""
    order = np.lexsort((hashes, docs))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (docs[order[1:]] != docs[order[:-1]])
    order = order[new]
    return order, np.searchsorted(docs[order], np.arange(n_docs + 1))


def shingle_sets(texts: list[bytes | None], n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and where each text's begin."""
    w = words_of(texts, BLANKS)
    h, docs = shingles(w, w.second() if second else w.hash, n)
    take, first = distinct(h, docs, len(texts))
    return h[take], first


def wide(x: np.ndarray) -> pa.Array:
    """Rows of two numbers as 16 bytes each."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def sketches(n: int, coordinates: int):
    seeds = mix(np.arange(1, coordinates + 1, dtype=U64) * U64(0xA0761D6478BD642F))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                w = words_of(texts, BLANKS)
                hashes, of = shingles(w, w.hash, n)
                take, first = distinct(hashes, of, len(texts))
                hashes, others = hashes[take], shingles(w, w.second(), n)[0][take]
                size = np.diff(first)
                full = np.flatnonzero(size)
                sig = np.zeros((len(texts), coordinates), np.int32)
                vid = np.zeros((len(texts), 2), U64)
                buckets = 64 * PARITY_WORDS
                bucket = np.repeat(np.arange(len(texts)), size) * buckets + (mix(hashes) % U64(buckets)).astype(np.int64)
                odd = np.packbits(np.bincount(bucket, minlength=len(texts) * buckets).astype(np.uint8) & 1).view(np.int64)
                if len(full):
                    at = first[full]
                    for k, h in enumerate((hashes, others)):
                        vid[full, k] = mix(np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), at) + size[full].astype(U64))
                    for k, seed in enumerate(seeds):
                        sig[full, k] = (np.minimum.reduceat((hashes ^ seed) * U64(0xD6E8FEB86659FD93) ^ (hashes >> U64(29)) * seed, at) >> U64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("rk"), pa.array(size.astype(np.int64)), wide(vid), pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, coordinates, dtype=np.int32)), pa.array(sig.ravel())), pa.ListArray.from_arrays(pa.array(np.arange(0, len(odd) + 1, PARITY_WORDS, dtype=np.int32)), pa.array(odd))],
                    names=["doc_id", "rk", "n_shingles", "vid", "sig", "odd"],
                )

    return run


def exploded(n: int):
    """A row for each distinct shingle of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                h, first = shingle_sets(texts, n)
                of = pa.array(np.repeat(np.arange(len(texts)), np.diff(first)))
                yield pa.RecordBatch.from_arrays([rows.column("vid").take(of), pa.array(h.view(np.int64))], names=["vid", "h"])

    return run


def first_share(largest: int) -> int:
    """One in how many pairs to try, so that a class of the largest group has GROUP partners or fewer."""
    out = 1
    while largest > GROUP * out:
        out *= GROWTH
    return out


def similar(n: int, percent: int):
    """Confirm pairs on the full sets of both texts, by other hashes than those that made them meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, left in chunks(batch, "left"):
                right = rows.column("right").cast(pa.large_binary()).to_pylist()
                h, first = shingle_sets([x for pair in zip(left, right, strict=True) for x in pair], n, second=True)
                keep = []
                for i in range(len(left)):
                    a, b, c = first[2 * i : 2 * i + 3]
                    both = np.isin(h[a:b], h[b:c], assume_unique=True).sum()
                    keep.append(bool(100 * both >= percent * (c - a - both)))
                yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 32) -> DataFrame:
    """Rows (doc_id, rk, n_shingles, component_id, group, kept), one for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text", wide_row_key().alias("rk"))
    sketch = cut(docs.mapInArrow(sketches(shingle, coordinates), "doc_id long, rk binary, n_shingles long, vid binary, sig array<int>, odd array<long>"))
    classes = cut(sketch.where("n_shingles > 0").groupBy("vid").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd")))
    least = least_matches(coordinates, percent)

    posted = classes.select("vid", F.posexplode("sig").alias("k", "v")).select("vid", (F.col("k").cast("long") * F.lit(1 << 32) + F.col("v")).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    rare = posted.join(shared, "key").groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys")).where(F.size("keys") >= least)
    prefix = rare.select("vid", F.size("keys").alias("common"), F.explode(F.slice("keys", 1, F.size("keys") - (least - 1))).alias("p"))
    prefix = cut(prefix.select("vid", "common", F.col("p.key").alias("key")))
    groups = prefix.groupBy("key").agg(F.max(F.struct("common", "vid"))["vid"].alias("pivot"), F.count("*").alias("k")).where("k > 1").select("key", "pivot")

    # Bits of each coordinate, eight coordinates in a number, one a byte with a zero bit above: as many agree as in full, or more.
    low = lambda i: F.shiftleft(F.col("sig")[i].bitwiseAND(0x3F if i % 8 == 7 else 0x7F).cast("long"), 8 * (i % 8))
    lanes = [sum((low(i) for i in range(at + 1, min(at + 8, coordinates))), low(at)).alias(f"s{at // 8}") for at in range(0, coordinates, 8)]
    sigs = classes.select("vid", "n", *lanes, *(F.col("odd")[i].alias(f"o{i}") for i in range(PARITY_WORDS)))
    side = lambda x: sigs.select(*(F.col(c).alias(f"{c}_{x}") for c in sigs.columns))
    xor = lambda c: F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
    unequal = sum((F.bit_count((xor(f"s{i}") + F.lit(0x3F7F7F7F7F7F7F7F)).bitwiseAND(0x4080808080808080)) for i in range(len(lanes))), F.lit(0))
    in_size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    differ = sum((F.bit_count(xor(f"o{i}")) for i in range(PARITY_WORDS)), F.lit(0))
    alike = (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)) & (unequal <= coordinates - least)

    def texts_of(ids: DataFrame) -> DataFrame:
        rows = ids.join(classes.select("vid", "rk"), "vid")
        return cut(docs.select("rk", "text").join(rows, "rk").dropDuplicates(["rk"]).select("vid", "text"))

    def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("vid").alias(x), F.col("text").alias(y)) for x, y in (("a", "left"), ("b", "right")))
        return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(similar(shingle, percent), "a binary, b binary"))

    def linked(stars: DataFrame) -> DataFrame:
        stars = stars.join(side("a"), F.col("a") == F.col("vid_a")).join(side("b"), (F.col("b") == F.col("vid_b")) & in_size & alike)
        stars = cut(stars.select("a", "b"))
        return confirmed(stars, texts_of(stars.select(F.explode(F.array("a", "b")).alias("vid")).distinct()))

    pivots = cut(prefix.join(groups, "key").where("vid <> pivot").select(F.col("vid").alias("a"), F.col("pivot").alias("b")).distinct())
    near = linked(pivots.groupBy("a").agg(F.max("b").alias("b")))
    comps = components(near)
    of = lambda x: comps.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}"))
    apart = pivots.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
    united = lambda more: components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more))
    comps = united(linked(apart.select("a", "b")))

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of groups (key, vid) of several components, with their component, the group's largest and its size."""
        placed = cut(rows.join(comps, rows["vid"] == comps["id"], "left").select(*rows.columns, F.coalesce("comp", "vid").alias("comp")))
        parts = placed.groupBy("key", "comp").agg(F.count("*").alias("k"))
        several = parts.groupBy("key").agg(F.max(F.struct("k", "comp"))["comp"].alias("home"), F.sum("k").alias("k"), F.count("*").alias("comps")).where("comps > 1")
        return placed.join(several.drop("comps"), "key")

    # Pairs with the pivot are settled.
    members = cut(mixed(prefix.join(groups, "key")).where("vid <> pivot").select("key", "vid"))
    texts = texts_of(members.select("vid").distinct())
    single = texts.mapInArrow(exploded(shingle), "vid binary, h long").groupBy("h").agg(F.count("*").alias("k"), F.min("vid").alias("vid")).where("k = 1")
    own = single.groupBy("vid").agg(F.count("*").alias("own")).withColumnRenamed("vid", "of")
    able = sigs.join(own, sigs["vid"] == own["of"], "left").select(*sigs.columns, (F.col("n") - F.coalesce("own", F.lit(0))).alias("most")).where(100 * F.col("most") >= percent * F.col("n"))
    # A pair that shares several keys meets under the least of them only; while its components differ, no round leaves any of them out.
    keys = members.groupBy("vid").agg(F.collect_list("key").alias("keys"))
    able = cut(able.join(keys, "vid"))
    members = cut(members.join(able.select("vid"), "vid"))
    columns = ("comp", *able.columns)
    once = (F.col("comp_b") == F.col("home")) | (F.col("vid_a") < F.col("vid_b"))
    both = F.least("most_a", "most_b")
    possible = 100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)
    share = None
    while share != 1:
        now = cut(mixed(members))
        largest = now.agg(F.max("k")).first()[0]
        if largest is None:
            break
        share = min(share // GROWTH if share else first_share(largest), first_share(largest))
        slot = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.lit(share), "vid"), F.lit(share)).alias("slot")  # noqa: E731, B023
        full = now.join(able, "vid")
        left = full.where("comp <> home").select("key", slot(1), *(F.col(c).alias(f"{c}_a") for c in columns))
        right = full.select("key", slot(2), "home", *(F.col(c).alias(f"{c}_b") for c in columns))
        meet = (left["key"] == right["key"]) & (left["slot"] == right["slot"]) & (F.col("comp_a") != F.col("comp_b")) & once & in_size & possible & alike
        across = left.join(right, meet & (F.array_min(F.array_intersect("keys_a", "keys_b")) == left["key"]))
        more = confirmed(cut(across.select(F.col("vid_a").alias("a"), F.col("vid_b").alias("b"))), texts)
        if more.limit(1).count():
            comps = united(more)

    found = classes.join(comps, classes["vid"] == comps["id"], "left").select("vid", "least", F.coalesce("comp", "vid").alias("comp"))
    names = found.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = found.join(names, "comp").select("vid", "comp", "component_id")
    out = sketch.join(found, (sketch["vid"] == found["vid"]) & (F.col("n_shingles") > 0), "left")
    out = out.select("doc_id", "rk", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("comp").alias("group"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without all but one row of each near-duplicate group; rows without words all stay.

    The row that stays is the first by id (null ids last), then by content, even where rows repeat.
    """
    found = near_duplicates(docs, shingle, percent)
    best = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk"))["rk"].alias("best"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = packed(docs, wide_row_key().alias("rk"), blank.alias("blank"))
    one = keyed.where("NOT blank").join(best, F.col("rk") == F.col("best"), "left_semi").dropDuplicates(["rk"])
    return one.unionByName(keyed.where("blank")).select("row.*")
