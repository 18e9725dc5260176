"""Novelty and edit distance.

The decision joins (is any text within k - 1 edits?) meet in an equi-join on rare pieces of the texts, and pairs
are verified by `levenshtein`. Exact copies are collapsed first, so no copies pair up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import edit, grams
from gridspark.functions.grid import canonical, orbit
from gridspark.operators.rounds import cut

#: Characters of the query texts of one block of an exhaustive search; bounds what is broadcast.
BLOCK_BYTES = 16_000_000
#: One in so many texts of a corpus goes first where there are more pairs than this, for limits.
FIRST_SHARE, FIRST_PAIRS = 8, 100_000_000
#: Pairs that one key makes in one part, and bits of the map of posted pieces, by their number within these.
KEY_PAIRS = 100_000
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 27


def novel(samples: DataFrame, corpus: DataFrame) -> DataFrame:
    """JOIN-1: samples with `novel`: no image of the text is in the corpus; null for a text without a canonical form."""
    known = corpus.select(F.col("canonical").alias("_known")).where("_known IS NOT NULL").distinct()
    rows = samples.withColumn("_form", canonical(F.col("text")))
    out = rows.join(known, F.col("_form") == F.col("_known"), "left")
    return out.withColumn("novel", F.when(F.col("_form").isNotNull(), F.col("_known").isNull())).drop("_form", "_known")


def walls(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "#", ""))


def bit_map(keys: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of `key` modulo bits, as bytes; a row of 4 KB for each 32,768 bits comes to the driver."""
    bit = F.pmod("key", F.lit(bits)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bytes")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r["bytes"], np.uint8)
        out[(r["at"] - 1) * len(part) : r["at"] * len(part)] = part
    return out


def met_pairs(left: DataFrame, right: DataFrame, k: int, ordered: bool = False) -> DataFrame:
    """(ta, tb) of all texts of left (ta) and right (tb) that share a piece near its place, repeats included; no other pair is under k edits apart.

    Texts of the left post the k disjoint pieces that are rarest on the right (see functions.grams), those on the right what the left
    has posted, as far as a bit map of bounded size can tell. A key that would make more than KEY_PAIRS pairs
    is split: its longer side is dealt over parts, its shorter side repeated in each.
    """
    context = left.sparkSession.sparkContext
    left, right = left.select("ta"), right.select("tb")
    table = np.zeros(grams.BUCKETS, np.int64)
    for r in right.mapInArrow(grams.counts(k), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        table[r["bucket"]] = r["n"]
    mine = cut(left.mapInArrow(grams.chosen(context.broadcast(table), k), "key long, at int, text string"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * mine.count()).bit_length()))
    theirs = cut(right.mapInArrow(grams.met(context.broadcast(bit_map(mine, bits)), bits, k), "key long, at int, text string"))

    sizes = mine.groupBy("key").agg(F.count("*").alias("na")).join(theirs.groupBy("key").agg(F.count("*").alias("nb")), "key")
    heavy = sizes.select("key", F.ceil(F.col("na") * F.col("nb") / KEY_PAIRS).cast("int").alias("parts"), (F.col("na") >= F.col("nb")).alias("deal_a")).where("parts > 1")
    heavy = cut(heavy)

    def split(rows: DataFrame, dealt: Column) -> DataFrame:
        one = F.array(F.lit(0))
        part = F.when(F.col("parts").isNull(), one).when(dealt, F.array(F.pmod(F.xxhash64("text", "at"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        return rows.join(heavy, "key", "left").select("key", "at", "text", F.explode(part).alias("part"))

    x = split(mine, F.col("deal_a")).select("key", "part", F.col("at").alias("at_a"), F.col("text").alias("ta"), F.length("text").alias("na"), walls(F.col("text")).alias("wa"))
    y = split(theirs, ~F.col("deal_a")).select("key", "part", F.col("at").alias("at_b"), F.col("text").alias("tb"), F.length("text").alias("nb"), walls(F.col("text")).alias("wb"))
    near = (F.abs(F.col("at_a") - F.col("at_b")) < k) & (F.abs(F.col("na") - F.col("nb")) < k) & (F.abs(F.col("wa") - F.col("wb")) < k)
    pairs = x.join(y, (x["key"] == y["key"]) & (x["part"] == y["part"]) & near & (F.col("ta") < F.col("tb") if ordered else F.lit(True)))
    return pairs.select("ta", "tb")


def near_pairs(left: DataFrame, right: DataFrame, k: int, ordered: bool = False) -> DataFrame:
    """Distinct (ta, tb, distance) of texts under k edits apart; left (ta), right (tb), both distinct."""
    pairs = met_pairs(cut(left), cut(right), k, ordered).distinct()
    return pairs.withColumn("distance", F.levenshtein("ta", "tb", k - 1)).where("distance >= 0")


def novel_k(samples: DataFrame, corpus: DataFrame, k: int = 5, symmetric: bool = False) -> DataFrame:
    """JOIN-4: `novel_k`: no corpus text (or image of the sample) is under k edits away; a null text is not novel."""
    texts = samples.select("text").where("text IS NOT NULL").distinct()
    images = texts.select(F.col("text").alias("_near"), F.explode(orbit(F.col("text")) if symmetric else F.array("text")).alias("image"))
    known = corpus.select(F.col("text").alias("tb")).where("tb IS NOT NULL").distinct()
    close = near_pairs(images.select(F.col("image").alias("ta")).distinct(), known, k).select("ta").distinct()
    hits = images.join(close, F.col("image") == F.col("ta"), "left_semi").select("_near").distinct()
    out = samples.join(hits, F.col("text") == F.col("_near"), "left")
    return out.withColumn("novel_k", F.col("text").isNotNull() & F.col("_near").isNull()).drop("_near")


def close_pairs(samples: DataFrame, k: int = 5) -> DataFrame:
    """JOIN-5 by text: pairs of distinct texts under k edits apart (a < b); close_links has the samples."""
    texts = samples.select("text").where("text IS NOT NULL").distinct()
    left, right = texts.withColumnRenamed("text", "ta"), texts.withColumnRenamed("text", "tb")
    return near_pairs(left, right, k, ordered=True).toDF("a", "b", "distance")


def close_links(samples: DataFrame, k: int = 5) -> DataFrame:
    """JOIN-5 by sample: class_id (least sample_id of the text) and links, the other samples under k edits away, copies among them.

    Links are counted by class, copies are never paired; a null text has neither.
    """
    classes = samples.where("text IS NOT NULL").groupBy("text").agg(F.min("sample_id").alias("class_id"), F.count("*").alias("copies"))
    pairs = close_pairs(samples, k)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("text"), F.col("b").alias("other")), F.struct(F.col("b").alias("text"), F.col("a").alias("other")))).alias("e")).select("e.*")
    near = both.join(classes.select(F.col("text").alias("other"), "copies"), "other").groupBy("text").agg(F.sum("copies").alias("near"))
    links = classes.join(near, "text", "left").select(F.col("text").alias("_text"), "class_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return samples.join(links, F.col("text") == F.col("_text"), "left").select("sample_id", "class_id", "links")


def nearest_texts(asked: DataFrame, corpus: DataFrame, cap: int) -> DataFrame:
    """(q, d) for texts in asked (q, group, own), all distinct: the least edit distance to any text of corpus (text), absent or cap + 1 beyond the cap.

    A text that is not `own` need not have its own distance, only its group has to have its least. A stated query set
    against all rows: blocks of queries of bounded size, groups kept whole, are broadcast in turn, and the corpus stays where
    it is. Each task meets its texts with a block (see functions.edit), its least so far as limits; what it finds goes to
    a small shuffle. Of many pairs, a share of the corpus goes first, and what all tasks have found there is the limit
    of the rest. A cap whose band exceeds a machine word takes the built-in distance, pair by pair.
    """
    spark = asked.sparkSession
    known = corpus.select(F.col("text").alias("c")).where("c IS NOT NULL").distinct()
    # Few bytes, much work: as many parts as the cluster has room for, whatever their size.
    known = cut(known.repartition(2 * spark.sparkContext.defaultParallelism, "c"))
    asked = cut(asked)
    size, queries = asked.agg(F.sum(F.length("q") + 64), F.count("*")).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    early = F.pmod(F.xxhash64("c"), F.lit(FIRST_SHARE)) == 0
    shares = [early, ~early] if cap <= edit.WIDEST and queries * known.count() > FIRST_PAIRS else [F.lit(True)]
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("group"), F.lit(blocks)) == b)
        if cap > edit.WIDEST:
            d = F.levenshtein("q", "c", cap)
            best = known.join(F.broadcast(part)).select("q", F.when(d >= 0, d).otherwise(cap + 1).alias("d"))
            found = best if found is None else found.unionByName(best)
            continue
        rows, number, start = part.collect(), {}, {}
        group = np.array([number.setdefault(r["group"], len(number)) for r in rows], np.int64)
        texts, own = [r["q"] for r in rows], np.array([r["own"] for r in rows], bool)
        for share in shares:
            least = np.array([start.get(q, cap + 1) for q in texts], np.int64)
            best = known.where(share).mapInArrow(least_edits(spark.sparkContext.broadcast((texts, group, own, least)), cap), "q string, d int")
            if share is not shares[-1]:
                best = cut(best.groupBy("q").agg(F.min("d").alias("d")))
                start = dict(map(tuple, best.collect()))
            found = best if found is None else found.unionByName(best)
    return found.groupBy("q").agg(F.min("d").alias("d"))


def least_edits(queries, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, group, own, start = queries.value
        best = edit.nearest((b.column("c").to_pylist() for b in batches), texts, cap, "#", group, own, start)
        at = np.flatnonzero(best < start)
        yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in at], pa.string()), pa.array(best[at].astype("int32"))], names=["q", "d"])

    return run


def with_nearest(samples: DataFrame, corpus: DataFrame, cap: int, plain: str | None, symmetric: str | None) -> DataFrame:
    """samples with the least distance of the text as column `plain` and of its images as column `symmetric`, in one search.

    Null beyond null texts only where a text has no images, and cap + 1 beyond the cap.
    """
    texts = samples.select("text").where("text IS NOT NULL").distinct()
    own = texts.select("text", F.col("text").alias("q"))
    images = texts.select("text", F.explode(orbit(F.col("text"))).alias("q"), F.lit(True).alias("image")) if symmetric else own.withColumn("image", F.lit(False))
    pairs = cut((images.unionByName(own.withColumn("image", F.lit(False))) if plain and symmetric else images).distinct())
    # The images of a text are those of each of its images, so of all but the texts themselves only the least counts.
    asked = pairs.groupBy("q").agg(F.min("image").alias("_image")).select("q", (F.coalesce(canonical(F.col("q")), F.col("q")) if symmetric else F.col("q")).alias("group"), (~F.col("_image")).alias("own"))
    found = pairs.join(nearest_texts(asked, corpus, cap), "q", "left").withColumn("d", F.coalesce("d", F.lit(cap + 1)))
    of = lambda image, name: F.min(F.when(F.col("image") == image, F.col("d"))).alias(name)
    least = found.groupBy(F.col("text").alias("_text")).agg(*([of(False, plain)] if plain else []), *([of(True, symmetric)] if symmetric else []))
    return samples.join(least, F.col("text") == F.col("_text"), "left").drop("_text")


def nearest_edit(samples: DataFrame, corpus: DataFrame, cap: int = 20, symmetric: bool = False) -> DataFrame:
    """JOIN-2, JOIN-3: the least edit distance of each sample, or of its images, to any corpus text as column `nearest`."""
    return with_nearest(samples, corpus, cap, *((None, "nearest") if symmetric else ("nearest", None)))
