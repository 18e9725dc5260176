"""Deduplication that grows source by source.

A store holds the first place of every canonical form seen so far. A new source is grouped by itself; of the store
only forms that the new source may have, as far as a bit map of bounded size can tell, are shuffled to meet it.
A source of earlier places than those stored takes their forms over, so the order in which sources come is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.grams import bit_of
from gridspark.operators.dataset import ORDER
from gridspark.operators.neighbours import LEAST_BITS, MOST_BITS, bit_map
from gridspark.operators.rounds import cut
from gridspark.sources.files import read_if_there

#: Bits of the map for each form of a new source, within the bounds of the map.
FORM_BITS = 16


def place() -> Column:
    """Where a level stands in the order of all levels."""
    return F.struct(*ORDER, "id")


def committed(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """A part of the store, of committed sources only; None before the first one."""
    rows, commits = read_if_there(spark, f"{path}/{part}"), read_if_there(spark, f"{path}/commits")
    return None if rows is None or commits is None else rows.join(F.broadcast(commits.select("batch")), "batch", "left_semi").drop("batch")


def add_source(levels: DataFrame, path: str, name: str) -> bool:
    """WIN-1, SET-2: adds a source to the store at `path`; False if a source of this name is there already.

    Ids must be set and stand for one level each. A level without a canonical form stands for itself. Nothing
    counts before the last step, the commit, so a run that was lost is run again. One run at a time writes to
    a store. `levels` is read twice.
    """
    spark, batch = levels.sparkSession, f"batch-{uuid4().hex}"
    commits = read_if_there(spark, f"{path}/commits")
    if commits is not None and not commits.where(F.col("name") == name).isEmpty():
        return False
    form = F.coalesce("canonical", F.concat(F.lit("\0"), "id"))
    own = cut(levels.groupBy(form.alias("form")).agg(F.min(place()).alias("place")).withColumn("key", F.xxhash64("form")))
    known = committed(spark, path, "firsts")
    met = own.select("form", F.col("place").alias("known")).limit(0) if known is None else probable(known, own).groupBy("form").agg(F.min("place").alias("known"))
    firsts = cut(own.join(met, "form", "left").where("known IS NULL OR place < known"))

    # Places are unique, so a form that many levels share is no hot key of this join.
    won = firsts.select(F.col("place").alias("_won"))
    out = levels.join(won, place() == F.col("_won"), "left")
    outcome = F.when(F.col("_won").isNull(), "duplicate").when(F.col("status") != "solved", "unsolved").otherwise("kept")
    write = lambda rows, part: rows.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/{part}")
    write(out.withColumn("outcome", outcome).drop("_won"), "levels")
    write(firsts.select("form", "key", "place"), "firsts")
    write(firsts.where("known IS NOT NULL").select(F.col("known").alias("place")), "displaced")
    spark.range(1).select(F.lit(name).alias("name"), F.lit(batch).alias("batch")).write.mode("append").parquet(f"{path}/commits")
    return True


def probable(known: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of `known` (form, key, place) whose key may be in `own`; a full map lets all through."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (FORM_BITS * own.count()).bit_length()))
    seen = known.sparkSession.sparkContext.broadcast(bit_map(own.select("key"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = bit_of(batch.column("key").to_numpy(), bits)
            yield batch.filter(pa.array(((seen.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)))

    rows = known.select("form", "key", "place")
    return rows.mapInArrow(run, rows.schema)


def outcomes(spark: SparkSession, path: str) -> DataFrame | None:
    """WIN-1 of all levels in the store, as deduplicated() gives of all sources at once; firsts that a later source has displaced are duplicates."""
    rows, displaced = committed(spark, path, "levels"), committed(spark, path, "displaced")
    if rows is None or displaced is None:
        return rows
    gone = displaced.select(F.col("place").alias("_gone"))
    out = rows.join(gone, place() == F.col("_gone"), "left")
    return out.withColumn("outcome", F.when(F.col("_gone").isNotNull(), "duplicate").otherwise(F.col("outcome"))).drop("_gone")


def forms(spark: SparkSession, path: str) -> DataFrame | None:
    """SET-2: canonical forms of the store, each with the id of its first level."""
    firsts = committed(spark, path, "firsts")
    if firsts is None:
        return None
    return firsts.where(~F.startswith("form", F.lit("\0"))).groupBy(F.col("form").alias("canonical")).agg(F.min("place")["id"].alias("first_id"))
