"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source blocks. The driver draws how many rows of each block go to each shard: one
multivariate hypergeometric draw a block from what the shards have left, so that the counts of
a shard differ by one at most and the matrix is distributed as in a uniform shuffle. Each block
ranks its rows by a seeded hash and cuts them at the running counts; rows are exchanged by
shard and ranked again by a second hash, in parts of a shard, so that no task holds a shard.

The law is `rows`. Null texts have size 8 and the checksum of no bytes. Repeated rows and null
ids are rows like others; which of two equal rows gets which slot has no meaning. An empty table
gives an empty result. Row places are fixed by a checkpoint, so lost executors change nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import cut

#: Source blocks at most; bounds the matrix at BLOCKS x shards whatever the number of input splits.
BLOCKS = 4096
#: Parts that a shard is ranked in.
PARTS = 64


def communication(counts: dict[int, int], shards: int, seed: int) -> dict[int, np.ndarray]:
    """How many rows of each block go to each shard."""
    total = sum(counts.values())
    left = np.array([total // shards + (k < total % shards) for k in range(shards)])
    rng, out = np.random.default_rng(seed), {}
    for block in sorted(counts):
        drawn = rng.multivariate_hypergeometric(left, counts[block], method="marginals")
        out[block], left = drawn, left - drawn
    return out


def shard(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text)."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("at")))
    block = F.pmod(F.shiftright("at", 33), F.lit(BLOCKS))
    rows = rows.withColumn("block", block)
    # BLOCKS small rows at most.
    counts = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    ends = [(b, [int(x) for x in np.cumsum(c)]) for b, c in communication(counts, shards, seed).items()]
    matrix = F.broadcast(spark.createDataFrame(ends, "block long, ends array<long>"))
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "at"), "at")
    dealt = rows.join(matrix, "block").withColumn("rank", F.row_number().over(local)).withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", F.xxhash64(F.lit(seed + 1), "at").alias("order"), "at")
    dealt = dealt.withColumn("part", F.pmod(F.col("order"), F.lit(PARTS)).cast("int"))
    # shards x PARTS small rows at most.
    sizes = {(r["shard"], r["part"]): r["n"] for r in dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for s in range(shards):
        before = 0
        for p in range(PARTS):
            starts.append((s, p, before))
            before += sizes.get((s, p), 0)
    first = F.broadcast(spark.createDataFrame(starts, "shard int, part int, before long"))
    within = Window.partitionBy("shard", "part").orderBy("order", "at")
    out = dealt.join(first, ["shard", "part"]).withColumn("slot", F.col("before") + F.row_number().over(within) - 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
