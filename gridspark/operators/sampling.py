"""Samples and training sequences. All draws are hashes of a seed and the row's id, so every run gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions.grid import orbit
from gridspark.functions.tokens import encode, pick, uniform

#: Rows of a part, about; parts grow in number with the rows.
PART_ROWS, LEAST_PARTS = 1_000_000, 64
#: Values of half a hash.
HALF = 1 << 16


def ranked(rows: DataFrame, value, *ties: str) -> DataFrame:
    """rows with `rank`, dense from 0 by a value in [0, 1); no task sorts more than a part of the rows."""
    parts = max(LEAST_PARTS, rows.count() // PART_ROWS)
    rows = rows.withColumn("_v", value).withColumn("_part", F.floor(F.col("_v") * parts).cast("int"))
    sums = rows.groupBy("_part").agg(F.count("*").alias("m"))
    # One row a part: a millionth of the rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    below = sums.select("_part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_below"))
    order = Window.partitionBy("_part").orderBy("_v", *ties)
    return rows.join(F.broadcast(below), "_part").withColumn("rank", F.col("_below") + F.row_number().over(order) - 1).drop("_v", "_part", "_below")


def fraction(rows: DataFrame, share: float, seed: str, key: str = "id") -> DataFrame:
    """SMP-1: exactly int(n * share) rows without replacement; samples of larger shares hold those of smaller ones.

    The rows of least hash are found without sorting: counts by the upper half of the hash give the half that the
    threshold lies in, counts by the lower half within it the threshold. Only rows at the threshold itself are ordered, by key.
    """
    hashed = rows.withColumn("_h", F.floor(uniform(seed, F.col(key)) * float(HALF * HALF)))
    upper, lower = F.floor(F.col("_h") / HALF), F.col("_h") % HALF
    found = reached(hashed, upper, int(rows.count() * share))
    if found is None:
        return rows
    digit, left = reached(hashed.where(upper == found[0]), lower, found[1])
    edge = found[0] * HALF + digit
    below = hashed.where(F.col("_h") < edge)
    return (below.unionByName(hashed.where(F.col("_h") == edge).orderBy(key).limit(left)) if left else below).drop("_h")


def reached(rows: DataFrame, digit: Column, left: int) -> tuple[int, int] | None:
    """The digit (of HALF values) whose rows, taken in order, hold row number `left`, and what is left of it before them; None if there are too few rows."""
    for value, n in sorted(map(tuple, rows.groupBy(digit).agg(F.count("*")).collect())):
        if n > left:
            return value, left
        left -= n
    return None


def sequences(levels: DataFrame) -> DataFrame:
    """SMP-2: id, bucket, tokens of all levels that encode."""
    return levels.select("id", "bucket", encode(F.col("text"), F.col("bucket")).alias("tokens")).where("tokens IS NOT NULL")


def draws(rows: DataFrame, steps: int, batch: int, seed: str, key: str = "id") -> DataFrame:
    """SMP-5: for each step `batch` rows, uniform with replacement, by an equi-join on a dense index."""
    spark: SparkSession = rows.sparkSession
    indexed = ranked(rows, uniform(f"{seed}:place", F.col(key)), key)
    total = rows.agg(F.count("*").alias("_n"))
    wanted = spark.range(steps * batch).select(F.floor(F.col("id") / batch).cast("int").alias("step"), (F.col("id") % batch).cast("int").alias("slot"))
    wanted = wanted.crossJoin(F.broadcast(total)).withColumn("rank", F.floor(uniform(seed, F.col("step"), F.col("slot")) * F.col("_n"))).drop("_n")
    return wanted.join(indexed, "rank").drop("rank")


def expanded(levels: DataFrame) -> DataFrame:
    """SMP-6: every level as its eight images."""
    return levels.select("id", F.posexplode(orbit(F.col("text"))).alias("k", "text"))


def evaluation_plan(spark: SparkSession, per_bucket: int, unconditional: int, buckets: int = 10) -> DataFrame:
    """SMP-7: targets of the samples to generate, numbered by bucket, then without a target."""
    n = per_bucket * buckets
    return spark.range(n + unconditional).select(F.col("id").alias("sample_id"), F.when(F.col("id") < n, F.floor(F.col("id") / max(1, per_bucket)).cast("int")).alias("target"))


def oversampled(levels: DataFrame, weights: dict[int, float], seed: str) -> DataFrame:
    """SMP-8: each level as often as its bucket's weight, the fraction by hash; buckets without a weight once."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("bucket").cast("int")], F.lit(1.0))
    copies = F.floor(weight).cast("int") + (uniform(seed, F.col("id")) < weight - F.floor(weight)).cast("int")
    return levels.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))


def picked_image(levels: DataFrame, seed: str) -> DataFrame:
    """SMP-3: a random image of each level."""
    return levels.select("id", pick(8, seed, F.col("id")).alias("k"), F.get(orbit(F.col("text")), pick(8, seed, F.col("id"))).alias("text"))
