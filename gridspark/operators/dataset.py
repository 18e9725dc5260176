"""Dataset build: deduplication over splits, difficulty buckets and the tables that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.grid import bucket_labels, bucket_of
from gridspark.operators.ranks import percentiles, running_sums
from gridspark.operators.rounds import cut

#: Statuses, and the names of outcomes and figures below.
STATUSES = ["solved", "unsolvable", "budget_exceeded", "invalid"]
ORDER = ("split_rank", "source_rank", "file", "index")
BUCKETS = 10


def deduplicated(levels: DataFrame) -> DataFrame:
    """WIN-1: `outcome` of every level: kept, duplicate or unsolved.

    The first of a canonical form in level order is kept if solved; later ones are duplicates whatever
    their status. Firsts come from a grouped minimum with map-side combine, so a form that a third of the
    rows share is no sort in one task. A level without a canonical form stands for itself.
    """
    place = F.struct(*ORDER, "id")
    form = F.coalesce("canonical", F.concat(F.lit("\0"), "id"))
    rows = levels.withColumns({"_form": form, "_place": place})
    first = rows.groupBy("_form").agg(F.min("_place").alias("_first"))
    out = rows.join(first, "_form")
    outcome = F.when(F.col("_place") != F.col("_first"), "duplicate").when(F.col("status") != "solved", "unsolved").otherwise("kept")
    return out.withColumn("outcome", outcome).drop("_form", "_place", "_first")


def kept(levels: DataFrame) -> DataFrame:
    return deduplicated(levels).where("outcome = 'kept'").drop("outcome")


def edges_of(train: DataFrame, n: int = BUCKETS) -> DataFrame:
    """AGG-3: one row `edges`, exact interior quantiles of the moves, rounded to nine digits."""
    found = percentiles(train, [], "moves", [k / n for k in range(1, n)], "edges")
    return found.select(F.transform("edges", lambda e: F.round(e, 9)).alias("edges"))


def bucketed(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """FN-12 on every level; the one row of edges is broadcast."""
    return levels.crossJoin(F.broadcast(edges)).withColumn("bucket", bucket_of(F.col("moves"), F.col("edges")).cast("tinyint")).drop("edges")


def source_stats(levels: DataFrame) -> DataFrame:
    """AGG-1: levels of each source and how many have each status."""
    return levels.groupBy("source").agg(F.count("*").alias("levels"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def split_stats(levels: DataFrame) -> DataFrame:
    """AGG-2: kept, duplicates and unsolved of each split."""
    return deduplicated(levels).groupBy("split").agg(*(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("kept", "kept"), ("duplicate", "duplicates_removed"), ("unsolved", "unsolved_removed"))))


def move_stats(levels: DataFrame) -> DataFrame:
    """AGG-4: move percentiles cut to whole numbers, medians of pushes and nodes."""
    levels = cut(levels.select("split", "moves", "pushes", "nodes_expanded"))
    of = lambda column, name, *points: percentiles(levels, ["split"], column, points, name)
    rows = of("moves", "p", 0.0, 0.1, 0.5, 0.9, 1.0).join(of("pushes", "pushes", 0.5), "split", "left").join(of("nodes_expanded", "nodes", 0.5), "split", "left")
    names = ("moves_min", "moves_p10", "moves_median", "moves_p90", "moves_max")
    return rows.select("split", *(F.col("p")[k].cast("int").alias(n) for k, n in enumerate(names)), F.col("pushes")[0].cast("int").alias("pushes_median"), F.col("nodes")[0].cast("long").alias("nodes_median"))


def bucket_counts(levels: DataFrame) -> DataFrame:
    """AGG-5: levels of each bucket and split, zero where there are none."""
    counts = levels.groupBy("split", "bucket").agg(F.count("*").alias("n"))
    spine = levels.select("split").distinct().select("split", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)).cast("array<tinyint>")).alias("bucket"))
    return spine.join(counts, ["split", "bucket"], "left").select("split", F.col("bucket").cast("int").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def bucket_card(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-5: the counts with the range of moves of each bucket."""
    labels = edges.select(F.posexplode(bucket_labels(F.col("edges"))).alias("bucket", "moves"))
    return bucket_counts(levels).groupBy("bucket").pivot("split", ["test", "val", "hard", "train"]).sum("n").na.fill(0).join(F.broadcast(labels), "bucket")


def first_of_source(levels: DataFrame, n: int) -> DataFrame:
    """WIN-3: the first n levels of each source in order. Top-n by partition needs no full sort of a source."""
    order = Window.partitionBy("source").orderBy("file", "index", "id")
    return levels.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def first_of_split(levels: DataFrame, split: str, n: int) -> DataFrame:
    """ORD-2: the first n levels of a split in level order."""
    return levels.where(F.col("split") == split).orderBy(*ORDER, "id").limit(n)


def effort(levels: DataFrame) -> DataFrame:
    """AGG-16: correlation of pushes and nodes with moves, by split."""
    return levels.groupBy("split").agg(F.round(F.corr("pushes", "moves"), 9).alias("pushes_moves"), F.round(F.corr("nodes_expanded", "moves"), 9).alias("nodes_moves"))


def status_share(levels: DataFrame) -> DataFrame:
    """AGG-15: the share of each status."""
    counts = levels.groupBy("status").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def nearest_rank(rows: DataFrame, column: str, points: tuple[float, ...]) -> DataFrame:
    """AGG-14: the values at places floor(p * n) of the sorted column, and the largest.

    Equal values are counted first, so the running count runs over distinct values.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranked = cut(running_sums(counts, [], ["v"], F.col("n"), "below"))
    total = ranked.agg(F.sum("n").alias("total"), F.max("v").alias("largest"))
    hits = [F.min(F.when(F.col("below") + F.col("n") > F.floor(F.lit(p) * F.col("total")), F.col("v"))).alias(f"p{round(100 * p)}") for p in points]
    return ranked.crossJoin(F.broadcast(total)).agg(*hits, F.first("largest").alias("largest"))
