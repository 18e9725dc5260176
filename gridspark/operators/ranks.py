"""Ranks, running sums and exact percentiles in two levels: ranges of rows in order, totals of the ranges, offsets.

Rows are dealt to ranges by (keys, order), so that a key that all rows share, or a value that many share,
lies in many ranges. Sums are taken within a range, and a range adds the totals of the earlier ranges of its
key: a window over one row a range. No task holds more than a range, and no buffer grows with the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.rounds import cut


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, name: str) -> DataFrame:
    """rows with `name`: the weights of the rows before it in the order of its key. The order is taken to be total."""
    ranges = cut(rows.withColumn("_w", weight).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy(*keys, "_range").agg(F.sum("_w").alias("_total"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_total").over(earlier(*keys).orderBy("_range")), F.lit(0))
    offsets = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_at"), offset.alias("_offset"))
    inside = F.coalesce(F.sum("_w").over(earlier(*keys, "_range").orderBy(*order)), F.lit(0))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = ranges.withColumn("_inside", inside).join(offsets, same)
    return out.withColumn(name, F.col("_offset") + F.col("_inside")).select(*rows.columns, name)


def ordered_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with `name`: the 0-based rank in the order of its key; nulls first."""
    return running_sums(rows, keys, order, F.lit(1), name)


def percentiles(rows: DataFrame, keys: Sequence[str], column: str, points: Sequence[float], name: str) -> DataFrame:
    """keys and `name`, an array of exact percentiles of a column with linear interpolation; null values don't count. Without keys there is one row, null where there are no values.

    Equal values are counted first, map-side, and what is ordered are distinct values.
    """
    values = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    below = cut(running_sums(values, keys, ["_v"], F.col("_n"), "_below"))
    sizes = below.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = below.join(sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), "_size"), same) if keys else below.crossJoin(F.broadcast(sizes))

    def at(place: Column) -> Column:
        """The value that stands at a place."""
        return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col("_v").cast("double")))

    place = [F.lit(float(p)) * (F.col("_size") - 1) for p in points]
    lows, highs = [F.floor(p) for p in place], [F.ceil(p) for p in place]
    found = placed.groupBy(*keys).agg(F.max("_size").alias("_size"), *(at(x).alias(f"_low{i}") for i, x in enumerate(lows)), *(at(x).alias(f"_high{i}") for i, x in enumerate(highs)))
    share = [p - F.floor(p) for p in place]
    # The higher value's part is added to the lower's, each times its share.
    between = lambda i: F.when(share[i] == 0, F.col(f"_low{i}")).otherwise((1 - share[i]) * F.col(f"_low{i}") + share[i] * F.col(f"_high{i}"))
    return found.select(*keys, F.when(F.col("_size").isNotNull(), F.array(*(between(i) for i in range(len(points))))).alias(name))
