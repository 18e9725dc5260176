"""Reward, advantage and selection tables over scored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.grid import canonical
from gridspark.operators.scoring import summary


def rewards(rows: DataFrame, middles: dict[int, float], sigma: float = 10.0, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """RWD-1: validity gate, playability, match of the length with the target's middle, novelty and their total."""
    middle = F.create_map(*(F.lit(x) for kv in middles.items() for x in kv))[F.col("target")]
    match = F.when(F.col("solved") & F.col("target").isNotNull(), F.round(F.exp(-F.abs(F.col("moves") - middle) / sigma), 9)).otherwise(0.0)
    parts = rows.withColumns({"r_valid": F.when(F.col("valid"), 0.0).otherwise(-1.0), "r_playable": F.col("solved").cast("double"), "r_match": match, "r_novel": F.coalesce("novel_strict", F.lit(False)).cast("double")})
    total = F.when(F.col("valid"), weights[0] * F.col("r_playable") + weights[1] * F.col("r_match") + weights[2] * F.col("r_novel")).otherwise(-1.0)
    return parts.withColumn("total", F.round(total, 9))


def copy_penalty(rows: DataFrame, penalty: float = 0.5) -> DataFrame:
    """RWD-2: copies of a text within its group take a penalty each; counted by a combined aggregate and joined back."""
    counts = rows.where("text IS NOT NULL").groupBy("group_id", "text").agg(F.count("*").alias("_n"))
    out = rows.join(counts, ["group_id", "text"], "left")
    return out.withColumn("r_copies", F.round(-penalty * (F.coalesce("_n", F.lit(1)) - 1), 9)).drop("_n")


def advantages(rows: DataFrame, divide: bool = False) -> DataFrame:
    """RWD-3: reward less the mean of its group, over the deviation if asked for (0 where that is 0)."""
    sums = rows.groupBy("group_id").agg(F.avg("total").alias("_mean"), F.stddev_pop("total").alias("_dev"))
    gap = F.col("total") - F.col("_mean")
    value = F.when(F.col("_dev") > 0, gap / F.col("_dev")).otherwise(0.0) if divide else gap
    return rows.join(sums, "group_id").withColumn("advantage", F.round(value, 9)).drop("_mean", "_dev")


def informative(rows: DataFrame) -> DataFrame:
    """RWD-4: the rows of groups whose rewards are not all the same."""
    mixed = rows.groupBy("group_id").agg(F.min("total").alias("lo"), F.max("total").alias("hi")).where("lo <> hi").select("group_id")
    return rows.join(mixed, "group_id", "left_semi")


def selected(rows: DataFrame) -> DataFrame:
    """RWD-5: playable, novel, on-target samples, the first of each canonical form."""
    good = rows.where("valid AND solved AND novel_exact AND target IS NOT NULL AND bucket = target").withColumn("_form", canonical(F.col("text")))
    first = good.groupBy("_form").agg(F.min("sample_id").alias("sample_id")).select("sample_id")
    return good.join(first, "sample_id", "left_semi").drop("_form")


def runs_table(rows: DataFrame, run: str, more: dict[str, dict[str, float | None]] | None = None) -> DataFrame:
    """RWD-6: summaries of scored rows by the column `run`, one row a run and group, with cost and latency where `more` gives them.

    The runs are a key of the summary's jobs, so the scored rows are read as often for many runs as for one.
    """
    given = [(name, *(float(x) if (x := figures.get(c)) is not None else None for c in ("cost", "latency"))) for name, figures in (more or {}).items()]
    table = rows.sparkSession.createDataFrame(given, "_run string, cost double, latency double")
    return summary(rows, run=run).join(F.broadcast(table), F.col("run") == F.col("_run"), "left").drop("_run")
