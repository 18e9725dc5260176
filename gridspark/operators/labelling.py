"""Labelling jobs: any solver by Arrow batch, label tables and checks against external labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.grid import is_valid, normalised, parse_error, sample_status
from gridspark.sources.files import unlabelled

#: Levels and a node budget in; status, moves, pushes, path and nodes of each out.
Solver = Callable[[list[str], int], list[tuple[str, int, int, str, int]]]
SCHEMA = "status string, moves int, pushes int, path string, nodes_expanded long"


def label(levels: DataFrame, max_nodes: int, solver: Solver, parts: int = 64, batch: int = 200) -> DataFrame:
    """LBL-1: levels (text, ...) with a label each; every distinct text is solved once, faulty ones are `invalid` with their error.

    Search effort is heavy-tailed: texts are dealt to many small partitions.
    """
    texts = levels.select("text").distinct().withColumn("level", normalised(F.col("text")))
    texts = texts.withColumn("error", parse_error(F.col("level")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                got = solver(part["level"].tolist(), max_nodes)
                yield pd.DataFrame(got, columns=["status", "moves", "pushes", "path", "nodes_expanded"]).assign(text=part["text"].to_numpy())[["text", "status", "moves", "pushes", "path", "nodes_expanded"]]

    solved = texts.where("error IS NULL").repartition(parts, F.xxhash64("text")).select("text", "level").mapInPandas(run, f"text string, {SCHEMA}")
    faulty = texts.where("error IS NOT NULL").select("text", F.lit("invalid").alias("status"), F.lit(0).alias("moves"), F.lit(0).alias("pushes"), F.lit("").alias("path"), F.lit(0).cast("long").alias("nodes_expanded"), "error")
    found = solved.withColumn("error", F.lit(None).cast("string")).unionByName(faulty).withColumnRenamed("text", "_text")
    return levels.join(found, F.col("text").eqNullSafe(F.col("_text"))).drop("_text")


def merged(levels: DataFrame, labels: DataFrame) -> DataFrame:
    """LBL-1 around any solver: levels (text, ...) with status, moves and error by a label table (text, status, moves), one row a text.

    Faulty texts are `invalid` with their error; `unlabelled` are the distinct texts that a solver has yet to see.
    """
    texts = levels.select("text").distinct().withColumn("error", parse_error(normalised(F.col("text"))))
    valid, faulty = texts.where("error IS NULL"), texts.where("error IS NOT NULL")
    known = valid.join(labels.select("text", "status", "moves"), "text").select("text", "status", "moves", "error")
    missing = unlabelled(valid, labels, "text").select("text", F.lit("unlabelled").alias("status"), F.lit(None).cast("int").alias("moves"), "error")
    found = known.unionByName(missing).unionByName(faulty.select("text", F.lit("invalid").alias("status"), F.lit(0).alias("moves"), "error"))
    return levels.join(found.withColumnRenamed("text", "_text"), F.col("text").eqNullSafe(F.col("_text"))).drop("_text")


def valid_only(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """LBL-2: samples (sample_id, text) with status and moves: only valid texts meet the label table (text, status, moves), the rest keep why not.

    A valid text that the table lacks is `unlabelled`; a null text is undecodable.
    """
    rows = samples.select("sample_id", "text", is_valid(F.col("text")).alias("valid"))
    known = merged(rows.where("valid").select("sample_id", "text"), labels).select(F.col("sample_id").alias("_id"), F.col("status").alias("_status"), "moves")
    out = rows.join(known, F.col("sample_id") == F.col("_id"), "left")
    return out.select("sample_id", sample_status(F.col("text"), F.col("valid"), F.col("_status")).alias("status"), "moves")


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """LBL-3: ours (file, index, status, moves) with `verdict`: agree, disagree, unlabelled; unsolved rows are left out."""
    rows = ours.where("status = 'solved'").join(theirs.select("file", "index", "steps"), ["file", "index"], "left")
    number = F.when(F.col("steps").rlike("^[0-9]+$"), F.col("steps").try_cast("int"))
    return rows.withColumn("verdict", F.when(number.isNull(), "unlabelled").when(number == F.col("moves"), "agree").otherwise("disagree")).withColumn("steps", number)


def examples(rows: DataFrame, n: int = 5) -> DataFrame:
    """ORD-1: the first n disagreeing levels in order."""
    return rows.where("verdict = 'disagree'").orderBy("file", "index").limit(n).select("file", "index", "steps", "moves")
