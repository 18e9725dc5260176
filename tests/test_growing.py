"""Stores that grow by sources, and tables bucketed by a column, against the rebuild and plain joins."""

import random

from pyspark.sql import functions as F

from gridspark.operators import dataset, growing, neighbours
from gridspark.sources import files

SCHEMA = "id string, split string, split_rank int, source_rank int, file int, index int, canonical string, status string, outcome_of string"


def levels(rng, source, n, forms):
    """Levels of a source; a third share one form, some have none."""
    rank = source // 2
    out = []
    for i in range(n):
        form = rng.choice(["hot", None, *(f"f{rng.randrange(forms)}" for _ in range(2))])
        out.append((f"s{source}/{i}", f"split{rank}", rank, source, i // 7, i % 7, form, rng.choice(["solved", "solved", "unsolvable", None]), "x"))
    return out


def test_sources_in_any_order_give_the_rows_of_the_rebuild(spark, tmp_path):
    rng = random.Random(3)
    sources = {s: levels(rng, s, n, 40) for s, n in enumerate([30, 0, 25, 40, 1])}
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for turn, order in enumerate([(4, 3, 2, 1, 0), (2, 0, 4, 1, 3)]):
        path, seen = str(tmp_path / f"store{turn}"), []
        assert growing.outcomes(spark, path) is None and growing.forms(spark, path) is None
        for s in order:
            assert growing.add_source(frame(sources[s]), path, f"source{s}")
            seen += sources[s]
            want = sorted(dataset.deduplicated(frame(seen)).select("id", "outcome").collect())
            assert sorted(growing.outcomes(spark, path).select("id", "outcome").collect()) == want
        assert not growing.add_source(frame(sources[0]), path, "source0")
        firsts = {}
        for r in sorted(seen, key=lambda r: r[2:6]):
            firsts.setdefault(r[6], r[0])
        firsts.pop(None, None)
        assert dict(map(tuple, growing.forms(spark, path).collect())) == firsts
        assert set(growing.outcomes(spark, path).columns) == {"outcome", *(c.split()[0] for c in SCHEMA.split(", "))}


def test_a_source_that_was_not_committed_does_not_count(spark, tmp_path):
    path, rows = str(tmp_path / "store"), [("a", "train", 3, 0, 0, 0, "f", "solved", "x")]
    growing.add_source(spark.createDataFrame(rows, SCHEMA), path, "one")
    torn = spark.createDataFrame([("f", 1, (0, 0, 0, 0, "b"), "torn")], "form string, key long, place struct<split_rank:int,source_rank:int,file:int,index:int,id:string>, batch string")
    torn.write.mode("append").partitionBy("batch").parquet(f"{path}/firsts")
    torn.select("place", "batch").write.mode("append").partitionBy("batch").parquet(f"{path}/displaced")
    growing.add_source(spark.createDataFrame([("c", "train", 3, 0, 0, 1, "f", "solved", "x")], SCHEMA), path, "two")
    assert sorted(map(tuple, growing.outcomes(spark, path).select("id", "outcome").collect())) == [("a", "kept"), ("c", "duplicate")]
    assert [tuple(r) for r in growing.forms(spark, path).collect()] == [("f", "a")]


def test_only_probable_repeats_of_the_store_are_shuffled(spark):
    place = F.struct(F.lit(0).alias("split_rank"), F.lit(0).alias("source_rank"), F.lit(0).alias("file"), F.lit(0).alias("index"), F.col("form").alias("id")).alias("place")
    keyed = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("form")).select("form", F.xxhash64("form").alias("key"), place)
    found = {r["form"] for r in growing.probable(keyed(0, 50_000), keyed(49_900, 50_100)).collect()}
    assert {f"f{i}" for i in range(49_900, 50_000)} <= found and len(found) < 300


def test_a_bucketed_corpus_is_not_moved(spark, tmp_path):
    grids = [f"{a}{b}\n{c}{d}" for a in "# $" for b in "# ." for c in "#@ " for d in "# ."]
    known = spark.createDataFrame([(t,) for t in grids[::2]], "text string").withColumn("canonical", neighbours.canonical(F.col("text"))).dropDuplicates(["canonical"])
    known = known.unionByName(spark.createDataFrame([("odd", None)], "text string, canonical string"))
    samples = spark.createDataFrame([*enumerate(grids * 2), (999, None)], "sample_id long, text string")
    table = files.write_bucketed(known, "known_levels", path := str(tmp_path / "known"), "canonical", 5)
    want = sorted(neighbours.novel(samples, known).select("sample_id", "novel").collect(), key=str)
    assert sorted(neighbours.novel(samples, table).select("sample_id", "novel").collect(), key=str) == want
    spark.sql("DROP TABLE known_levels")
    again = files.read_bucketed(spark, "known_levels", path, "canonical", 5)
    assert sorted(again.collect(), key=str) == sorted(known.collect(), key=str)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(before, ("-1", "false", "9"), strict=True):
            spark.conf.set(c, v)
        plan = lambda corpus: neighbours.novel(samples, corpus)._jdf.queryExecution().executedPlan().toString()
        # One side moves, the samples; without buckets both do.
        assert plan(again).count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan(again)
        assert plan(known).count("Exchange hashpartitioning") > 1
        assert sorted(neighbours.novel(samples, again).select("sample_id", "novel").collect(), key=str) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
        spark.sql("DROP TABLE known_levels")
