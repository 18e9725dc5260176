"""Scores of generated samples: rows, summaries by group, confusion, calibration, ranks and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.grid import bucket_of, is_valid, sample_status
from gridspark.operators.dataset import BUCKETS
from gridspark.operators.neighbours import close_pairs, novel, novel_k, with_nearest
from gridspark.operators.ranks import ordered_rank, percentiles
from gridspark.operators.rounds import cut


def scored(samples: DataFrame, corpus: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """LBL-2, FN-16, JOIN-1, JOIN-4, JOIN-6: one row a sample with validity, status, moves, bucket and novelty.

    Solver results count for valid texts only.
    """
    rows = samples.withColumn("valid", is_valid(F.col("text")))
    rows = rows.withColumn("status", sample_status(F.col("text"), F.col("valid"), F.col("solver_status")))
    rows = rows.withColumn("solved", F.col("status") == "solved").withColumn("moves", F.when(F.col("solved"), F.col("solver_moves")))
    rows = rows.crossJoin(F.broadcast(edges)).withColumn("bucket", bucket_of(F.col("moves"), F.col("edges"))).drop("edges", "solver_status", "solver_moves")
    rows = novel(rows, corpus).withColumnRenamed("novel", "novel_strict")
    rows = novel_k(rows, corpus, k)
    return rows.withColumn("novel_exact", F.col("valid") & F.coalesce("novel_strict", F.lit(False)))


def with_distances(rows: DataFrame, corpus: DataFrame, cap: int = 20) -> DataFrame:
    """JOIN-2, JOIN-3 as columns nn_edit and nn_edit_sym of scored rows, from one search; for a stated query set, as each row meets the whole corpus."""
    return with_nearest(rows, corpus, cap, "nn_edit", "nn_edit_sym")


def ordinal_rank(rows: DataFrame, column: str, rank: str, *group: str) -> DataFrame:
    """WIN-2: 0-based ordinal rank by (value, sample_id) within the groups; neither a frequent value nor a large group is a sort in one task."""
    return ordered_rank(rows, group, [column, "sample_id"], rank)


def grouped(rows: DataFrame, run: str | None = None) -> DataFrame:
    """Each row once for every summary it counts in: all, conditional or unconditional, and its bucket. With a column of runs the group is (run, name)."""
    names = F.array(F.lit("all"), F.when(F.col("target").isNull(), "unconditional").otherwise("conditional"), F.when(F.col("target").isNotNull(), F.concat(F.lit("d"), F.col("target").cast("string"))))
    named = F.explode(F.array_compact(names))
    return rows.withColumn("group", named) if run is None else rows.withColumn("_name", named).withColumn("group", F.struct(F.col(run).alias("run"), F.col("_name").alias("name"))).drop("_name")


def spearman(rows: DataFrame) -> DataFrame:
    """AGG-9: correlation of ordinal ranks of target and moves of solved rows, by group; null with one target only."""
    rows = rows.where("solved AND target IS NOT NULL")
    rows = ordinal_rank(ordinal_rank(rows, "target", "rt", "group"), "moves", "rm", "group")
    value = F.when(F.count_distinct("target") > 1, F.corr("rt", "rm"))
    return rows.groupBy("group").agg(F.round(value, 9).alias("spearman"))


def share(of: Column) -> Column:
    return F.round(F.avg(of.cast("double")), 9)


def summary(rows: DataFrame, buckets: int = BUCKETS, run: str | None = None) -> DataFrame:
    """AGG-6, AGG-7, AGG-8: metrics of all, conditional, unconditional and each bucket; empty groups have n = 0.

    With a column of runs the groups of all runs are summed in the same jobs, one row a run and group.
    Fixed values: the names of metrics and groups.
    """
    members = grouped(rows, run)
    playable, on = F.col("valid") & F.col("solved"), F.when(F.col("solved") & F.col("target").isNotNull(), F.col("bucket") - F.col("target"))
    sums = members.groupBy("group").agg(
        F.count("*").alias("n"), share(F.col("valid")).alias("valid"), share(playable).alias("playable"), share(F.col("novel_k")).alias("novel"), share(F.coalesce("novel_strict", F.lit(False))).alias("novel_strict"),
        share(playable & F.col("novel_k")).alias("playable_novel"), share(F.col("solved") & F.coalesce("novel_strict", F.lit(False))).alias("novel_solvable"), F.round(F.count_distinct(F.when(F.col("valid"), F.col("text"))) / F.count("*"), 9).alias("unique"),
        F.round(F.avg((on == 0).cast("double")), 9).alias("bucket_exact"), F.round(F.avg((F.abs(on) <= 1).cast("double")), 9).alias("bucket_within1"),
    )
    names = F.array(*map(F.lit, ["all", "conditional", "unconditional", *(f"d{b}" for b in range(buckets))]))
    if run is None:
        spine = rows.sparkSession.range(1).select(F.explode(names).alias("group"))
    else:
        spine = rows.select(F.col(run).alias("run")).distinct().select("run", F.explode(names).alias("name")).select(F.struct("run", "name").alias("group"))
    score = headline(rows, run=run).select("group", "score")
    medians = percentiles(members, ["group"], "moves", [0.5], "median").select("group", F.col("median")[0].alias("moves_median"))
    out = spine.join(sums, "group", "left").join(medians, "group", "left").join(spearman(members), "group", "left").join(score, "group", "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    return out if run is None else out.withColumn("run", F.col("group.run")).withColumn("group", F.col("group.name"))


def confusion(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """AGG-12: counts of target by bucket of solved rows and their share of the target's row."""
    counts = rows.where("solved AND target IS NOT NULL").groupBy("target", "bucket").agg(F.count("*").alias("n"))
    sums = counts.groupBy(F.col("target").alias("t")).agg(F.sum("n").alias("total"))
    every = rows.sparkSession.range(buckets * buckets).select(F.floor(F.col("id") / buckets).cast("int").alias("target"), (F.col("id") % buckets).cast("int").alias("bucket"))
    out = every.join(counts, ["target", "bucket"], "left").join(sums, F.col("target") == F.col("t"), "left")
    return out.select("target", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(1)), F.lit(1)), 9).alias("share"))


def calibration(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-13: the move range of each target and the box-plot figures of its solved moves."""
    rows = rows.where("solved AND target IS NOT NULL")
    q = rows.groupBy("target").agg(F.percentile("moves", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    inside = F.col("moves").between(F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0]))
    ends = rows.join(F.broadcast(q), "target").where(inside).groupBy("target").agg(F.min("moves").cast("double").alias("whisker_lo"), F.max("moves").cast("double").alias("whisker_hi"))
    e = edges.withColumn("all", F.concat(F.array(F.lit(0.0)), F.col("edges"), F.array(1.5 * F.array_max("edges"))))
    out = q.join(ends, "target").crossJoin(F.broadcast(e.select("all")))
    return out.select("target", F.round(F.get("all", F.col("target")), 9).alias("lo"), F.round(F.get("all", F.col("target") + 1), 9).alias("hi"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "whisker_lo", "whisker_hi", "n")


def diversity(rows: DataFrame, k: int = 5) -> DataFrame:
    """AGG-10: by group, what is left when the row with most neighbours under k edits goes until none has any.

    rows (group, sample_id, text); rows without an id or a text don't count. Ties go to the lowest sample_id.
    Copies of a text are one node with a count, and so are texts with the same neighbours, themselves included.
    Each node's rows go by id, so a node is its rows from some place on. Each node without neighbours leaves
    one row in the end. `peeled` is one round.
    """
    members = rows.where("text IS NOT NULL AND sample_id IS NOT NULL").select("group", "sample_id", "text")
    pairs = close_pairs(members, k).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    texts = cut(members.groupBy("group", "text").agg(F.count("*").alias("n"), F.min("sample_id").alias("low"), F.max("sample_id").alias("high")))
    left, right = (texts.select("group", F.col("text").alias(x)) for x in ("a", "b"))
    near = cut(left.join(both, "a").join(right, ["group", "b"]).select("group", "a", "b"))

    around = near.unionByName(texts.select("group", F.col("text").alias("a"), F.col("text").alias("b")))
    twins = around.groupBy("group", F.col("a").alias("text")).agg(*(hash_sum(F.col("b"), seed).alias(f"around{seed}") for seed in (1, 2)))
    heads = twins.groupBy("group", "around1", "around2").agg(F.min("text").alias("node"))
    node = cut(twins.join(heads, ["group", "around1", "around2"]).select("group", "text", "node"))
    of = lambda x: node.select("group", F.col("text").alias(x), F.col("node").alias(f"node_{x}"))
    edges = near.join(of("a"), ["group", "a"]).join(of("b"), ["group", "b"]).where("node_a <> node_b")
    edges = cut(edges.select("group", F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    state = texts.join(node, ["group", "text"]).groupBy("group", "node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    state = cut(state.withColumn("all", F.col("n")))
    if not edges.isEmpty():
        crowded = edges.select("group", F.col("a").alias("node")).distinct()
        held = members.join(node, ["group", "text"]).join(crowded, ["group", "node"], "left_semi").select("group", "node", "sample_id")
        held = cut(ordered_rank(held, ["group", "node"], ["sample_id"], "place"))
    while not edges.isEmpty():
        state, edges = peeled(state, edges, held)
    return state.groupBy("group").agg(F.count("*").alias("diversity"))


def hash_sum(of: Column, seed: int) -> Column:
    """Names a set by the sum of its hashes."""
    return F.sum(F.xxhash64(F.lit(seed), of).cast("decimal(38,0)"))


def peeled(state: DataFrame, edges: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of the greedy: state (group, node, n, low, high, all) and edges (group, a, b) after it; held (group, node, sample_id, place) has all rows from the start.

    When a row goes, its node and all its neighbours lose one neighbour each. So a node that exceeds all its
    neighbours stays ahead of them until it is empty, whatever happens elsewhere: all such nodes go at once.
    Nodes that tie, are neighbours of each other and exceed all others around them lose one neighbour each with
    every row that goes, so they stay tied, and their rows go in the merged order of ids. A neighbour outside gains
    on them by the rows of those that it doesn't touch, and must not overtake: with m such nodes and a gap g, rows go up to
    the least id that stands at place g // m of one of them. Without neighbours outside all rows go but the last.
    A node that ties otherwise gives up its rows below the lowest id of those that it ties with.
    """
    sizes = state.select("group", F.col("node").alias("b"), F.col("n").alias("nb"))
    degree = edges.join(sizes, ["group", "b"]).groupBy("group", F.col("a").alias("node")).agg(F.sum("nb").alias("others"))
    degree = cut(degree.join(state, ["group", "node"]).select("group", "node", "low", "high", "n", "all", (F.col("others") + F.col("n") - 1).alias("d")))
    mine, rival = (degree.select("group", F.col("node").alias(x), F.col("low").alias(f"low_{x}"), F.col("d").alias(f"d_{x}")) for x in ("a", "b"))
    sides = cut(edges.join(mine, ["group", "a"]).join(rival, ["group", "b"]))
    ties = F.col("d_a") == F.col("d_b")
    ahead, beaten = F.col("d_b") > F.col("d_a"), (F.col("d_b") > F.col("d_a")) | (ties & (F.struct("low_b", "b") < F.struct("low_a", "a")))
    tied = [(F.coalesce(hash_sum(F.when(ties, F.col("b")), seed), F.lit(0)) + F.xxhash64(F.lit(seed), F.col("a")).cast("decimal(38,0)")).alias(f"tied{seed}") for seed in (1, 2)]
    tops = sides.groupBy("group", "a").agg(F.max(ahead).alias("ahead"), F.max(beaten).alias("beaten"), F.min(F.when(ties, F.col("low_b"))).alias("until"), F.min("low_a").alias("low"), F.count_if(ties).alias("ties"), *tied)
    tops = cut(tops.where("NOT ahead").withColumnRenamed("a", "node"))

    # Tied neighbours that all have the same ones.
    name = ["group", "tied1", "tied2"]
    full = tops.where("ties > 0").groupBy(*name).agg(F.count("*").alias("members"), F.max("ties").alias("most")).where("members = most + 1")
    cliques = cut(tops.join(full, name).select(*name, "node", "members").join(degree, ["group", "node"]))
    touch = sides.where("d_b < d_a").join(cliques.select(*name, F.col("node").alias("a"), "members"), ["group", "a"])
    gaps = touch.groupBy(*name, "b").agg(F.max(F.col("d_a") - F.col("d_b")).alias("gap"), (F.max("members") - F.count("*")).alias("m"), F.collect_set("a").alias("touched")).where("m > 0")
    free = gaps.join(cliques.select(*name, "node", "n", "all"), name).where(~F.array_contains("touched", F.col("node")))
    place = F.greatest(F.lit(1), F.floor(F.col("gap") / F.col("m")))
    stops = free.where(place <= F.col("n")).select(*name, "node", (F.col("all") - F.col("n") + place - 1).alias("place")).join(held, ["group", "node", "place"])
    stops = stops.groupBy(*name).agg(F.min("sample_id").alias("stop"))
    alone = cliques.groupBy(*name).agg((F.max("d") == F.sum("n") - 1).alias("alone"), F.max("high").alias("last"))
    ends = alone.join(stops, name, "left").select(*name, F.when(F.col("alone"), F.col("last") - 1).otherwise(F.col("stop")).alias("stop"))
    merged = cliques.select(*name, "node").join(ends, name).select("group", "node", "stop")

    rest = tops.join(merged.select("group", "node"), ["group", "node"], "left_anti").where("NOT beaten")
    singles = rest.select("group", "node", F.when(F.col("until").isNotNull(), F.greatest(F.col("low"), F.col("until") - 1)).alias("stop"))
    gone = cut(merged.unionByName(singles))
    kept = held.join(gone.where("stop IS NOT NULL"), ["group", "node"]).where("sample_id > stop").groupBy("group", "node").agg(F.count("*").alias("n"), F.min("sample_id").alias("low"))
    kept = kept.join(state.select("group", "node", "high", "all"), ["group", "node"]).select(*state.columns)
    state = cut(state.join(gone, ["group", "node"], "left_anti").unionByName(kept))
    alive = lambda x: state.select("group", F.col("node").alias(x))
    return state, cut(edges.join(alive("a"), ["group", "a"], "left_semi").join(alive("b"), ["group", "b"], "left_semi"))


def headline(rows: DataFrame, k: int = 5, run: str | None = None) -> DataFrame:
    """AGG-11: diversity of playable and novel rows over all rows, by group."""
    members = grouped(rows, run)
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    good = diversity(members.where("valid AND solved AND novel_k"), k)
    return sizes.join(good, "group", "left").select("group", "n", F.coalesce("diversity", F.lit(0)).alias("diversity"), F.round(F.coalesce("diversity", F.lit(0)) / F.col("n"), 9).alias("score"))
