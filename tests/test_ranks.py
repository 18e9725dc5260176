"""Ranks, percentiles and bulk peeling against plain versions, with hot groups and values."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.tokens import uniform
from gridspark.operators import dataset, ranks, rewards, sampling, scoring


def test_ranks_of_one_group_lie_in_many_ranges(spark):
    """All rows in one group, a third of them of one value."""
    rows = spark.range(60_000).select(F.lit("all").alias("g"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("v"), "id").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranks.ordered_rank(rows, ["g"], ["v", "id"], "rank").withColumn("part", F.floor(F.col("rank") / 1500))
        got = {r["id"]: (r["v"], r["rank"]) for r in out.collect()}
        ranges = [r["count"] for r in rows.repartitionByRange("g", "v", "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(ranges) < 0.06 * 60_000
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1][1])] == [i for _, i in sorted((v, i) for i, (v, _) in got.items())]
    assert {r for _, r in got.values()} == set(range(60_000))


def test_ranks_with_null_keys_and_values(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r["i"]: r["rank"] for r in ranks.ordered_rank(df, ["g"], ["v", "i"], "rank").collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(len(mine)))
    assert ranks.ordered_rank(df.where("i < 0"), ["g"], ["v"], "rank").count() == 0


def test_percentiles_equal_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 7, rng.randrange(10**6)])) for _ in range(500)] + [("one", 3), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    points = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = {r["g"]: r["p"] for r in ranks.percentiles(df, ["g"], "v", points, "p").collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, p in got.items():
        assert np.allclose(p, np.quantile([v for h, v in rows if h == g and v is not None], points), rtol=1e-12)
    assert np.allclose(ranks.percentiles(df, [], "v", points, "p").first()[0], np.quantile([v for _, v in rows if v is not None], points))
    assert [r["edges"] for r in dataset.edges_of(df.where("g = 'none'").withColumnRenamed("v", "moves")).collect()] == [None]


def test_samples_are_exact_nested_and_unsorted(spark):
    rows = spark.range(700).select(F.concat(F.lit("r"), F.pmod("id", F.lit(690))).alias("id"))
    order = sorted(((r["u"], r["id"]) for r in rows.select("id", uniform("s", F.col("id")).alias("u")).collect()))
    for share in (0.0, 0.001, 0.3, 0.5, 0.999, 1.0):
        df = sampling.fraction(rows, share, "s")
        assert sorted(r["id"] for r in df.collect()) == sorted(i for _, i in order[: int(700 * share)])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan
    assert sampling.fraction(rows.where("id = ''"), 0.5, "s").count() == 0


def test_runs_are_a_key_of_the_summaries(spark):
    """The summaries of two runs at once equal those of each run alone, and the scored rows are read no oftener for two runs than for one."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnop", k=14)) for _ in range(12)]
    texts += [texts[0][1:], texts[1] + "q"]
    rows = [(i, rng.choice([None, 0, 3]), rng.choice(texts), rng.random() < 0.8, rng.random() < 0.7, rng.randrange(50), rng.randrange(4), rng.random() < 0.5, rng.random() < 0.9, f"run{i % 2}") for i in range(120)]
    rows = [(i, t, x, v, s and v, m if s and v else None, b if s and v else None, n, k, r) for i, t, x, v, s, m, b, n, k, r in rows]
    df = spark.createDataFrame(rows, "sample_id long, target int, text string, valid boolean, solved boolean, moves int, bucket int, novel_strict boolean, novel_k boolean, run string")
    both = rewards.runs_table(df, "run", {"run1": {"cost": 2.0}})
    got = sorted((tuple(r) for r in both.select("run", "group", "n", "valid", "unique", "moves_median", "spearman", "score", "cost").collect()), key=repr)
    want = [(f"run{k}", *r, 2.0 if k else None) for k in (0, 1) for r in scoring.summary(df.where(F.col("run") == f"run{k}")).select("group", "n", "valid", "unique", "moves_median", "spearman", "score").collect()]
    assert got == sorted(want, key=repr) and len(got) == 26


def greedy(nodes, near):
    """What is left of nodes {name: ids} when the row with most neighbours goes, lowest id on ties; rows of a node are neighbours too."""
    rows = {v: sorted(ids, reverse=True) for v, ids in nodes.items()}
    while True:
        degree = {v: len(ids) - 1 + sum(len(rows[w]) for w in near[v]) for v, ids in rows.items() if ids}
        top = max(degree.values(), default=0)
        if top <= 0:
            return sum(map(len, rows.values()))
        rows[min((v for v, d in degree.items() if d == top), key=lambda v: rows[v][-1])].pop()


def shared_rounds(monkeypatch):
    rounds = []
    plain = scoring.peeled
    monkeypatch.setattr(scoring, "peeled", lambda *args: rounds.append(1) or plain(*args))
    return rounds


@pytest.mark.parametrize("order", ["mixed", "apart"])
def test_tied_nodes_of_many_copies_end_in_few_rounds(spark, monkeypatch, order):
    """Two unlike neighbours of 10,000 copies each: the rounds don't grow with copies."""
    a, b = "a" * 12, "a" * 9 + "bbb"
    texts = {a: 10_000, b: 10_000, "x" + a[1:]: 4, b[:-1] + "x": 4, "zz" + a[2:]: 3, "q" * 12: 2}
    ids = list(range(sum(texts.values())))
    if order == "mixed":
        random.Random(7).shuffle(ids)
    nodes, at = {}, 0
    for t, n in texts.items():
        nodes[t], at = ids[at : at + n], at + n
    differ = lambda s, t: sum(x != y for x, y in zip(s, t, strict=True))
    near = {s: [t for t in texts if s != t and differ(s, t) < 4] for s in texts}
    assert len(near[a]) != 0 and b in near[a] and set(near[a]) - {b} != set(near[b]) - {a}
    rounds = shared_rounds(monkeypatch)
    rows = spark.createDataFrame([("g", i, t) for t, own in nodes.items() for i in own], "group string, sample_id long, text string")
    assert scoring.diversity(rows, 4).first()["diversity"] == greedy(nodes, near)
    assert len(rounds) <= 10


def test_peeling_of_graphs_with_ties(spark):
    """Families of near texts with equal numbers of copies, so that ties of two, three and more unlike nodes abound."""
    rng = random.Random(11)
    rows, groups = [], {}
    for g in range(24):
        base = "abcdefgh"
        texts = list({"".join(rng.choice("xyz") if rng.random() < 0.35 else c for c in base) for _ in range(rng.randint(3, 7))})
        size = rng.choice([1, 3, 6])
        ids = rng.sample(range(500), size * len(texts))
        groups[f"g{g}"] = {t: ids[size * i : size * i + size - (rng.random() < 0.3 and size > 1)] for i, t in enumerate(texts)}
        rows += [(f"g{g}", i, t) for t, own in groups[f"g{g}"].items() for i in own]
    got = Counter({r["group"]: r["diversity"] for r in scoring.diversity(spark.createDataFrame(rows, "group string, sample_id long, text string"), 3).collect()})
    differ = lambda s, t: distance(s, t)
    for g, nodes in groups.items():
        near = {s: [t for t in nodes if s != t and differ(s, t) < 3] for s in nodes}
        assert got[g] == greedy(nodes, near), g


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]
