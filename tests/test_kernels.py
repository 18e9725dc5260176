"""Images by permutation and edit distances by machine words against plain versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.functions import edit, grams, grid, images
from gridspark.operators import neighbours


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def edited(rng, text, most):
    x = list(text)
    for _ in range(rng.randint(0, most)):
        r = rng.random()
        if r < 0.4 and x:
            x[rng.randrange(len(x))] = rng.choice("ab#éz")
        elif r < 0.7 and x:
            x.pop(rng.randrange(len(x)))
        else:
            x.insert(rng.randint(0, len(x)), rng.choice("ab#éz"))
    return "".join(x)


@pytest.mark.parametrize("pairs", [16_384, 7])
def test_nearest_distances_equal_the_plain_recurrence(monkeypatch, pairs):
    monkeypatch.setattr(edit, "PAIRS", pairs)
    rng = random.Random(1)
    for _ in range(150):
        cap, base = rng.choice([0, 1, 2, 5, 20, 31]), "".join(rng.choices("ab#é", k=rng.choice([0, 1, 3, 8, 30, 70, 140])))
        texts, queries = ([edited(rng, base, cap + 3) for _ in range(rng.randint(1, n))] for n in (12, 6))
        got = edit.nearest(iter([texts[:5], texts[5:]]), queries, cap, "#").tolist()
        assert got == [min(min(distance(q, t) for t in texts), cap + 1) for q in queries]


def test_far_pairs_end_early_and_close_ones_do_not():
    rng = random.Random(2)
    texts = ["".join(rng.choices("# $.@", k=109)) for _ in range(60)]
    queries = [edited(rng, t, 25) for t in texts[:20]] + ["".join(rng.choices("# $.@", k=109)) for _ in range(10)]
    got = edit.nearest(iter([texts[:25], [], texts[25:]]), queries, 20, "#").tolist()
    assert got == [min(min(distance(q, t) for t in texts), 21) for q in queries]


def test_nearest_edit_of_odd_texts(spark):
    rows = [(0, "#.#\n# #"), (1, "#.\n###"), (2, None), (3, ""), (4, "x" * 300), (5, "# #\n#.#"), (5, "# #\n#.#")]
    samples = spark.createDataFrame(rows, "sample_id long, text string")
    corpus = spark.createDataFrame([("# #\n#.#",), ("# #\n#.#",), (None,), ("x" * 280 + "y",)], "text string")
    for cap in (2, 20, 40):
        got = sorted(tuple(r) for r in neighbours.with_nearest(samples, corpus, cap, "plain", "sym").collect())
        known = ["# #\n#.#", "x" * 280 + "y"]
        least = lambda x, cap=cap: min(min(distance(x, t) for t in known), cap + 1)
        plain = [None if t is None else least(t) for _, t in rows]
        sym = [0, None, None, None, min(20, cap + 1), 0, 0]
        assert [r[2] for r in got] == plain and [r[3] for r in got] == sym
    nothing = spark.createDataFrame([], "text string")
    assert [r["nearest"] for r in neighbours.nearest_edit(samples.where("sample_id = 0"), nothing).collect()] == [21]
    assert neighbours.nearest_edit(samples.where("sample_id < 0"), corpus, symmetric=True).count() == 0


def test_near_pairs_of_all_lengths(spark):
    rng = random.Random(5)
    texts = {"", "#", "ab"}
    for _ in range(8):
        base = "".join(rng.choices("ab#", k=rng.choice([2, 4, 5, 9, 20, 60, 109])))
        texts |= {edited(rng, base, 6) for _ in range(9)}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for k in (1, 2, 5):
        got = {(r["a"], r["b"], r["distance"]) for r in neighbours.close_pairs(df, k).collect()}
        assert got == {(a, b, distance(a, b)) for a in texts for b in texts if a < b and distance(a, b) < k}
    assert neighbours.close_pairs(df.where("text = 'none'")).count() == 0


def test_pieces_are_disjoint_and_rare():
    rng = np.random.default_rng(3)
    for q, k, n in ((3, 4, 14), (1, 3, 3), (2, 5, 10)):
        cost = rng.integers(0, 9, (20, n - q + 1))
        starts = grams.rarest(cost, q, k)
        assert (np.diff(starts, axis=1) >= q).all() and starts.min() >= 0 and starts.max() <= n - q
        every = [c for c in itertools.combinations(range(n - q + 1), k) if all(b - a >= q for a, b in itertools.pairwise(c))]
        assert np.take_along_axis(cost, starts, axis=1).sum(axis=1).tolist() == [min(sum(row[i] for i in c) for c in every) for row in cost.tolist()]


def test_walls_of_a_third_of_the_texts_are_no_hot_task(spark, monkeypatch):
    """A third of the texts is walls but for a row, a few tiles of which differ; no task gets more than 3 % of the join's rows."""
    rng, wall = random.Random(6), "\n".join(["#" * 10] * 9)
    line = lambda: "".join(rng.choices("# $.", k=10))
    texts = {f"{wall[:33]}{line()}\n{wall[44:]}" for _ in range(400)} | {"\n".join(line() for _ in range(10)) for _ in range(800)}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    monkeypatch.setattr(neighbours, "KEY_PAIRS", 1000)
    settings = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in settings}
    try:
        for c, v in settings.items():
            spark.conf.set(c, v)
        rows = neighbours.met_pairs(df.toDF("ta"), df.toDF("tb"), 5, ordered=True)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(sizes) > 10_000 and max(sizes) <= 0.03 * sum(sizes)


def turned(text):
    rows = text.split("\n")
    if not rows[0] or any(len(r) != len(rows[0]) for r in rows):
        return None
    out = []
    for _ in range(4):
        out.append(rows)
        rows = ["".join(r[c] for r in reversed(rows)) for c in range(len(rows[0]))]
    return ["\n".join(r) for r in out] + ["\n".join(x[::-1] for x in r) for r in out]


TEXTS = ["", "\n", "a", "ab\ncd\nef", "ab\nc", "é1\n23\n4ñ", "é\n\n", "#.#\n##", "ab\n\ncd", "abc", "a\nb\nc", "日本\n語x", "ab\ncd\n", "\nab", "ab\ncd", "ba\ndc", "#" * 300 + "\n" + "." * 300]


def test_images_equal_the_plain_turns(spark):
    batch = pa.array(["skipped", None, *TEXTS]).slice(1)
    want = [None, *map(turned, TEXTS)]
    assert images.all_images(batch).to_pylist() == want
    assert images.least_image(batch).to_pylist() == [x and min(x) for x in want]
    for k in (None, -1, *range(9)):
        assert images.one_image(batch, pa.array([k] * len(batch), pa.int32())).to_pylist() == [x[k] if x and k in range(8) else None for x in want]
    none = pa.array([], pa.string())
    assert len(images.all_images(none)) == len(images.least_image(none)) == len(images.one_image(none, pa.array([], pa.int32()))) == 0
    df = spark.createDataFrame([(t,) for t in [None, *TEXTS]], "text string").select(grid.orbit(F.col("text")), grid.transform(F.col("text"), 5), grid.canonical(F.col("text")))
    assert [tuple(r) for r in df.collect()] == [(x, x and x[5], x and min(x)) for x in want]
