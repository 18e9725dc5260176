"""Nearest texts of grids by the bound over rows, against the plain recurrence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import edit
from gridspark.functions.grid import canonical
from gridspark.operators import neighbours
from test_kernels import distance


def grid(cells, w):
    return "\n".join(cells[k : k + w] for k in range(0, len(cells), w))


def changed(rng, cells, letters, most):
    """Cells changed, or shifted along rows and over their ends, so that new lines need not match."""
    x = list(cells)
    for _ in range(rng.randint(0, most)):
        if rng.random() < 0.4:
            x[rng.randrange(len(x))] = rng.choice(letters)
        else:
            i, j = rng.randrange(len(x)), rng.randrange(len(x))
            x.insert(j, x.pop(i) if rng.random() < 0.5 else (x.pop(i), rng.choice(letters))[1])
    return "".join(x)


def shaped(rng, turn):
    w, h = rng.choice([1, 2, 3, 5, 8, 10, 12]), rng.choice([2, 3, 4, 7, 10, 16])
    letters = "# $.@é"[: rng.randint(2, 6)]
    base = "".join(rng.choices(letters, k=h * w))
    rows = lambda n: [grid(changed(rng, base, letters, rng.choice([0, 2, 5, 9])), w) for _ in range(n)]
    return w, h, rows(7), rows(5)


def test_grids_have_the_distances_of_the_plain_recurrence():
    rng = random.Random(7)
    for turn in range(40):
        w, h, texts, queries = shaped(rng, turn)
        cap = rng.choice([0, 1, 2, 5, 9, 20, 21, 31])
        texts += [t[:-1] for t in texts[:1]] + [t.replace("\n", "#", 1) for t in texts[1:2]]
        queries += [queries[0] + "#"] + [q.replace("\n", " ", 1) for q in queries[1:2]]
        got = edit.nearest(iter([texts[:4], texts[4:]]), queries, cap, "#").tolist()
        assert got == [min(min(distance(q, t) for t in texts), cap + 1) for q in queries]


def test_sums_of_row_costs_do_not_exceed_the_distance():
    rng = random.Random(8)
    for turn in range(60):
        w, h, texts, queries = shaped(rng, turn)
        a, b = (np.concatenate([rows for _, rows in edit.code_points(x)]) for x in (queries, texts))
        mine, theirs = (edit.coded_rows(x, h, w, (ord("#"), ord(" "))) for x in (a, b))
        costs = [edit.row_costs(mine[r][0], theirs[r][0], r, h, 255)[np.ix_(mine[r][1], theirs[r][1])] for r in range(h)]
        for i, q in enumerate(queries):
            for j, t in enumerate(texts):
                d = distance(q, t)
                if d <= 2 * w + 1:
                    assert sum(int(c[i, j]) for c in costs) <= edit.UNIT * d


def levels(rng, n):
    ring = lambda c: "\n".join(["#" * 10, *(f"#{c[8 * r : 8 * r + 8]}#" for r in range(8)), "#" * 10])
    return [ring("".join(rng.choices("######          $.", k=64))) for _ in range(n)]


def test_few_pairs_of_unlike_levels_are_stepped(monkeypatch):
    rng, stepped = random.Random(9), []
    texts, queries = levels(rng, 400), levels(rng, 100)
    within = edit.Steps.within
    monkeypatch.setattr(edit.Steps, "within", lambda self, query, *a: (stepped.append(len(query)), within(self, query, *a))[1])
    monkeypatch.setattr(edit, "least", None)
    got = edit.nearest(iter([texts]), queries + texts[:3], 20, "#").tolist()
    assert got[100:] == [0, 0, 0] and sum(stepped) < 0.1 * 400 * 103
    assert got[:20] == [min(min(distance(q, t) for t in texts), 21) for q in queries[:20]]


@pytest.mark.parametrize("start", [None, 3])
def test_limits_are_shared_within_groups(start):
    rng = random.Random(10)
    texts = levels(rng, 60)
    queries = [grid_near for t in texts[:6] for grid_near in (t, t.replace("$", ".", 1), levels(rng, 1)[0])]
    group, own = np.repeat(np.arange(6), 3), np.array([False, True, False] * 6)
    want = np.array([min(min(distance(q, t) for t in texts), 21) for q in queries])
    known = None if start is None else np.where(np.arange(18) % 3 == 0, 0, 21)
    got = edit.nearest(iter([texts[:20], texts[20:]]), queries, 20, "#", group, own, known)
    assert got[own].tolist() == want[own].tolist()
    assert got.reshape(6, 3).min(axis=1).tolist() == want.reshape(6, 3).min(axis=1).tolist()


def test_a_corpus_in_two_shares_and_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(11)
    known = levels(rng, 90)
    rows = list(enumerate([*known[:3], *(t.replace(" ", "#", 2) for t in known[3:8]), *levels(rng, 4), None, "#.\n#", "##\n#."]))
    samples, corpus = spark.createDataFrame(rows, "sample_id long, text string"), spark.createDataFrame([(t,) for t in [*known, "#\n#."]], "text string")
    run = lambda: sorted(map(tuple, neighbours.with_nearest(samples, corpus, 20, "plain", "sym").select("sample_id", "plain", "sym").collect()))
    whole = run()
    assert [r[1] for r in whole] == [None if t is None else min(min(distance(t, c) for c in [*known, "#\n#."]), 21) for _, t in rows]
    images = samples.select("sample_id", F.explode(neighbours.orbit(F.col("text"))).alias("text"), canonical(F.col("text")).alias("form"))
    each = neighbours.with_nearest(images, corpus, 20, "d", None).groupBy("sample_id").agg(F.min("d").alias("d")).collect()
    assert {r[0]: r[2] for r in whole if r[2] is not None} == dict(map(tuple, each))
    monkeypatch.setattr(neighbours, "FIRST_PAIRS", 1)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 4000)
    assert run() == whole
