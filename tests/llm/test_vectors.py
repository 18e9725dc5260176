"""Operators on vectors against plain versions, over rows made to be awkward and over the smallest table."""

import math
import random
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import nearest, negatives, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"
NAN, INF = float("nan"), float("inf")


def awkward():
    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 0.2) for _ in range(16)]
    rows = [(i, vector(), rng.randrange(4)) for i in range(0, 400, 2)]
    # Ties, copies, opposite and scaled vectors, another length, lengths of one.
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(8)] + [(1100, [-x for x in rows[0][1]], 0), (1150, [4 * x for x in rows[0][1]], 0)]
    rows += [(1200 + 10 * i, [rng.gauss(0, 1) for _ in range(3)], i % 2) for i in range(20)] + [(1500, [0.5], 1), (1550, [-0.5], 1), (1551, [2.0], 0)]
    # No part: null, empty, zero, null or non-finite entries, no id. No label: only for hard negatives.
    rows += [(1600, None, 0), (1650, [], 0), (1700, [0.0] * 16, 0), (1750, [None] + [0.1] * 15, 0), (1800, [NAN] + [0.1] * 15, 1), (1850, [0.1, INF] * 8, 1), (None, vector(), 1), (1900, vector(), None), (-100, vector(), 2)]
    # Repeated rows: the same twice, and one id with two vectors.
    rows += [rows[0], rows[3], (50, vector(), 1), (8, vector(), 3)]
    rng.shuffle(rows)
    return [(*r, 0.5, "clash") for r in rows]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def single(x):
    return [float(np.float32(c)) for c in x]


def finite():
    return [(i, single(x), label) for i, x, label, *_ in awkward() if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]


def neighbours(k):
    data = [(i, x) for i, x, _ in finite() if any(x)]
    dot = lambda a, b: reduce(add, (p * q for p, q in zip(a, b, strict=True)), 0.0)
    out = set()
    for q in {i for i, _ in data if i % 50 == 0}:
        x = min(v for i, v in data if i == q)
        score = {}
        for i, v in data:
            if i != q and len(v) == len(x):
                score[i] = max(score.get(i, -2), dot(x, v) / (math.sqrt(dot(x, x)) * math.sqrt(dot(v, v))))
        out |= {(q, r, i, score[i]) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k], 1)}
    return out


def test_nearest(rows, empty):
    got = [tuple(r) for r in nearest.search(rows, rows.where("vec_id % 50 = 0")).collect()]
    assert len(got) == len(set(got))
    assert {r[:3] for r in got} == {r[:3] for r in neighbours(5)} and set(got) == neighbours(5)
    assert nearest.search(empty, empty).count() == 0
    assert nearest.search(rows, empty).count() == 0


def test_nearest_in_many_blocks_and_tiles(rows, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 700)
    monkeypatch.setattr(nearest, "TILE", 50)
    monkeypatch.setattr(nearest, "PAIRS", 3)
    assert {tuple(r) for r in nearest.search(rows, rows.where("vec_id % 50 = 0")).collect()} == neighbours(5)


def test_estimates_keep_to_their_bounds():
    """Codes of whole tables of vectors: few estimates leave their bound, and where there are close rows few others need an exact cosine."""
    rng = np.random.default_rng(1)
    for dim, most in ((2, 1), (16, 1), (64, 0.02), (400, 0.003)):
        x, q = rng.standard_normal((2000, dim)), nearest.units(rng.standard_normal((50, dim)))
        x[:250] = np.repeat(q, 5, axis=0) + 0.5 / math.sqrt(dim) * rng.standard_normal((250, dim))
        rows = pa.record_batch([pa.array(range(2000)), pa.array(x.tolist())], names=["vec_id", "embedding"])
        (coded,) = nearest.coded(iter([rows]))
        bits = np.frombuffer(b"".join(coded.column("code").to_pylist()), np.uint8).reshape(2000, -1)
        signs, a = np.unpackbits(bits, axis=1, count=dim) * 2.0 - 1, coded.column("a").to_numpy()
        estimate = (q @ nearest.rotation(dim)) @ signs.T / math.sqrt(dim) / a
        away = min(1, nearest.ERRORS / math.sqrt(dim - 1)) * np.sqrt(1 - a * a) / a + nearest.ROUNDING
        exact = q @ nearest.units(x).T
        assert (np.abs(estimate - exact) > away).mean() < 0.004
        assert (estimate + away >= np.sort(exact, axis=1)[:, -5:-4]).mean() <= most


def mined(data):
    whole = lambda v: [math.floor(256 * c) for c in v]
    data = [(i, whole(x), label) for i, x, label in data]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = set()
    for a in {i for i, _, _ in data if i % 100 == 0}:
        label, x = min((n, [c / 256 for c in v]) for i, v, n in data if i == a)
        x = [round(256 * c) for c in x]
        near, far = {}, {}
        for i, v, n in data:
            if i != a and n == label and len(v) == len(x):
                near[i] = max(near.get(i, -math.inf), dot(x, v))
        for p in sorted(near, key=lambda i: (-near[i], i))[:5]:
            far = {}
            for i, v, n in data:
                if n != label and len(v) == len(x) and 30 * near[p] <= 100 * dot(x, v) <= 90 * near[p]:
                    far[i] = max(far.get(i, -math.inf), dot(x, v))
            out |= {(a, p, r, i, near[p], far[i]) for r, i in enumerate(sorted(far, key=lambda i: (-far[i], i))[:10], 1)}
    return out


def test_hard_negatives(rows, empty, monkeypatch):
    want = mined([r for r in finite() if r[2] is not None])
    found = lambda: [tuple(r) for r in negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0")).collect()]
    got = found()
    assert set(got) == want and len(got) == len(want) > 100
    assert negatives.hard_negatives(empty, empty).count() == 0
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 300)
    monkeypatch.setattr(negatives, "TILE", 40)
    monkeypatch.setattr(negatives, "EXACT", 0.0)
    assert set(found()) == want


def test_products_beyond_doubles():
    a = np.array([[2.0**52 + 1, 1.0], [1.0, 1.0]])
    assert negatives.products(a, np.array([[1.0, -(2.0**52)]])).tolist() == [[1.0], [1 - 2.0**52]]
    assert negatives.products(a * 2.0**20, a).max() == negatives.MOST


def whitened(data, k):
    """The same from a covariance, with exact deviations."""
    out = []
    for dim in {len(x) for _, x in data}:
        mine = [(i, tuple(math.floor(256 * c) for c in x)) for i, x in data if len(x) == dim]
        fit = sorted({x for _, x in mine})
        n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        m = np.array(fit, float) - np.array([float(Fraction(v, n)) for v in s])
        values, axes = np.linalg.eigh(m.T @ m / n)
        for i, x in mine:
            for c in range(1, min(k, dim) + 1):
                w = float((np.array(x) - np.array(s) / n) @ axes[:, -c]) / math.sqrt(values[-c])
                out.append((i, c, n, sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True)), w, values[-c] / values.sum()))
    return out


def test_whitening(spark, rows, empty):
    data = [(i, single(x)) for i, x, *_ in awkward() if x and all(c is not None and math.isfinite(c) for c in x)]
    got, want = whitening.whiten(rows).collect(), whitened(data, 4)
    order = lambda r: (r[2], -1 if r[0] is None else r[0], r[3], r[1])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [tuple(r[:4]) for r in got] == [r[:4] for r in want]
    assert np.allclose([r["explained"] for r in got], [r[5] for r in want], rtol=1e-9)
    signs = {}
    for g, w in zip(got, want, strict=True):
        if abs(w[4]) > 1e-6:
            signs.setdefault((g["n"], g["component"]), set()).add(g["whitened"] * w[4] > 0)
        assert abs(abs(g["whitened"]) - abs(w[4])) < 1e-6
    assert all(len(s) == 1 for s in signs.values())
    assert all(0 <= r["identity_error"] < 1e-9 for r in got)
    assert whitening.whiten(empty).count() == 0


def test_whitening_without_variance_and_of_large_numbers(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, None)] * 4
    got = whitening.whiten(make([(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [0.5, 6.0])])).collect()
    assert {(r["whitened"] is None, r["explained"]) for r in got} == {(False, 1.0), (True, 0.0)} and {r["deviation"] for r in got} == {(3 * 256 * v - 9 * 256) ** 2 for v in (1, 2, 6)}
    got = whitening.whiten(make([(1, [1e15, 0.0]), (2, [-1e15, 0.5]), (3, [0.0, -0.5])])).collect()
    assert all(r["deviation"] is None or r["deviation"] == 128**2 * 9 for r in got) and {r["n"] for r in got} == {3}


def test_factors_merge_in_a_tree(spark, monkeypatch):
    """More tasks than one merge takes give the factor of all rows at once."""
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    x = rng.integers(-100, 100, (300, 6))
    fit = spark.createDataFrame([(k,) for k in whitening.packed(x)], "x binary").repartition(9)
    s = x.sum(axis=0).astype(object)
    r = whitening.last_factor(fit, 6, 300, s)
    centred = x - x.mean(axis=0)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, centred.T @ centred)
    wide = np.array([[1, -128], [127, 0], [128, 0], [2**40, -(2**62)]])
    assert [k[0] for k in whitening.packed(wide)] == [1, 1, 2, 8]
    assert sorted(map(tuple, np.concatenate(list(whitening.unpacked(pa.array(whitening.packed(wide))))).tolist())) == sorted(map(tuple, wide.tolist()))
