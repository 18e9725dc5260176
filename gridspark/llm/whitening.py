"""Whitening by TSQR: no covariance is formed.

Vectors become whole numbers x = floor(256 * component). The fit list holds each distinct x once,
packed in the fewest bytes that hold all its entries, so that copies meet map-side. Sums are exact;
rows are centred as (n * x - sum) / n, with an exact numerator. Each task of the fit list keeps one
triangular factor R, folding in a batch at a time; the factors of FAN tasks are stacked and factored
again, level by level, until one is left. The right singular vectors of that R are the components, and
its squared singular values over n their eigenvalues.

Rows whose vector is null, empty or holds null or non-finite components are left out; a null id stays null.
Vectors of each length are whitened on their own. Repeated rows give repeated rows. With fewer
dimensions than components there are fewer rows; a component without variance (below the rounding of R,
as with one distinct vector) has no whitened values: null, and it doesn't count in identity_error, which is
null if none counts. Without any variance explained is null. Equal eigenvalues may share their plane in any way. `deviation` is
null where it exceeds a long. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import cut
from gridspark.llm.vectors import matrices

#: Factors that one task stacks.
FAN = 8
#: Beyond this a long may overflow.
LONG = 2.0**62
#: Rows that are multiplied at once.
ROWS = 4096


def whole(m: np.ndarray) -> np.ndarray:
    """floor(256 * m) as longs; what a long can't hold becomes the nearest long."""
    x = np.floor(256 * m)
    return np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64))


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest whole numbers that hold it, the width in front."""
    top = np.maximum(x.max(axis=1), ~x.min(axis=1))
    width = 1 << np.searchsorted([1 << 7, 1 << 15, 1 << 31], top, side="right")
    out = np.empty(len(x), object)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        data = x[rows].astype(f"<i{w}").view(np.uint8).reshape(len(rows), -1)
        out[rows] = [bytes([w]) + r.tobytes() for r in data]
    return out.tolist()


def unpacked(keys: pa.Array) -> Iterator[np.ndarray]:
    """The rows of packed, some thousand at a time."""
    for at in range(0, len(keys), ROWS):
        part = keys.slice(at, ROWS).to_pylist()
        for w in {k[0] for k in part}:
            yield np.frombuffer(b"".join(k[1:] for k in part if k[0] == w), f"<i{w}").reshape(sum(k[0] == w for k in part), -1).astype(np.int64)


def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, m in matrices(batch.column("embedding")):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), m.shape[1], np.int32)), pa.array(packed(whole(m)), pa.binary())], names=["dim", "x"])


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of rows and sum for each dimension."""
    n, total = 0, 0
    for batch in batches:
        for x in unpacked(batch.column("x")):
            n += len(x)
            safe = max(int(x.max()), -int(x.min())) < LONG / len(x)
            total = total + (x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.decimal128(38, 0)), pa.array(np.full(len(total), n))], names=["d", "s", "n"])


def numerator(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - s, exact."""
    most = n * max(int(x.max()), -int(x.min())) + max(abs(int(v)) for v in s)
    return n * x - s.astype(np.int64) if most < LONG else n * x.astype(object) - s


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    return numerator(x, n, s).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    away = numerator(x, n, s)
    if float(np.abs(away).max()) ** 2 * x.shape[1] < LONG:
        return (away * away).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (away.astype(object) ** 2).sum(axis=1)]


def triangular(stack: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(stack), mode="r")


def factor_row(node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])


def factors(n: int, s: np.ndarray):
    """A task's R, by number of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for x in unpacked(batch.column("x")):
                r = triangular([centred(x, n, s)] if r is None else [r, centred(x, n, s)])
        if r is not None:
            yield factor_row(TaskContext.get().partitionId(), r)

    return run


def merged(dim: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        stack = [np.frombuffer(r).reshape(-1, dim) for r in rows.sort_by("node").column("r").to_pylist()]
        return pa.Table.from_batches([factor_row(key[0].as_py(), triangular(stack))])

    return run


def last_factor(fit: DataFrame, dim: int, n: int, s: np.ndarray) -> np.ndarray:
    rs = cut(fit.mapInArrow(factors(n, s), "node long, r binary"))
    left = rs.agg(F.max("node")).first()[0] + 1
    while left > 1:
        rs = rs.groupBy(F.floor(F.col("node") / FAN).alias("to")).applyInArrow(merged(dim), "node long, r binary")
        left = -(-left // FAN)
    return np.frombuffer(rs.first()["r"]).reshape(-1, dim)


@dataclass
class Fit:
    """n distinct vectors with sums s; components as rows, their eigenvalues and shares of the trace."""

    n: int
    s: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column a component; not a number for one without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (centred(x, self.n, self.s) @ self.axes.T) / np.sqrt(self.values), np.nan)


def moments(model: Fit):
    """A task's sums of whitened values and of their products, over the fit list: (i, j, v), j = -1 for the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in unpacked(batch.column("x")):
                w = model.whitened(x)
                one += w.sum(axis=0)
                two += w.T @ w
        i, j = np.indices((k, k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array((j - 1).ravel().astype(np.int32)), pa.array(np.column_stack([one, two]).ravel())], names=["i", "j", "v"])

    return run


def fitted(fit: DataFrame, dim: int, components: int) -> Fit:
    """The components of the distinct packed vectors in fit (x), all of dim entries."""
    rows = fit.mapInArrow(sums, "d int, s decimal(38,0), n long").groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("d").collect()
    n, s = rows[0]["n"], np.array([int(r["s"]) for r in rows], object)
    _, sigma, axes = np.linalg.svd(last_factor(fit, dim, n, s), full_matrices=False)
    values = np.where(sigma > sigma[0] * dim * np.finfo(float).eps, sigma, 0) ** 2 / n
    trace, k = values.sum(), min(components, dim)
    # Fewer distinct vectors than components leave axes without variance.
    pad = lambda m: np.concatenate([m[:k], np.zeros((max(0, k - len(m)), *m.shape[1:]))])
    model = Fit(n, s, pad(axes), pad(values), [float(v / trace) if trace else None for v in pad(values)])
    sent = fit.mapInArrow(moments(model), "i int, j int, v double").groupBy("i", "j").agg((F.sum("v") / n).alias("v")).collect()
    table = np.zeros((k, k + 1))
    for i, j, v in sent:
        table[i, j + 1] = v
    live = np.flatnonzero(model.values > 0)
    mean, cov = table[live, 0], table[:, 1:][np.ix_(live, live)]
    model.error = float(np.abs(cov - np.outer(mean, mean) - np.eye(len(live))).max()) if len(live) else None
    return model


def projected(models: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in matrices(batch.column("embedding")):
                model = models[m.shape[1]]
                k, x = len(model.values), whole(m)
                if not len(x):
                    continue
                line = pa.array(np.repeat(np.arange(len(x)), k))
                whitened = pc.if_else(pa.array(np.tile(model.values > 0, len(x))), pa.array(model.whitened(x).ravel()), pa.scalar(None, pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(line), model.n)), pa.array(deviations(x, model.n, model.s), pa.int64()).take(line),
                     whitened, pa.array(model.explained * len(x), pa.float64()), pa.array([model.error] * len(line), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of vectors (vec_id, embedding) and component."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    fit = cut(rows.mapInArrow(keys, "dim int, x binary").distinct())
    models = {dim: fitted(fit.where(F.col("dim") == dim).select("x"), dim, components) for (dim,) in fit.select("dim").distinct().collect()}
    return rows.mapInArrow(projected(models), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
