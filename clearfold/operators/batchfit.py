"""Many balanced elastic-net logistic fits over the same rows, all of them in every pass.

A fit is a pair of a training part (which slots it holds, how its columns are filled, scaled
and its classes weighted) and a C. One pass over the rows sums loss, gradient and curvature of
every fit at once, in numpy inside the tasks; sums of tasks meet in two levels. The driver takes
one proximal Newton step for all fits together, by coordinate descent over small matrices, and
halves the steps that did not lower their objective. A handful of passes settles all parts of a
nested validation, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L1_RATIO = 0.5
TOLERANCE = 1e-11  # size of the subgradient of the mean loss at which a fit is settled
MAX_PASSES = 100
TIE = 1e-9  # a margin of two classes this near to 0 is 0, which goes to the first class
MAX_COLUMNS = 100  # matrix columns up to which a task sums a curvature matrix for every fit


@dataclass(frozen=True)
class Part:
    """Training part: a flag per slot, fill, mean and spread per column, weight per class."""

    slots: np.ndarray
    fill: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill, x) - self.mean) / self.std


class LinearModel:
    """Coefficients over columns divided by their spread, and intercepts; one row for two classes."""

    def __init__(self, coefficients: np.ndarray, intercepts: np.ndarray):
        self.matrix, self.bias = np.atleast_2d(coefficients), np.atleast_1d(intercepts)

    @property
    def coefficientMatrix(self) -> DenseMatrix:  # noqa: N802
        k, d = self.matrix.shape
        return DenseMatrix(k, d, self.matrix.ravel(order="F").tolist())

    @property
    def coefficients(self) -> DenseVector:
        if len(self.matrix) != 1:
            raise ValueError("several classes have a matrix of coefficients")
        return DenseVector(self.matrix[0])

    @property
    def intercept(self) -> float:
        return float(self.bias[0])

    def margins(self, features: Column) -> Column:
        """One margin per row of the matrix, over an array column of scaled features."""
        zero = F.lit(0.0)

        def margin(weights: np.ndarray, bias: float) -> Column:
            products = F.zip_with(features, F.lit(weights.tolist()), lambda x, w: x * w)
            return F.aggregate(products, zero, lambda acc, x: acc + x) + F.lit(float(bias))

        return F.array(*[margin(w, b) for w, b in zip(self.matrix, self.bias)])

    def probabilities(self, features: Column) -> Column:
        """Class probabilities, in the order of the label index; of two classes that of the second."""
        return self.shares(self.margins(features))

    def shares(self, z: Column) -> Column:
        """Class probabilities of an array of margins."""
        if len(self.matrix) == 1:
            m = F.when(F.abs(z[0]) > TIE, z[0]).otherwise(F.lit(0.0))
            return 1 / (1 + F.exp(-m))
        top = F.array_max(z)
        shifted = F.transform(z, lambda m: F.exp(m - top))
        return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x))


def rows_for(matrix: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``x, label_idx, slot, n, keep``: the matrix columns as one array."""
    x = F.array(*[F.col(c).cast("double") for c in columns]) if columns else F.array().cast("array<double>")
    return matrix.select(x.alias("x"), F.col("label_idx").cast("int").alias("label_idx"), F.col("slot").cast("int").alias("slot"), F.col("n").cast("double").alias("n"), *keep)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    return x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label_idx", "slot", "n"))


def _sums(part: Part, x, y, slot, n, points: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature at every point (intercept last), flat, one row per point."""
    inside = part.slots[slot]
    a = np.hstack([part.scaled(x[inside]), np.ones((int(inside.sum()), 1))])
    y, w = y[inside].astype(float), n[inside] * part.weights[y[inside]]
    z = a @ points.T
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
    loss = (w[:, None] * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
    gradient = (w[:, None] * (p - y[:, None])).T @ a
    bend = w[:, None] * p * (1 - p)
    curvature = np.stack([(a * bend[:, [j]]).T @ a for j in range(len(points))])
    return np.hstack([loss[:, None], gradient, curvature.reshape(len(points), -1)])


def _added(groups: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(g, float) for g in groups], axis=0).tobytes()


def _pass(rows: DataFrame, parts: Sequence[Part], points: dict[int, np.ndarray], tasks: int) -> dict[int, np.ndarray]:
    """Sums of every part that has points; tasks' sums are added per lane, then lanes."""
    width = {p: (len(x), 1 + x.shape[1] + x.shape[1] ** 2) for p, x in points.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            arrays = _arrays(batch)
            for p, at in points.items():
                held[p] = held.get(p, 0.0) + _sums(parts[p], *arrays, at)
        lane = TaskContext.get().partitionId() % max(1, int(tasks**0.5))
        for p, s in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "lane": pa.array([lane], pa.int32()), "sums": [s.tobytes()]})

    shape = "part int, lane int, sums binary"
    found = rows.mapInArrow(work, shape)
    if tasks > 1:
        add = lambda key, pdf: pd.DataFrame([(key[0], 0, _added(list(pdf["sums"])))], columns=["part", "lane", "sums"])
        found = found.groupBy("part", "lane").applyInPandas(add, shape).groupBy("part").applyInPandas(add, shape)
    return {r["part"]: np.frombuffer(bytes(r["sums"])).reshape(width[r["part"]]) for r in found.collect()}


def _shrink(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - by, 0.0)


def newton_steps(point: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """Minimiser of each fit's quadratic model with its penalties, by coordinate descent over all fits at once."""
    m, d = point.shape
    new, slope = point.copy(), gradient.copy()
    penal1, penal2 = np.repeat(l1[:, None], d, 1), np.repeat(l2[:, None], d, 1)
    penal1[:, -1] = penal2[:, -1] = 0.0
    diagonal = np.maximum(np.einsum("mii->mi", curvature), 1e-12)
    for _ in range(sweeps):
        largest = 0.0
        for j in range(d):
            want = diagonal[:, j] * new[:, j] - slope[:, j]
            moved = _shrink(want, penal1[:, j]) / (diagonal[:, j] + penal2[:, j]) - new[:, j]
            new[:, j] += moved
            slope += curvature[:, :, j] * moved[:, None]
            largest = max(largest, float(np.abs(moved).max()))
        if largest < 1e-12:
            break
    return new


def violation(point: np.ndarray, gradient: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Size of the least subgradient of each fit's objective; 0 at the optimum."""
    beta, g = point[:, :-1], gradient[:, :-1] + l2[:, None] * point[:, :-1]
    at_zero = np.maximum(np.abs(g) - l1[:, None], 0.0)
    size = np.where(beta != 0, np.abs(g + l1[:, None] * np.sign(beta)), at_zero)
    return np.maximum(size.max(axis=1, initial=0.0), np.abs(gradient[:, -1]))


def fit_all(rows: DataFrame, n_columns: int, parts: Sequence[Part], jobs: Sequence[tuple[int, float]], totals: Sequence[float], tasks: int = 1, tol: float = TOLERANCE) -> list[LinearModel]:
    """One model per (part, C) of ``jobs``, each minimising ``C * sum(weight * loss) + penalty``.

    ``rows`` is ``rows_for`` a binary problem, persisted or written; ``totals`` has the weight of
    each part. Objectives are divided by C times that weight, as a mean loss.
    """
    owner = np.array([p for p, _ in jobs])
    scale = np.array([c * totals[p] for p, c in jobs])
    weight = np.array([totals[p] for p, _ in jobs])
    l1, l2 = L1_RATIO / scale, (1 - L1_RATIO) / scale
    d = n_columns + 1
    point = np.zeros((len(jobs), d))
    best = np.full(len(jobs), np.inf)
    origin, step = point.copy(), np.zeros_like(point)
    live = np.ones(len(jobs), bool)
    for _ in range(MAX_PASSES):
        mine = {int(p): np.flatnonzero(live & (owner == p)) for p in np.unique(owner[live])}
        found = _pass(rows, parts, {p: point[i] for p, i in mine.items()}, tasks)
        index = np.concatenate(list(mine.values()))
        sums = np.vstack([found[p] for p in mine]) / weight[index][:, None]
        at = point[index]
        beta = at[:, :-1]
        value = sums[:, 0] + l1[index] * np.abs(beta).sum(1) + 0.5 * l2[index] * (beta**2).sum(1)
        gradient, curvature = sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(-1, d, d)
        lower = value <= best[index] + 1e-13 * np.abs(value)
        settled = lower & (violation(at, gradient, l1[index], l2[index]) <= tol)
        tiny = np.abs(step[index]).max(axis=1) < 1e-13
        live[index[settled | (tiny & np.isfinite(best[index]))]] = False
        back = index[~lower]
        step[back] /= 2
        point[back] = origin[back] + step[back]
        on = lower & live[index]
        i = index[on]
        best[i], origin[i] = value[on], at[on]
        if len(i):
            step[i] = newton_steps(at[on], gradient[on], curvature[on], l1[i], l2[i]) - at[on]
            point[i] = origin[i] + step[i]
        if not live.any():
            return [model_of(point[j], parts[owner[j]]) for j in range(len(jobs))]
    raise RuntimeError(f"{int(live.sum())} fits did not settle in {MAX_PASSES} passes")


def model_of(point: np.ndarray, part: Part) -> LinearModel:
    """The model over columns that are scaled but not centred."""
    return LinearModel(point[:-1], point[-1] - point[:-1] @ (part.mean / part.std))


def hits(rows: DataFrame, tests: Sequence[tuple[np.ndarray, Part, LinearModel | int]]) -> list[tuple[float, float]]:
    """(right rows, rows) of each test (slots, part whose filling and scaling counts, model or the only class), in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros((len(tests), 2))
        for batch in batches:
            x, y, slot, n = _arrays(batch)
            for t, (slots, part, model) in enumerate(tests):
                inside = slots[slot]
                if isinstance(model, int):
                    guess = np.full(int(inside.sum()), model)
                else:
                    z = (np.where(np.isnan(x[inside]), part.fill, x[inside]) / part.std) @ model.matrix.T + model.bias
                    guess = (z[:, 0] > TIE).astype(int) if z.shape[1] == 1 else z.argmax(axis=1)
                right[t] += (n[inside] * (guess == y[inside])).sum(), n[inside].sum()
        yield pa.RecordBatch.from_pydict({"t": pa.array(range(len(tests)), pa.int32()), "hit": right[:, 0], "n": right[:, 1]})

    sums = rows.mapInArrow(work, "t int, hit double, n double").groupBy("t").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    found = {r["t"]: (r["hit"], r["n"]) for r in sums.collect()}
    return [found.get(t, (0.0, 0.0)) for t in range(len(tests))]
