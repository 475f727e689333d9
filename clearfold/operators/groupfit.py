"""Elastic-net logistic fits with one category column of any number of values.

For given other coefficients the values of a category do not touch each other: the coefficient of
each is the minimum of a convex function of one number over the rows of that value. Rows are dealt
and packed once so that those of a value lie together; a pass solves every value inside its task and
sums up loss, gradient and curvature of what is left, a function of the few other coefficients, on
which the driver takes proximal Newton steps. Its curvature jumps where a value's coefficient becomes 0, so steps with more
or less of a cautious curvature are tried in the same pass, and the best one is gone. Nothing per value is kept between passes or comes
to the driver, and passes are few whatever the number of values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearfold.operators.batchfit import L1_RATIO, MAX_PASSES, TIE, TOLERANCE, Part, newton_steps, violation

BLOCK = 50_000  # rows packed together, or those of one value if these are more
SHARE = 64  # a value with more than one in so many rows is to be a column of its own
MIXES = (0.0, 0.003, 0.03, 0.3, 1.0)  # shares of the cautious curvature in the steps that a pass tries
SOLVE = 100  # steps to the coefficient of a value at most; halving alone would take 50
PACKED = "n_rows int, x binary, y binary, slot binary, n binary, value binary, names array<string>"


def often(rows: DataFrame, column: str) -> list[str]:
    """Values with so many rows that a task should not hold them all; ``SHARE`` at most."""
    least = max(BLOCK, rows.count() // SHARE)
    found = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return sorted(r[column] for r in found.collect())


def packed(rows: DataFrame, tasks: int) -> DataFrame:
    """``x, label_idx, slot, n, value`` in blocks, persisted; the rows of a value that is not null share a block."""
    key = F.when(F.col("value").isNotNull(), F.xxhash64("value")).otherwise(F.xxhash64("x", "label_idx", "slot"))
    dealt = rows.withColumn("__key", key).repartition(tasks, "__key").drop("__key").sortWithinPartitions("value")

    def block(held: pa.Table) -> pa.RecordBatch:
        n = held.num_rows
        held = held.combine_chunks()
        column = lambda c, kind: held[c].to_numpy().astype(kind).tobytes()
        x = pa.concat_arrays([c.flatten() for c in held["x"].chunks]).to_numpy(zero_copy_only=False).astype(float)
        value = pa.concat_arrays(held["value"].chunks).dictionary_encode()
        place = value.indices.fill_null(-1).to_numpy().astype(np.int32)
        cells = [n, x.tobytes(), column("label_idx", np.int8), column("slot", np.int32), column("n", float), place.tobytes(), value.dictionary.to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.string())])], names=[c.split()[0] for c in PACKED.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * BLOCK:
                table = pa.Table.from_batches(held)
                values = table["value"]
                last = values[-1].as_py()
                end = table.num_rows
                while last is not None and end and values[end - 1].as_py() == last:
                    end -= 1
                if end:
                    yield block(table.slice(0, end))
                    held = table.slice(end).to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    return dealt.mapInArrow(pack, PACKED).persist(StorageLevel.MEMORY_AND_DISK)


class Block:
    """Rows of one block, ordered by the place of their value in it; -1, which comes first, has no coefficient."""

    def __init__(self, row: dict):
        n = row["n_rows"]
        of = lambda c, kind: np.frombuffer(row[c], kind)
        self.x = of("x", float).reshape(n, len(row["x"]) // (8 * n))
        self.y, self.slot, self.n, self.value = of("y", np.int8), of("slot", np.int32), of("n", float), of("value", np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


class Inside:
    """The training rows of a part in a block."""

    def __init__(self, block: Block, part: Part, total: float):
        inside = part.slots[block.slot]
        self.a = design(part, block.x[inside])
        self.y = block.y[inside].astype(float)
        self.w = block.n[inside] * part.weights[block.y[inside]]
        value = block.value[inside]
        self.plain = int(np.searchsorted(value, 0))  # rows before the first value
        own = value[self.plain :]
        self.starts = np.flatnonzero(np.diff(own, prepend=-1))
        self.values = own[self.starts]
        self.sizes = np.diff(self.starts, append=len(own))
        share = self._per_value(block.n[inside][self.plain :]) / total
        spread = np.sqrt(share * (1 - share))
        self.share, self.std = share, np.where(spread > 1e-6, spread, 1.0)

    def _per_value(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.starts, axis=0) if len(self.starts) else np.zeros((0, *v.shape[1:]))

    def solved(self, point: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """What each value adds to the margin of its rows, at the least loss, and the margins of all rows."""
        z = self.a @ point
        k = self.plain
        add = minima(z[k:], self.y[k:], self.w[k:], self.starts, self.sizes, self.std, penalty)
        z[k:] += np.repeat(add, self.sizes)
        return add, z

    def sums(self, point: np.ndarray, penalty: float) -> np.ndarray:
        """Loss with the penalty of the values, gradient and curvature of it as a function of the other coefficients.

        A second curvature bounds the penalty of each value by a parabola, so that it also holds
        beyond the points at which values become 0.
        """
        add, z = self.solved(point, penalty)
        p = _share(z)
        u = add * self.std
        loss = (self.w * (np.logaddexp(0, z) - self.y * z)).sum() + penalty * (np.abs(u) + 0.5 * u * u).sum()
        gradient = (self.w * (p - self.y)) @ self.a
        bent = (self.w * p * (1 - p))[:, None] * self.a
        curvature = self.a.T @ bent
        moves = add != 0
        across = self._per_value(bent[self.plain :])[moves]  # its last column is the value's own curvature
        own = across[:, -1:] + penalty * self.std[moves, None] ** 2
        held = penalty * self.std[moves, None] / np.abs(add[moves, None])
        here = curvature - (across / own).T @ across
        wide = curvature - (across / (own + held)).T @ across
        return np.concatenate([[loss], gradient, here.ravel(), wide.ravel()])


def design(part: Part, x: np.ndarray) -> np.ndarray:
    return np.hstack([part.scaled(x), np.ones((len(x), 1))])


def _share(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def minima(z: np.ndarray, y: np.ndarray, w: np.ndarray, starts: np.ndarray, sizes: np.ndarray, std: np.ndarray, penalty: float) -> np.ndarray:
    """Per run of rows the ``t`` that minimises ``sum(w * loss(z + t)) + penalty * (|u| + u * u / 2)`` with ``u = std * t``.

    Exactly 0 where the slope at 0 is within the penalty. Elsewhere the root of an increasing
    function on one side of 0, by Newton steps that must stay between a lower and an upper bound,
    else by halving.
    """
    out = np.zeros(len(starts))
    if not len(starts):
        return out
    slope = np.add.reduceat(w * (_share(z) - y), starts)
    l1, l2 = penalty * std, penalty * std**2
    live = np.flatnonzero(np.abs(slope) > l1)
    sign = -np.sign(slope)
    rows = np.repeat(np.abs(slope) > l1, sizes)
    z, y = z * np.repeat(sign, sizes), np.where(np.repeat(sign, sizes) > 0, y, 1 - y)
    z, y, w, sizes, sign, l1, l2, slope = z[rows], y[rows], w[rows], sizes[live], sign[live], l1[live], l2[live], -np.abs(slope[live])
    starts = np.cumsum(sizes) - sizes
    if not len(live):
        return out
    pull = np.add.reduceat(w * y, starts)
    low, lowest = np.zeros(len(live)), np.minimum.reduceat(np.where(y > 0, z, np.inf), starts)
    high = np.minimum(np.log(pull / l1) - lowest, (-slope - l1) / l2) * (1 + 1e-12) + 1e-12
    t = np.minimum(high, 1.0) / 2
    for _ in range(SOLVE):
        p = _share(z + np.repeat(t, sizes))
        f = np.add.reduceat(w * (p - y), starts) + l1 + l2 * t
        df = np.add.reduceat(w * p * (1 - p), starts) + l2
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        want = t - f / df
        fits = (want >= low) & (want <= high)
        new = np.where(fits, want, (low + high) / 2)
        done = (fits & (np.abs(new - t) <= 1e-8 * (1 + t))) | (high - low <= 1e-14 * (1 + t))
        t = new
        if done.any():
            out[live[done]] = sign[done] * t[done]
            if done.all():
                return out
            on = ~done
            rows = np.repeat(on, sizes)
            z, y, w = z[rows], y[rows], w[rows]
            live, sizes, sign, l1, l2, low, high, t = (v[on] for v in (live, sizes, sign, l1, l2, low, high, t))
            starts = np.cumsum(sizes) - sizes
    out[live] = sign * t
    return out


class Search:
    """The way of one fit to its optimum: the best of some Newton steps, again and again."""

    def __init__(self, n_columns: int, l1: float, l2: float):
        self.l1, self.l2 = l1, l2
        self.tol = max(TOLERANCE, 1e-3 * l1)
        self.at, self.best = np.zeros(n_columns + 1), np.inf
        self.steps = [np.zeros(n_columns + 1)]

    def points(self) -> list[np.ndarray]:
        return [self.at + step for step in self.steps]

    def take(self, sums: np.ndarray) -> bool:
        """Go on from the means at ``points``; whether the fit is settled at ``at``."""
        d = len(self.at)
        seen = []
        for point, row in zip(self.points(), sums):
            beta, gradient = point[:-1], row[1 : 1 + d]
            value = row[0] + self.l1 * np.abs(beta).sum() + 0.5 * self.l2 * (beta**2).sum()
            off = violation(point[None], gradient[None], np.array([self.l1]), np.array([self.l2]))[0]
            seen.append((value, off, point, gradient, row[1 + d :].reshape(2, d, d)))
        least = min(seen, key=lambda s: s[1])
        if least[1] <= self.tol:
            self.at = least[2]
            return True
        low = min(s[0] for s in seen)
        if low > self.best + 1e-13 * abs(low):
            self.steps = [step / 8 for step in self.steps]
        else:
            alike = [s for s in seen if s[0] <= low + 1e-13 * abs(low)]
            self.best, _, self.at, gradient, (here, wide) = min(alike, key=lambda s: s[1])
            n = len(MIXES)
            several = lambda a: np.repeat(a[None], n, axis=0)
            curvature = np.stack([(1 - m) * here + m * wide for m in MIXES])
            ends = newton_steps(several(self.at), several(gradient), curvature, np.full(n, self.l1), np.full(n, self.l2))
            self.steps = list(ends - self.at)
        return max(float(np.abs(step).max()) for step in self.steps) < 1e-13


def fit_all(blocks: DataFrame, tasks: int, n_columns: int, parts: Sequence[Part], jobs: Sequence[tuple[int, float]], totals: Sequence[float]) -> list[np.ndarray]:
    """Coefficients of the columns of ``x`` and the intercept at the optimum of each (part, C), all fits in every pass."""
    searches = [Search(n_columns, L1_RATIO / (c * totals[p]), (1 - L1_RATIO) / (c * totals[p])) for p, c in jobs]
    live = list(range(len(jobs)))
    for _ in range(MAX_PASSES):
        todo: dict[int, list[tuple[np.ndarray, float]]] = {}
        for j in live:
            todo.setdefault(jobs[j][0], []).extend((at, L1_RATIO / jobs[j][1]) for at in searches[j].points())

        def of_block(block: Block, todo=todo) -> dict[int, np.ndarray]:
            held = {p: Inside(block, parts[p], totals[p]) for p in todo}
            return {p: np.stack([held[p].sums(*at) for at in todo[p]]).ravel() for p in todo}

        found = {p: sums.reshape(len(todo[p]), -1) / totals[p] for p, sums in _added(blocks, tasks, of_block).items()}
        left, taken = [], dict.fromkeys(todo, 0)
        for j in live:
            p, n = jobs[j][0], len(searches[j].steps)
            mine = found[p][taken[p] : taken[p] + n]
            taken[p] += n
            if not searches[j].take(mine):
                left.append(j)
        live = left
        if not live:
            return [s.at for s in searches]
    raise RuntimeError(f"{len(live)} fits did not settle in {MAX_PASSES} passes")


def _added(blocks: DataFrame, tasks: int, of_block: Callable[[Block], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all blocks per key; tasks add up theirs, about the square root of the tasks are added next."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for block in _blocks(batches):
            for p, sums in of_block(block).items():
                held[p] = held.get(p, 0.0) + sums
        for p, sums in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "sums": [sums.tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                held[p] = held.get(p, 0.0) + np.frombuffer(sums)
        for p, sums in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "sums": [sums.tobytes()]})

    shape = "part int, sums binary"
    found = blocks.drop("names").mapInArrow(work, shape)
    if tasks > SHARE:
        found = found.repartition(int(tasks**0.5)).mapInArrow(merge, shape)
    out: dict[int, np.ndarray] = {}
    for p, sums in sorted((r["part"], bytes(r["sums"])) for r in found.collect()):
        out[p] = out.get(p, 0.0) + np.frombuffer(sums)
    return out


def hits(blocks: DataFrame, tasks: int, tests: Sequence[tuple[np.ndarray, Part, float, float, np.ndarray | int]]) -> list[tuple[float, float]]:
    """(right rows, rows) of each test (slots, part, its weight, C, coefficients or the only class), in one pass.

    The values' coefficients are found anew from the part's training rows.
    """

    def of_block(block: Block) -> dict[int, np.ndarray]:
        out = {}
        for i, (slots, part, total, c, point) in enumerate(tests):
            held = slots[block.slot]
            if isinstance(point, int):
                guess = np.full(int(held.sum()), point)
            else:
                inside = Inside(block, part, total)
                add = np.zeros(int(block.value.max(initial=-1)) + 2)  # the last one is for rows without a value
                add[inside.values] = inside.solved(point, L1_RATIO / c)[0]
                guess = design(part, block.x[held]) @ point + add[block.value[held]] > TIE
            out[i] = np.array([(block.n[held] * (guess == block.y[held])).sum(), block.n[held].sum()])
        return out

    found = _added(blocks, tasks, of_block)
    return [(float(found[i][0]), float(found[i][1])) if i in found else (0.0, 0.0) for i in range(len(tests))]


def coefficients(blocks: DataFrame, part: Part, total: float, c: float, point: np.ndarray) -> DataFrame:
    """``value, coefficient, mean, std`` of every value with rows in the part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                inside = Inside(Block(row), part, total)
                add, _ = inside.solved(point, L1_RATIO / c)
                names = [row["names"][i] for i in inside.values]
                yield pa.RecordBatch.from_pydict({"value": pa.array(names, pa.string()), "coefficient": add * inside.std, "mean": inside.share, "std": inside.std})

    return blocks.mapInArrow(work, "value string, coefficient double, mean double, std double")
