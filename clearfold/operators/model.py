"""Balanced elastic-net logistic regression with leak-free nested cross-validation.

Matrix rows are short vectors of small integers, so equal rows are common. They are
collapsed once to (row, label, slot, count), and every fit, median and score of the nested
cross-validation works on the collapsed table: exact, and read from memory.

The slot of a row encodes all its fold memberships. With ``r`` the row's rank within its
label in hash order, the outer fold is ``r mod k``, and within the training part of outer
fold ``f`` the row is at place ``r - (r + k - 1 - f) div k``, whose remainder by the inner
fold count is its inner fold. Both repeat with period ``k * inner``, so ``r mod (k * inner)``
is enough, and every fold of every part is balanced per label to within one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearfold.operators import batchfit, groupfit, sparsefit
from clearfold.operators.batchfit import MAX_COLUMNS, LinearModel, Part, fit_all, hits, rows_for
from clearfold.operators.matrix import (
    Scaler,
    align,
    categorical_columns,
    encode,
    encoded_columns,
    fit_vocabulary,
    join_labels,
    single_class_predictions,
    with_interactions,
)
from clearfold.operators.metrics import attach_features, attach_texts
from clearfold.operators.ordered import hash_rank
from clearfold.operators.profile import class_counts, label_index, safe_fold_counts
from clearfold.session import cut

# Grid, mix of the penalties, iteration cap and seed.
C_GRID = (0.01, 0.1, 1.0, 10.0)
L1_RATIO = 0.5
MAX_ITER = 5000
SEED = 42
TOL = 1e-6
PARALLEL_FITS = 8
RANGES = 64  # ranges of a column's values in which the rows of a slot are counted
ROWS_PER_PARTITION = 50_000  # collapsed rows one task of a fit works on

FULL = -1  # outer part that holds every row; inner part that holds its whole training part


@dataclass
class Fitted:
    """A fitted classifier with everything needed to score new records."""

    model: LinearModel
    columns: list[str]
    raw_columns: list[str]
    vocabulary: dict[str, list[str]]
    scaler: Scaler
    labels: list[str]
    c: float


@dataclass
class WideFitted:
    """A fitted classifier one of whose category columns has any number of values, which stay in a table.

    ``few`` is the model of all other matrix columns, among them values that very many rows have.
    The attributes of ``Fitted`` bring the table to the driver, up to ``sparsefit.MAX_VALUES`` rows of it.
    """

    few: Fitted
    wide: str
    table: DataFrame  # value, coefficient, mean, std, written

    def __post_init__(self):
        self.raw_columns, self.labels, self.c = self.few.raw_columns, self.few.labels, self.few.c

    @cached_property
    def _values(self) -> dict:
        rows = self.table.limit(sparsefit.MAX_VALUES + 1).collect()
        if len(rows) > sparsefit.MAX_VALUES:
            raise ValueError(f"more than {sparsefit.MAX_VALUES} category values; use the table")
        return {r["value"]: (r["coefficient"], r["mean"], r["std"]) for r in rows}

    @cached_property
    def vocabulary(self) -> dict[str, list[str]]:
        few = self.few.vocabulary
        return {c: few[c][:1] + sorted([*few[c][1:], *self._values]) if c == self.wide else few[c] for c in few}

    @cached_property
    def columns(self) -> list[str]:
        return _matrix_columns(self.raw_columns, self.vocabulary, _terms(self.few))

    def _column(self, name: str) -> tuple[float, float, float, float]:
        """Median, mean, spread and coefficient."""
        scaler = self.few.scaler
        if name in scaler.std:
            return scaler.median[name], scaler.mean[name], scaler.std[name], float(self.few.model.matrix[0, self.few.columns.index(name)])
        coefficient, mean, std = self._values[name[len(self.wide) + 1 :]]
        return 0.0, mean, std, coefficient

    @cached_property
    def scaler(self) -> Scaler:
        rows = {c: self._column(c) for c in self.columns}
        return Scaler(*[{c: r[i] for c, r in rows.items()} for i in range(3)])

    @cached_property
    def model(self) -> LinearModel:
        return LinearModel(np.array([self._column(c)[3] for c in self.columns]), self.few.model.bias)

    def values(self) -> DataFrame:
        """``feature, coefficient, std`` of the table's matrix columns."""
        return self.table.select(F.concat(F.lit(f"{self.wide}_"), "value").alias("feature"), "coefficient", "std")


@dataclass
class Evaluation:
    fold_scores: list[float]
    fitted: Fitted | WideFitted
    n_rows: int

    @property
    def mean(self) -> float:
        return float(np.mean(self.fold_scores))

    @property
    def std(self) -> float:
        return float(np.std(self.fold_scores))


def inner_place(slot: int, outer: int, k: int) -> int:
    return slot - (slot + k - 1 - outer) // k


class FoldLayout:
    """Which slots train and which score in every part of the nested cross-validation."""

    def __init__(self, outer: int, inner: int):
        self.outer, self.inner = outer, inner
        self.n_slots = outer * inner

    def train_slots(self, f: int, g: int = FULL) -> list[int]:
        return [s for s in range(self.n_slots) if self._in_outer(s, f) and (g == FULL or self._inner_of(s, f) != g)]

    def score_slots(self, f: int, g: int = FULL) -> list[int]:
        if g == FULL:
            return [s for s in range(self.n_slots) if f != FULL and s % self.outer == f]
        return [s for s in range(self.n_slots) if self._in_outer(s, f) and self._inner_of(s, f) == g]

    def parts(self) -> list[tuple[int, int]]:
        return [(f, g) for f in range(FULL, self.outer) for g in range(FULL, self.inner)]

    def _in_outer(self, s: int, f: int) -> bool:
        return f == FULL or s % self.outer != f

    def _inner_of(self, s: int, f: int) -> int:
        return (s if f == FULL else inner_place(s, f, self.outer)) % self.inner


def collapse(matrix: DataFrame, columns: Sequence[str], layout: FoldLayout, id_col: str = "id") -> DataFrame:
    """``columns, label_idx, slot, n``: equal rows of a slot as one row with their count."""
    ranked = hash_rank(matrix.select(id_col, "label_idx", *columns), ["label_idx"], id_col, SEED, "__rank")
    slotted = ranked.withColumn("slot", (F.col("__rank") % layout.n_slots).cast("int"))
    return slotted.groupBy(*columns, "label_idx", "slot").agg(F.count(F.lit(1)).alias("n"))


def part_statistics(collapsed: DataFrame, columns: Sequence[str], layout: FoldLayout) -> tuple[dict, dict]:
    """Scaler and class sizes of every training part.

    Counts and sums are taken per slot and column, and the parts, which overlap, are sums of
    their slots. Medians come from counts per slot in value ranges between approximate quantiles: they
    name the range in which a part's median lies, and only the values of such ranges are ranked,
    per part. Rows collected: slots x columns x ``RANGES``, and one per part and column.
    """
    parts = layout.parts()
    members = [layout.train_slots(f, g) for f, g in parts]
    sizes: dict = {part: {} for part in parts}
    for r in collapsed.groupBy("slot", "label_idx").agg(F.sum("n").alias("n")).collect():
        for part, slots in zip(parts, members):
            if r["slot"] in slots:
                sizes[part][r["label_idx"]] = sizes[part].get(r["label_idx"], 0) + r["n"]

    if not columns:
        return {part: Scaler({}, {}, {}) for part in parts}, sizes
    pairs = [F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    values = cut(collapsed.select("slot", "n", F.explode(F.array(*pairs)).alias("p")).groupBy("slot", "p.i", "p.v").agg(F.sum("n").alias("n")))
    known = values.where(F.col("v").isNotNull())
    ps = [k / RANGES for k in range(1, RANGES)]
    edges = {r["i"]: sorted(set(r["e"])) for r in known.groupBy("i").agg(F.percentile_approx("v", ps, 10 * RANGES).alias("e")).collect()}
    wide = F.lit([edges.get(i, []) + [float("inf")] * (RANGES - len(edges.get(i, []))) for i in range(len(columns))]) if columns else F.array(F.array(F.lit(0.0)))
    at = F.size(F.filter(F.element_at(wide, F.col("i") + 1), lambda x: x < F.col("v")))
    placed = values.withColumn("at", F.when(F.col("v").isNotNull(), at).otherwise(-1))

    sums = np.zeros((layout.n_slots, len(columns), 4))  # rows, known rows, sum, sum of squares
    held = np.zeros((layout.n_slots, len(columns), RANGES + 1))
    v, n = F.col("v"), F.col("n")
    for r in placed.groupBy("slot", "i", "at").agg(F.sum("n").alias("n"), F.sum(v * n).alias("s"), F.sum(v * v * n).alias("ss")).collect():
        seen = r["s"] is not None
        sums[r["slot"], r["i"]] += (r["n"], r["n"] if seen else 0, r["s"] or 0.0, r["ss"] or 0.0)
        if seen:
            held[r["slot"], r["i"], r["at"]] += r["n"]
    wanted = []
    for p, slots in enumerate(members):
        per_range = held[slots].sum(axis=0)
        for i in range(len(columns)):
            upto = np.cumsum(per_range[i])
            if upto[-1] > 0:
                for rank in {int(upto[-1] - 1) // 2, int(upto[-1]) // 2}:
                    at = int(np.searchsorted(upto, rank, side="right"))
                    wanted.append((p, i, at, rank - int(upto[at] - per_range[i][at])))
    medians: dict = {}
    if wanted:
        spark = collapsed.sparkSession
        ranks = F.broadcast(spark.createDataFrame(sorted(set(wanted)), "part int, i int, at int, rank bigint"))  # two per part and column
        of_part = F.element_at(F.lit([np.isin(np.arange(layout.n_slots), m).tolist() for m in members]), F.col("part") + 1)
        near = placed.where(F.col("v").isNotNull()).join(ranks.select("part", "i", "at").distinct(), ["i", "at"])
        counted = near.where(F.element_at(of_part, F.col("slot") + 1)).groupBy("part", "i", "at", "v").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("part", "i", "at").orderBy("v"))
        picked = counted.withColumn("upto", upto).join(ranks, ["part", "i", "at"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        for r in picked.groupBy("part", "i").agg(F.avg("v").alias("m")).collect():
            medians[(r["part"], r["i"])] = r["m"]
    scalers: dict = {}
    for p, (part, slots) in enumerate(zip(parts, members)):
        sc = scalers.setdefault(part, Scaler({}, {}, {}))
        for i, name in enumerate(columns):
            total_n, seen_n, s1, s2 = sums[slots, i].sum(axis=0)
            median = float(medians.get((p, i), 0.0))
            gaps = total_n - seen_n
            mean = (s1 + gaps * median) / total_n if total_n else 0.0
            var = max((s2 + gaps * median * median) / total_n - mean * mean, 0.0) if total_n else 0.0
            std = var**0.5 if var > 1e-12 * max(1.0, mean * mean) else 1.0
            sc.median[name], sc.mean[name], sc.std[name] = median, float(mean), float(std)
    return scalers, sizes


def fit_several_classes(rows: DataFrame, part: Part, c: float, total_weight: float) -> LinearModel:
    """Minimise ``c * sum(weight * loss) + penalty`` with an even L1/L2 mix by Spark's own optimiser.

    Spark minimises the weighted mean loss plus ``regParam`` times the penalty, hence
    ``regParam = 1 / (c * total weight)``. Columns are divided by their spread and not centred:
    the intercept is free of any penalty, so a shift of a column moves the intercept alone.
    """
    filled = F.zip_with("x", F.lit(part.fill.tolist()), lambda x, f: F.coalesce(x, f))
    features = F.zip_with(filled, F.lit(part.std.tolist()), lambda x, s: x / s)
    data = rows.where(F.element_at(F.lit(part.slots.tolist()), F.col("slot") + 1)).select(
        "label_idx", (F.col("n") * F.element_at(F.lit(part.weights.tolist()), F.col("label_idx") + 1)).alias("weight"), array_to_vector(features).alias("features")
    )
    lr = LogisticRegression(
        featuresCol="features", labelCol="label_idx", weightCol="weight", regParam=1.0 / (c * total_weight),
        elasticNetParam=L1_RATIO, maxIter=MAX_ITER, tol=TOL, standardization=False,
    )
    model = lr.fit(data)
    return LinearModel(model.coefficientMatrix.toArray(), model.interceptVector.toArray())


class NestedFit:
    """All fits of one collapsed matrix.

    Two classes and up to ``batchfit.MAX_COLUMNS`` columns: every part and every C is fitted in
    the same passes over the rows. Otherwise each is a fit of its own by Spark ML, and
    independent ones share a small thread pool.
    """

    def __init__(self, collapsed: DataFrame, columns: list[str], layout: FoldLayout):
        self.columns, self.layout = columns, layout
        self.scalers, self.sizes = part_statistics(collapsed, columns, layout)
        self.tasks = max(1, collapsed.count() // ROWS_PER_PARTITION)
        self.rows = rows_for(collapsed, columns).coalesce(self.tasks).persist()

    def unpersist(self) -> None:
        self.rows.unpersist()

    def _part(self, f: int, g: int) -> Part:
        scaler, sizes = self.scalers[(f, g)], self.sizes[(f, g)]
        flags = np.zeros(self.layout.n_slots, bool)
        flags[self.layout.train_slots(f, g)] = True
        total, k = sum(sizes.values()), len(sizes)
        weights = np.array([total / (k * sizes[i]) if i in sizes else 0.0 for i in range(max(sizes) + 1)])
        of = lambda values: np.array([values[c] for c in self.columns], float)
        return Part(flags, of(scaler.median), of(scaler.mean), of(scaler.std), weights)

    def train(self, jobs: Sequence[tuple[int, int, float]]) -> list[LinearModel | int]:
        """One model per (outer part, inner part, C), or the only class where the part has just one."""
        parts = {(f, g): self._part(f, g) for f, g, _ in jobs}
        done: list[LinearModel | int | None] = [next(iter(self.sizes[(f, g)])) if len(self.sizes[(f, g)]) < 2 else None for f, g, _ in jobs]
        todo = [i for i, m in enumerate(done) if m is None]
        if not todo:
            return done
        totals = {fg: float(sum(self.sizes[fg].values())) for fg in parts}
        two = all(max(s, default=0) <= 1 for s in self.sizes.values())
        if two and len(self.columns) <= MAX_COLUMNS:
            keys = list(parts)
            place = {fg: i for i, fg in enumerate(keys)}
            fitted = fit_all(self.rows, len(self.columns), [parts[k] for k in keys], [(place[jobs[i][:2]], jobs[i][2]) for i in todo], [totals[k] for k in keys], self.tasks)
        else:
            with ThreadPoolExecutor(PARALLEL_FITS) as pool:
                one = lambda i: fit_several_classes(self.rows, parts[jobs[i][:2]], jobs[i][2], totals[jobs[i][:2]])
                fitted = list(pool.map(one, todo))
        for i, model in zip(todo, fitted):
            done[i] = model
        return done

    def score(self, jobs: Sequence[tuple[int, int, float]], models: Sequence[LinearModel | int]) -> list[float]:
        """Accuracy of each job's model on the slots held out from its part, all in one pass."""
        tests = []
        for (f, g, _), model in zip(jobs, models):
            held = np.zeros(self.layout.n_slots, bool)
            held[self.layout.score_slots(f, g)] = True
            tests.append((held, self._part(f, g), model))
        return [hit / n if n else 0.0 for hit, n in hits(self.rows, tests)]

    def best_c(self, scores: dict[float, float]) -> float:
        """The best C; the smallest of equals."""
        return min(scores, key=lambda c: (-round(scores[c], 12), c))

    def scaler(self) -> Scaler:
        """Of all rows."""
        return self.scalers[(FULL, FULL)]

    def run(self, grid: Sequence[float] = C_GRID, outer: bool = True) -> tuple[list[float], LinearModel, float]:
        """(outer fold scores, model of all rows, its C).

        Where C has to be chosen, the fits on whole training parts are made for every C along with
        those of the inner parts, which costs no pass of its own.
        """
        outers = [FULL] + (list(range(self.layout.outer)) if outer else [])
        inner = range(self.layout.inner) if len(grid) > 1 else []
        jobs = [(f, g, c) for f in outers for g in (FULL, *inner) for c in grid]
        models = dict(zip(jobs, self.train(jobs)))
        tested = [j for j in jobs if j[0] != FULL or j[1] != FULL]
        scores = dict(zip(tested, self.score(tested, [models[j] for j in tested]))) if tested else {}
        chosen = {}
        for f in outers:
            means = {c: float(np.mean([scores[(f, g, c)] for g in inner])) for c in grid} if len(grid) > 1 else {grid[0]: 0.0}
            chosen[f] = self.best_c(means)
        return [scores[(f, FULL, chosen[f])] for f in outers if f != FULL], models[(FULL, FULL, chosen[FULL])], chosen[FULL]


class GroupedNestedFit(NestedFit):
    """The same fits of two classes where one category has any number of values and all other columns are few.

    Every part and every C is fitted in the same passes. ``terms`` may name values of the wide column.
    """

    def __init__(self, raw: DataFrame, raw_columns: Sequence[str], wide: str, first: str, narrow: dict[str, list[str]], layout: FoldLayout, terms: Sequence[tuple[str, str]] = ()):
        self.layout, self.raw_columns, self.wide = layout, list(raw_columns), wide
        often = [v for v in groupfit.often(raw, wide) if v != first]
        named = [t[len(wide) + 1 :] for pair in terms for t in pair if t.startswith(f"{wide}_") and t not in raw_columns]
        known = [r[0] for r in raw.where(F.col(wide).isin(named) & (F.col(wide) != first)).select(wide).distinct().collect()] if named else []
        self.vocabulary = {c: [first, *often] if c == wide else narrow[c] for c in raw_columns if c in narrow or c == wide}
        names, plain = _plain(raw, raw_columns, self.vocabulary | {wide: [first, *known]}, terms)
        cats = [(c, v) for c, values in self.vocabulary.items() for v in values[1:]]
        self.names = names + [f"{c}_{v}" for c, v in cats]
        dummies = [F.when(F.col(c) == v, F.lit(1)).otherwise(F.lit(0)) for c, v in cats]
        self.columns = [f"__d{i}" for i in range(len(self.names))]
        own = F.when(~F.col(wide).isin([first, *often]), F.col(wide)).alias("value")
        cells = raw.select("label_idx", "slot", "n", own, *[x.alias(c) for c, x in zip(self.columns, plain + dummies)])
        self.scalers, self.sizes = part_statistics(cells, self.columns, layout)
        self.tasks = max(1, raw.count() // groupfit.BLOCK)
        self.rows = groupfit.packed(rows_for(cells, self.columns, ["value"]), self.tasks)
        self.points: dict[tuple[int, int, float], np.ndarray] = {}

    def train(self, jobs: Sequence[tuple[int, int, float]]) -> list[LinearModel | int]:
        parts = {(f, g): self._part(f, g) for f, g, _ in jobs}
        todo = [j for j in jobs if len(self.sizes[j[:2]]) > 1]
        keys = list(dict.fromkeys(j[:2] for j in todo))
        if todo:
            points = groupfit.fit_all(
                self.rows, self.tasks, len(self.columns), [parts[k] for k in keys], [(keys.index(j[:2]), j[2]) for j in todo], [self._total(k) for k in keys]
            )
            self.points |= dict(zip(todo, points))
        return [batchfit.model_of(self.points[j], parts[j[:2]]) if j in self.points else next(iter(self.sizes[j[:2]])) for j in jobs]

    def _total(self, part: tuple[int, int]) -> float:
        return float(sum(self.sizes[part].values()))

    def score(self, jobs: Sequence[tuple[int, int, float]], models: Sequence[LinearModel | int]) -> list[float]:
        tests = []
        for (f, g, c), model in zip(jobs, models):
            held = np.zeros(self.layout.n_slots, bool)
            held[self.layout.score_slots(f, g)] = True
            tests.append((held, self._part(f, g), self._total((f, g)), c, self.points.get((f, g, c), model)))
        return [hit / n if n else 0.0 for hit, n in groupfit.hits(self.rows, self.tasks, tests)]

    def fitted(self, model: LinearModel, labels: list[str], c: float) -> WideFitted:
        """The fit of all rows at ``c`` with the written table of its values."""
        part, job = self._part(FULL, FULL), (FULL, FULL, c)
        table = cut(groupfit.coefficients(self.rows, part, self._total(job[:2]), c, self.points[job]))
        scaler = Scaler(*[dict(zip(self.names, values.tolist())) for values in (part.fill, part.mean, part.std)])
        return WideFitted(Fitted(model, self.names, self.raw_columns, self.vocabulary, scaler, labels, c), self.wide, table)


class SparseNestedFit(NestedFit):
    """The same fits where categories have many values: sparse rows, and Spark ML for every fit."""

    def __init__(self, raw: DataFrame, raw_columns: Sequence[str], vocabulary: dict[str, list[str]], layout: FoldLayout, terms: Sequence[tuple[str, str]] = ()):
        names, plain = _plain(raw, raw_columns, vocabulary, terms)
        self.layout, self.columns = layout, _matrix_columns(raw_columns, vocabulary, terms)
        self.plain = names
        numbers = raw.select("label_idx", "slot", "n", *[p.alias(c) for c, p in zip(names, plain)])
        self.scalers, self.sizes = part_statistics(numbers, names, layout)
        self.ordered = {c: vocabulary[c] for c in raw_columns if c in vocabulary}
        self.counts = sparsefit.value_counts(raw, self.ordered, layout.n_slots)
        self.tasks = max(1, raw.count() // ROWS_PER_PARTITION)
        rows = sparsefit.sparse_rows(raw, plain, self.ordered, ["label_idx", "slot", "n"])
        self.rows = rows.coalesce(self.tasks).persist(StorageLevel.MEMORY_AND_DISK)
        self.fits, self.models = sparsefit.SparseFits(self.rows, len(names)), {}

    def _part(self, f: int, g: int) -> Part:
        scaler, sizes = self.scalers[(f, g)], self.sizes[(f, g)]
        flags = np.zeros(self.layout.n_slots, bool)
        flags[self.layout.train_slots(f, g)] = True
        total, k = sum(sizes.values()), len(sizes)
        weights = np.array([total / (k * sizes[i]) if i in sizes else 0.0 for i in range(max(max(s, default=0) for s in self.sizes.values()) + 1)])
        share, deviation = sparsefit.spread(self.counts[flags].sum(axis=0), total)
        of = lambda values, more: np.concatenate([np.array([values[c] for c in self.plain], float), more])
        return Part(flags, of(scaler.median, np.zeros_like(share)), of(scaler.mean, share), of(scaler.std, deviation), weights)

    def train(self, jobs: Sequence[tuple[int, int, float]]) -> list[LinearModel | int]:
        todo = [j for j in jobs if len(self.sizes[j[:2]]) > 1]
        fitted = self.fits.fit_all([(self._part(f, g), c, float(sum(self.sizes[(f, g)].values()))) for f, g, c in todo])
        self.models = dict(zip(todo, fitted))
        return [sparsefit.linear(self.models[j]) if j in self.models else next(iter(self.sizes[j[:2]])) for j in jobs]

    def score(self, jobs: Sequence[tuple[int, int, float]], models: Sequence[LinearModel | int]) -> list[float]:
        tests = []
        for (f, g, c), model in zip(jobs, models):
            held = np.zeros(self.layout.n_slots, bool)
            held[self.layout.score_slots(f, g)] = True
            tests.append((held, self._part(f, g), self.models.get((f, g, c), model)))
        return self.fits.accuracy(tests)

    def scaler(self) -> Scaler:
        """Of all rows, over every matrix column."""
        part = self._part(FULL, FULL)
        return Scaler(*[dict(zip(self.columns, values.tolist())) for values in (part.fill, part.mean, part.std)])


def _factor(df: DataFrame, columns: Sequence[str], vocabulary: dict[str, list[str]], name: str) -> Column:
    """A single matrix column as an expression."""
    if name in columns and name not in vocabulary:
        return F.col(name).cast("int") if dict(df.dtypes)[name] == "boolean" else F.col(name)
    c, v = next((c, v) for c in columns if c in vocabulary for v in vocabulary[c][1:] if f"{c}_{v}" == name)
    return F.when(F.col(c) == v, F.lit(1)).otherwise(F.lit(0))


def _plain(df: DataFrame, columns: Sequence[str], vocabulary: dict[str, list[str]], terms: Sequence[tuple[str, str]]) -> tuple[list[str], list[Column]]:
    """Names and expressions of the plain matrix columns and of the products."""
    numbers = [c for c in columns if c not in vocabulary]
    names = numbers + [f"{a}__x__{b}" for a, b in terms]
    one = lambda name: _factor(df, columns, vocabulary, name)
    return names, [one(c) for c in numbers] + [one(a) * one(b) for a, b in terms]


def _matrix_columns(columns: Sequence[str], vocabulary: dict[str, list[str]], terms: Sequence[tuple[str, str]]) -> list[str]:
    """Matrix columns of a sparse fit: plain ones, products, then categories."""
    n = len([c for c in columns if c not in vocabulary])
    every = encoded_columns(columns, vocabulary)
    return every[:n] + [f"{a}__x__{b}" for a, b in terms] + every[n:]


def _is_wide(vocabulary: dict[str, list[str]]) -> bool:
    return sum(len(v) - 1 for v in vocabulary.values() if v) > MAX_COLUMNS


def _wide_column(df: DataFrame, columns: Sequence[str], sizes: dict[str, tuple[int, str]], n_classes: int, terms: Sequence = ()) -> str | None:
    """The category column for ``GroupedNestedFit``, if the fit needs and suits it."""
    own = {c: n - 1 for c, (n, _) in sizes.items()}
    if n_classes != 2 or sum(own.values()) <= MAX_COLUMNS:
        return None
    wide = max(own, key=lambda c: (own[c], c))
    rest = len(columns) - len(categorical_columns(df, columns)) + len(terms) + sum(own.values()) - own[wide]
    return wide if rest <= batchfit.MAX_COLUMNS else None


def _grouped(raw: DataFrame, columns: Sequence[str], sizes: dict[str, tuple[int, str]], wide: str, layout: FoldLayout, terms: Sequence[tuple[str, str]] = ()) -> GroupedNestedFit:
    narrow = fit_vocabulary(raw, [c for c in columns if c != wide])
    return GroupedNestedFit(raw, columns, wide, sizes[wide][1], narrow, layout, terms)


def _training_rows(features: DataFrame, labels: DataFrame | None, raw_columns: Sequence[str], label: str) -> DataFrame:
    rows = features if labels is None else join_labels(features, labels.select("id", label))
    return rows.select("id", *raw_columns, label).where(F.col(label).isNotNull())


def _index_of(names: Sequence[str], label: str) -> Column:
    return (F.array_position(F.lit(list(names)), F.col(label)) - 1).cast("int")


def fit_and_evaluate(
    features: DataFrame,
    labels: DataFrame | None,
    raw_columns: Sequence[str],
    label: str = "label",
    n_folds: int = 5,
    grid: Sequence[float] = C_GRID,
    outer: bool = True,
    terms: Sequence[tuple[str, str]] = (),
) -> Evaluation:
    """Nested cross-validation and final fit of records ``features`` against ``labels``.

    ``labels=None`` takes the label from ``features`` itself. Choice of C, imputation and
    scaling all happen inside each training part. The category vocabulary is that of the
    whole input: it only names columns, and one without a row in a training part gets
    coefficient 0 there.
    """
    rows = _training_rows(features, labels, raw_columns, label).persist(StorageLevel.MEMORY_AND_DISK)
    collapsed = nested = None
    try:
        names = [r[label] for r in label_index(rows, label).orderBy("label_idx").collect()]
        if len(names) < 2:
            raise ValueError("a classifier needs at least two classes")
        counts = safe_fold_counts(rows, label, n_folds).first()
        layout = FoldLayout(int(counts["outer_folds"]), int(counts["inner_folds"]))
        indexed = rows.withColumn("label_idx", _index_of(names, label))
        raw = collapse(indexed, raw_columns, layout).persist()
        collapsed = raw
        sizes = sparsefit.value_sizes(raw, raw_columns)
        wide = _wide_column(raw, raw_columns, sizes, len(names), terms)
        if wide is not None:
            nested = _grouped(raw, raw_columns, sizes, wide, layout, terms)
            scores, model, c = nested.run(grid, outer)
            return Evaluation(scores, nested.fitted(model, names, c), int(counts["n_rows"]))
        vocabulary = fit_vocabulary(raw, raw_columns, sparsefit.MAX_VALUES)
        if _is_wide(vocabulary):
            nested = SparseNestedFit(raw, raw_columns, vocabulary, layout, terms)
            columns = nested.columns
        else:
            columns = encoded_columns(raw_columns, vocabulary)
            matrix = encode(raw, raw_columns, vocabulary, ["label_idx", "slot", "n"])
            if terms:
                matrix = with_interactions(matrix, terms)
                columns = columns + [f"{a}__x__{b}" for a, b in terms]
            nested = NestedFit(matrix, columns, layout)
        scores, model, c = nested.run(grid, outer)
    finally:
        for held in (nested, collapsed, rows):
            if held is not None:
                held.unpersist()
    fitted = Fitted(model, columns, list(raw_columns), vocabulary, nested.scaler(), names, c)
    return Evaluation(scores, fitted, int(counts["n_rows"]))


def fit_fixed_c(
    features: DataFrame, labels: DataFrame | None, raw_columns: Sequence[str], label: str = "label", c: float = 1.0
) -> Fitted | WideFitted:
    """One fit at a given C on all rows, without cross-validation; the input is read once."""
    rows = _training_rows(features, labels, raw_columns, label)
    counted = rows.groupBy(*raw_columns, label).agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.lit(0)).persist()
    nested = None
    try:
        names = [r[label] for r in label_index(counted, label).orderBy("label_idx").collect()]
        if len(names) < 2:
            raise ValueError("a classifier needs at least two classes")
        indexed = counted.withColumn("label_idx", _index_of(names, label))
        sizes = sparsefit.value_sizes(counted, raw_columns)
        wide = _wide_column(counted, raw_columns, sizes, len(names))
        if wide is not None:
            nested = _grouped(indexed, raw_columns, sizes, wide, FoldLayout(1, 1))
            return nested.fitted(nested.train([(FULL, FULL, c)])[0], names, c)
        vocabulary = fit_vocabulary(counted, raw_columns, sparsefit.MAX_VALUES)
        if _is_wide(vocabulary):
            nested = SparseNestedFit(indexed, raw_columns, vocabulary, FoldLayout(1, 1))
        else:
            matrix = encode(indexed, raw_columns, vocabulary, ["label_idx", "slot", "n"])
            nested = NestedFit(matrix, encoded_columns(raw_columns, vocabulary), FoldLayout(1, 1))
        model = nested.train([(FULL, FULL, c)])[0]
    finally:
        for held in (nested, counted):
            if held is not None:
                held.unpersist()
    return Fitted(model, nested.columns, list(raw_columns), vocabulary, nested.scaler(), names, c)


def ablation(
    features: DataFrame,
    labels: DataFrame | None,
    raw_columns: Sequence[str],
    leave_out: Sequence[str],
    label: str = "label",
    n_folds: int = 5,
    grid: Sequence[float] = C_GRID,
) -> DataFrame:
    """Cross-validated accuracy of all features and without each of ``leave_out``, one by one.

    C is chosen from ``grid`` with all features and stays the same without one of them, so that
    rows differ in features only. Features whose coefficients are all zero are the usual
    candidates.
    """
    rows = []
    for gone in (None, *leave_out):
        kept = [c for c in raw_columns if c != gone]
        e = fit_and_evaluate(features, labels, kept, label, n_folds, grid)
        rows.append((gone, e.mean, e.std, e.fitted.c))
        grid = (e.fitted.c,)
    ddl = "left_out string, cv_accuracy double, cv_std double, c double"
    return features.sparkSession.createDataFrame(rows, ddl)


def zeroed_features(fitted: Fitted | WideFitted, threshold: float = 1e-6) -> list[str]:
    """Raw features none of whose matrix columns kept a coefficient."""
    if isinstance(fitted, WideFitted):
        alive = not fitted.table.where(F.abs("coefficient") > threshold).isEmpty()
        return [c for c in zeroed_features(fitted.few, threshold) if c != fitted.wide or not alive]
    size = np.abs(fitted.model.coefficientMatrix.toArray()).max(axis=0)
    alive = {c for c, s in zip(fitted.columns, size) if s > threshold}
    columns_of = {c: [f"{c}_{v}" for v in fitted.vocabulary[c][1:]] if c in fitted.vocabulary else [c] for c in fitted.raw_columns}
    return [c for c, mine in columns_of.items() if not alive & set(mine)]


def _filled(fitted: Fitted, name: str, value: Column) -> Column:
    scaler = fitted.scaler
    return F.coalesce(value.cast("double"), F.lit(float(scaler.median[name]))) / F.lit(float(scaler.std[name]))


def _terms(fitted: Fitted) -> list[tuple[str, str]]:
    """The products among the matrix columns."""
    own = set(encoded_columns(fitted.raw_columns, fitted.vocabulary))
    return [tuple(c.split("__x__", 1)) for c in fitted.columns if c not in own]


def _few(fitted: WideFitted, features: DataFrame) -> list[Column]:
    """Scaled matrix columns of the model without the values of its table."""
    few = fitted.few
    own = set(encoded_columns(few.raw_columns, few.vocabulary))
    terms = _terms(few)
    named = [t[len(fitted.wide) + 1 :] for pair in terms for t in pair if t not in own and t.startswith(f"{fitted.wide}_")]
    vocabulary = few.vocabulary | {fitted.wide: few.vocabulary[fitted.wide] + named}
    names, plain = _plain(features, few.raw_columns, vocabulary, terms)
    dummies = [_factor(features, few.raw_columns, few.vocabulary, c) for c in few.columns[len(names) :]]
    return [_filled(few, c, x) for c, x in zip(few.columns, plain + dummies)]


def _margins(fitted: Fitted | WideFitted, features: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``__z``, the margins of every record."""
    if isinstance(fitted, WideFitted):
        few, c = fitted.few, fitted.wide
        moves = fitted.table.where(F.col("coefficient") != 0).select(F.col("value").alias("__value"), (F.col("coefficient") / F.col("std")).alias("__move"))
        x, bias = _few(fitted, features), float(few.model.bias[0])
        z = F.aggregate(F.zip_with(F.array(*x), F.lit(few.model.matrix[0].tolist()), lambda a, w: a * w), F.lit(0.0), lambda acc, v: acc + v) if x else F.lit(0.0)
        found = features.join(moves, F.col(c) == F.col("__value"), "left")
        return found.select(*keep, F.array(z + F.lit(bias) + F.coalesce("__move", F.lit(0.0))).alias("__z"))
    if _is_wide(fitted.vocabulary):
        names, plain = _plain(features, fitted.raw_columns, fitted.vocabulary, _terms(fitted))
        scaled = [_filled(fitted, c, p) for c, p in zip(names, plain)]
        scale = np.array([fitted.scaler.std[c] for c in fitted.columns])
        ordered = {c: fitted.vocabulary[c] for c in fitted.raw_columns if c in fitted.vocabulary}
        return sparsefit.margins(features, scaled, ordered, fitted.model, scale, keep)
    matrix = encode(features, fitted.raw_columns, fitted.vocabulary, keep)
    if terms := _terms(fitted):
        matrix = with_interactions(matrix, terms)
    scaled = F.array(*[_filled(fitted, c, F.col(c)) for c in fitted.columns])
    return matrix.select(*keep, scaled.alias("__x")).select(*keep, fitted.model.margins(F.col("__x")).alias("__z"))


def _few_model(fitted: Fitted | WideFitted) -> LinearModel:
    """A model of the fit's classes that is on the driver."""
    return fitted.few.model if isinstance(fitted, WideFitted) else fitted.model


def predict(fitted: Fitted | WideFitted, features: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """``predicted_label`` and ``confidence``, the largest class probability, per record."""
    names = F.array(*[F.lit(n) for n in fitted.labels])
    shares = _few_model(fitted).shares(F.col("__z"))
    scored = _margins(fitted, features, keep)
    if len(fitted.labels) == 2:
        scored = scored.select(*keep, F.array(1 - shares, shares).alias("__p"))
    else:
        scored = scored.select(*keep, shares.alias("__p"))
    best = F.array_max("__p")
    return scored.select(
        *keep,
        F.element_at(names, F.array_position("__p", best).cast("int")).alias("predicted_label"),
        best.alias("confidence"),
    )


def optimality(fitted: Fitted | WideFitted, records: DataFrame, label: str = "label", tolerance: float = 1e-7) -> DataFrame:
    """``feature, coefficient, slope, limit, optimal`` of a two-class fit on the rows it was fitted on.

    ``slope`` is the derivative of the weighted mean loss with the L2 part of the penalty, from one
    aggregate over the rows. At the optimum it is the L1 limit against the sign of a coefficient
    that is not zero, within the limit for one that is, and zero for the intercept, which must
    hold as well for any column to count as optimal.
    """
    names, few = fitted.labels, fitted.few if isinstance(fitted, WideFitted) else fitted
    known = records.where(F.col(label).isNotNull())
    sizes = {r[label]: r["n"] for r in class_counts(known, label).collect()}
    total = float(sum(sizes.values()))
    weight = F.when(F.col(label) == names[1], total / (2 * sizes[names[1]])).otherwise(total / (2 * sizes[names[0]]))
    cats = [c for c in few.raw_columns if c in few.vocabulary]
    if isinstance(fitted, WideFitted):
        numbers = few.columns[: len(few.columns) - sum(len(few.vocabulary[c]) - 1 for c in cats)]
        scaled = _few(fitted, known)[: len(numbers)]
    else:
        numbers, plain = _plain(known, fitted.raw_columns, fitted.vocabulary, _terms(fitted))
        scaled = [_filled(fitted, c, p) for c, p in zip(numbers, plain)]
    xs = [F.struct(F.lit(c).alias("feature"), x.alias("x")) for c, x in zip(numbers, scaled)]
    xs += [F.struct(F.concat(F.lit(f"{c}_"), F.col(c)).alias("feature"), F.lit(1.0).alias("x")) for c in cats]
    xs.append(F.struct(F.lit("").alias("feature"), F.lit(1.0).alias("x")))  # the intercept; a missing category's cell has no name
    rows = _margins(fitted, known.select("*", F.array(*xs).alias("__xs"), weight.alias("__w")), (label, "__xs", "__w"))
    off = F.col("__w") * (_few_model(fitted).shares(F.col("__z")) - (F.col(label) == names[1]).cast("double"))
    cells = rows.select(off.alias("r"), F.inline("__xs"))
    sums = cut(cells.groupBy("feature").agg(F.sum(F.col("r") * F.col("x")).alias("s")))
    level = sums.where(F.col("feature") == "").select((F.abs(F.col("s") / total) <= tolerance).alias("level")).scalar()
    share = 0.5 / (fitted.c * total)
    known_columns = [(c, float(w), 1.0 if c in numbers else float(few.scaler.std[c])) for c, w in zip(few.columns, few.model.matrix[0])]
    columns = records.sparkSession.createDataFrame(known_columns, "feature string, coefficient double, std double")
    if isinstance(fitted, WideFitted):
        columns = columns.unionByName(fitted.values())
    slope = F.coalesce(F.col("s"), F.lit(0.0)) / F.col("std") / total + share * F.col("coefficient")
    rows = columns.join(sums, "feature", "left").select("feature", "coefficient", slope.alias("slope"), F.lit(share).alias("limit"), level.alias("level"))
    held = F.when(F.col("coefficient") == 0, F.abs("slope") <= F.col("limit") + tolerance).otherwise(
        F.abs(F.col("slope") + F.col("limit") * F.signum("coefficient")) <= tolerance
    )
    return rows.withColumn("optimal", held & F.col("level")).drop("level")


def coefficients(fitted: Fitted | WideFitted, features: DataFrame, class_index: int = 0) -> DataFrame:
    """``feature, coefficient`` of the second class against the first, or of one class of several."""
    if isinstance(fitted, WideFitted):
        return coefficients(fitted.few, features).unionByName(fitted.values().drop("std"))
    matrix = fitted.model.coefficientMatrix.toArray()
    values = matrix[0 if len(fitted.labels) == 2 else class_index]
    rows = [(n, float(v)) for n, v in zip(fitted.columns, values)]
    return features.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def detailed_predictions(fitted: Fitted, features: DataFrame, labels: DataFrame, texts: DataFrame, label: str = "label") -> DataFrame:
    """Predictions with labels, texts and the raw features as ``feat_`` columns."""
    scored = join_labels(predict(fitted, features), labels.select("id", F.col(label).alias("true_label")))
    scored = scored.withColumn("correct", F.col("true_label") == F.col("predicted_label"))
    return attach_features(attach_texts(scored, texts), features.select("id", *fitted.raw_columns))


def in_sample_predictions(
    features: DataFrame, labels: DataFrame, texts: DataFrame, raw_columns: Sequence[str], label: str = "label", c: float = 1.0
) -> DataFrame:
    """Detailed predictions of a plain fit on the very rows it was fitted on.

    Only rows with features, a label and a text take part; none at all is an error. Where
    they carry a single class there is nothing to fit, and that class is predicted.
    """
    rows = align(features, labels.select("id", label), texts.select("id", "text"), check=True)
    names = rows.where(F.col(label).isNotNull()).select(label).distinct().limit(2).collect()
    if len(names) < 2:
        only = single_class_predictions(rows.select("id", "text", label), label).withColumnRenamed(label, "true_label")
        return attach_features(only, rows.select("id", *raw_columns))
    fitted = fit_fixed_c(rows.select("id", *raw_columns, label), None, raw_columns, label, c)
    shown = [f"feat_{r}" for r in raw_columns]
    own = rows.select("*", *[F.col(r).alias(n) for r, n in zip(raw_columns, shown)]).where(F.col(label).isNotNull())
    scored = predict(fitted, own, ("id", label, "text", *shown)).withColumnRenamed(label, "true_label")
    return scored.withColumn("correct", F.col("true_label") == F.col("predicted_label"))
