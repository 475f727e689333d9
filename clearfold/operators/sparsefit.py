"""Design rows, fits and scores for category columns with many values.

A category column of ``v`` values is one cell of a sparse vector, found by a join with the written
table of its values, so plans and generated code depend on the raw columns and not on ``v``. The
joins are left to Spark, which broadcasts a value table by its size. Scores need no vector: what a
row's values add to its margin comes from the same kind of join, over the values whose coefficient
is not zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearfold.operators.batchfit import L1_RATIO, LinearModel, Part
from clearfold.operators.matrix import categorical_columns
from clearfold.session import cut

MAX_VALUES = 200_000  # category values of a fit; their coefficients and counts are on the driver
MAX_ITER = 5000
TOL = 1e-9
PARALLEL_FITS = 8

Vocabulary = dict[str, list[str]]


def value_places(vocabulary: Vocabulary) -> list[tuple[str, str, int]]:
    """(column, value, place among all values that have a matrix column); the first value of a column has none."""
    pairs = [(c, v) for c, values in vocabulary.items() for v in values[1:]]
    return [(c, v, i) for i, (c, v) in enumerate(pairs)]


def value_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """``name, value, at`` of every value that has a matrix column, written, so that joins know its size."""
    rows = pd.DataFrame(value_places(vocabulary), columns=["name", "value", "at"])
    return cut(spark.createDataFrame(rows, "name string, value string, at int"))


def value_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, str]]:
    """Number of values and first value of every string column among ``columns`` that has any."""
    cats = categorical_columns(df, columns)
    if not cats:
        return {}
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in cats]))
    seen = df.select(pairs).where(F.col("value").isNotNull()).distinct()
    found = seen.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"))
    return {r["name"]: (r["n"], r["first"]) for r in found.collect()}


def value_tables(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """``value`` of every value that has a matrix column, as a written table per string column.

    The vocabulary of ``fit_vocabulary`` for any number of values: nothing of it but the first value of
    each column comes to the driver.
    """
    cats = categorical_columns(df, columns)
    if not cats:
        return {}
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in cats]))
    seen = cut(df.select(pairs).where(F.col("value").isNotNull()).distinct())
    firsts = {r["name"]: r["first"] for r in seen.groupBy("name").agg(F.min("value").alias("first")).collect()}
    return {c: cut(seen.where((F.col("name") == c) & (F.col("value") > F.lit(firsts.get(c)))).select("value")) for c in cats}


def look_up(df: DataFrame, table: DataFrame, columns: Sequence[str], out: str, value: str) -> DataFrame:
    """Add ``value`` of the row's entry of ``table`` per category column as ``out + column``; null where it has none."""
    for i, c in enumerate(columns):
        mine = table.where(F.col("name") == c).select(F.col("value").alias(f"__k{i}"), F.col(value).alias(f"{out}{c}"))
        df = df.join(mine, F.col(c) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return df


def cells(df: DataFrame, columns: Sequence[str], vocabulary: Vocabulary | dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    """``keep, name, value`` with one row per matrix cell that is not 0: the matrix of ``encode`` in long form.

    Plain columns give a row unless they are 0 or null; a category gives at most one. The
    vocabulary is that of ``fit_vocabulary`` or, for any number of values, of ``value_tables``.
    """
    types = dict(df.dtypes)
    cats = [c for c in columns if c in vocabulary]
    number = lambda c: F.col(c).cast("int") if types[c] == "boolean" else F.col(c)
    tables = [c for c in cats if isinstance(vocabulary[c], DataFrame)]
    found = df
    for i, c in enumerate(tables):
        mine = vocabulary[c].select(F.col("value").alias(f"__t{i}"), F.lit(1).alias(f"__at_{c}"))
        found = found.join(mine, F.col(c) == F.col(f"__t{i}"), "left").drop(f"__t{i}")
    if lists := [c for c in cats if c not in tables]:
        found = look_up(found, value_table(df.sparkSession, {c: vocabulary[c] for c in lists}), lists, "__at_", "at")
    parts = [F.struct(F.lit(c).alias("name"), number(c).cast("double").alias("value")) for c in columns if c not in vocabulary]
    parts += [F.struct(F.concat(F.lit(f"{c}_"), F.col(c)).alias("name"), F.when(F.col(f"__at_{c}").isNotNull(), 1.0).alias("value")) for c in cats]
    return found.select(*keep, F.inline(F.filter(F.array(*parts), lambda p: p["value"] != 0)))


def sparse_rows(df: DataFrame, plain: Sequence[Column], vocabulary: Vocabulary, keep: Sequence[str]) -> DataFrame:
    """``keep, x, cats``: plain columns as an array, categories as one sparse vector."""
    spark = df.sparkSession
    cats = [c for c, values in vocabulary.items() if len(values) > 1]
    found = look_up(df, value_table(spark, {c: vocabulary[c] for c in cats}), cats, "__at_", "at")
    first = {}
    for c, _, i in value_places({c: vocabulary[c] for c in cats}):
        first.setdefault(c, i)
    sizes = [len(vocabulary[c]) - 1 for c in cats]
    ats = [F.coalesce((F.col(f"__at_{c}") - first[c]).cast("double"), F.lit(float(n))).alias(f"__o{i}") for i, (c, n) in enumerate(zip(cats, sizes))]
    x = F.array(*[p.cast("double") for p in plain]) if plain else F.array().cast("array<double>")
    rows = found.select(*keep, x.alias("x"), *ats)
    ins, outs = [f"__o{i}" for i in range(len(cats))], [f"__v{i}" for i in range(len(cats))]
    largest = spark.createDataFrame([tuple(float(n - 1) for n in sizes)], ins)  # the encoder learns the sizes from it
    encoder = OneHotEncoder(inputCols=ins, outputCols=outs, handleInvalid="keep", dropLast=True).fit(largest)
    return VectorAssembler(inputCols=outs, outputCol="cats").transform(encoder.transform(rows)).select(*keep, "x", "cats")


def value_counts(raw: DataFrame, vocabulary: Vocabulary, n_slots: int) -> np.ndarray:
    """Rows per slot and category value with a matrix column; at most slots x ``MAX_VALUES`` numbers."""
    places = value_places(vocabulary)
    counts = np.zeros((n_slots, len(places)))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in vocabulary])
    seen = raw.select("slot", "n", F.inline(pairs)).groupBy("slot", "name", "value").agg(F.sum("n").alias("n"))
    held = seen.join(value_table(raw.sparkSession, vocabulary), ["name", "value"]).select("slot", "at", "n").toPandas()
    counts[held["slot"].to_numpy(int), held["at"].to_numpy(int)] = held["n"].to_numpy(float)
    return counts


def spread(counts: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of 0/1 columns with ``counts`` ones; a constant one is divided by 1."""
    share = counts / total if total else counts
    deviation = np.sqrt(share * (1 - share))
    return share, np.where(deviation > 1e-6, deviation, 1.0)


class SparseFits:
    """Fits of ``x, cats`` rows by Spark ML, each over the slots of its part."""

    def __init__(self, rows: DataFrame, n_plain: int):
        self.rows, self.n_plain = rows, n_plain

    def _features(self, part: Part, slots: np.ndarray) -> DataFrame:
        """Rows of ``slots``, filled and divided as in the part, with ``features``."""
        inside = self.rows.where(F.element_at(F.lit(slots.tolist()), F.col("slot") + 1))
        weight = F.col("n") * F.element_at(F.lit(part.weights.tolist()), F.col("label_idx") + 1)
        filled = F.zip_with("x", F.lit(part.fill[: self.n_plain].tolist()), lambda x, f: F.coalesce(x, f))
        plain = array_to_vector(filled) if self.n_plain else None
        inside = inside.select("label_idx", "n", weight.alias("weight"), "cats", *([plain.alias("plain")] if self.n_plain else []))
        joined = VectorAssembler(inputCols=["plain", "cats"] if self.n_plain else ["cats"], outputCol="all").transform(inside)
        return ElementwiseProduct(scalingVec=Vectors.dense(1 / part.std), inputCol="all", outputCol="features").transform(joined)

    def fit(self, part: Part, c: float, total_weight: float) -> LogisticRegressionModel:
        """Minimise ``c * sum(weight * loss) + penalty`` with an even L1/L2 mix."""
        lr = LogisticRegression(
            featuresCol="features", labelCol="label_idx", weightCol="weight", regParam=1.0 / (c * total_weight),
            elasticNetParam=L1_RATIO, maxIter=MAX_ITER, tol=TOL, standardization=False,
        )
        return lr.fit(self._features(part, part.slots))

    def fit_all(self, jobs: Sequence[tuple[Part, float, float]]) -> list[LogisticRegressionModel]:
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            return list(pool.map(lambda job: self.fit(*job), jobs))

    def accuracy(self, tests: Sequence[tuple[np.ndarray, Part, LogisticRegressionModel | int]]) -> list[float]:
        """Share of right rows on the slots of each test."""

        def one(test) -> float:
            slots, part, model = test
            rows = self._features(part, slots)
            guess = F.lit(float(model)) if isinstance(model, int) else F.col("prediction")
            scored = rows if isinstance(model, int) else model.transform(rows)
            got = scored.agg(F.sum(F.when(guess == F.col("label_idx"), F.col("n"))).alias("hit"), F.sum("n").alias("n")).first()
            return (got["hit"] or 0.0) / got["n"] if got["n"] else 0.0

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            return list(pool.map(one, tests))


def linear(model: LogisticRegressionModel) -> LinearModel:
    return LinearModel(model.coefficientMatrix.toArray(), model.interceptVector.toArray())


def margins(df: DataFrame, plain: Sequence[Column], vocabulary: Vocabulary, model: LinearModel, scale: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``__z``, one margin per row of the model's matrix.

    ``plain`` holds the scaled plain columns; ``scale`` the spread of every matrix column. Values
    with no coefficient are left out of the join's table.
    """
    n = len(plain)
    weights = model.matrix / scale
    used = [(c, v, weights[:, n + i].tolist()) for c, v, i in value_places(vocabulary) if weights[:, n + i].any()]
    cats = sorted({c for c, _, _ in used})
    if used:
        table = cut(df.sparkSession.createDataFrame(pd.DataFrame(used, columns=["name", "value", "w"]), "name string, value string, w array<double>"))
        df = look_up(df, table, cats, "__w_", "w")
    total = []
    for k, bias in enumerate(model.bias):
        z = F.lit(float(bias))
        for j, p in enumerate(plain):
            z = z + p * F.lit(float(model.matrix[k, j]))
        for c in cats:
            z = z + F.coalesce(F.col(f"__w_{c}")[k], F.lit(0.0))
        total.append(z)
    return df.select(*keep, F.array(*total).alias("__z"))
