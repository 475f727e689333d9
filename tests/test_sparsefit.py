import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfold.operators import model as md
from clearfold.operators import sparsefit
from clearfold.operators.matrix import encode, encoded_columns, fit_vocabulary

RAW = ["level", "flag", "town", "tongue"]
DDL = "id string, level int, flag boolean, town string, tongue string, label string"


def records(spark, n=600, towns=12, classes=("no", "yes")):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        town, level, flag = rng.randrange(towns), rng.randrange(1, 6), rng.random() < 0.4
        push = (town % 3) + level * 0.6 + rng.random() * 3
        rows.append((str(i), None if rng.random() < 0.1 else level, flag, None if rng.random() < 0.05 else f"t{town:05d}", rng.choice("ab"), classes[min(int(push * len(classes) / 8), len(classes) - 1)]))
    return spark.createDataFrame(rows, DDL)


@pytest.fixture
def always_sparse(monkeypatch):
    monkeypatch.setattr(md, "MAX_COLUMNS", 2)


def by_name(fitted):
    return {c: w for c, w in zip(fitted.columns, fitted.model.matrix[0])}


def test_same_fit_and_scores_as_the_dense_one(spark, monkeypatch):
    df = records(spark)
    terms = [("level", "flag"), ("level", "town_t00003")]
    dense = md.fit_and_evaluate(df, None, RAW, n_folds=2, grid=(0.1, 1.0), terms=terms)
    expected = {r.id: (r.predicted_label, r.confidence) for r in md.predict(dense.fitted, df).collect()}
    monkeypatch.setattr(md, "MAX_COLUMNS", 2)
    sparse = md.fit_and_evaluate(df, None, RAW, n_folds=2, grid=(0.1, 1.0), terms=terms)
    assert sparse.fitted.c == dense.fitted.c and sparse.fold_scores == pytest.approx(dense.fold_scores, abs=0.011)
    a, b = by_name(dense.fitted), by_name(sparse.fitted)
    assert set(a) == set(b) and all(abs(a[c] - b[c]) < 1e-4 for c in a)
    got = {r.id: (r.predicted_label, r.confidence) for r in md.predict(sparse.fitted, df).collect()}
    assert all(abs(got[i][1] - p) < 1e-4 for i, (_, p) in expected.items())
    assert all(got[i][0] == name for i, (name, p) in expected.items() if p > 0.501)
    assert all(r.optimal for r in md.optimality(sparse.fitted, df, tolerance=1e-5).collect())
    for c in dense.fitted.columns:
        assert sparse.fitted.scaler.std[c] == pytest.approx(dense.fitted.scaler.std[c]), c


def test_optimal_and_unseen_values(spark, always_sparse):
    df = records(spark)
    fitted = md.fit_fixed_c(df, None, RAW)
    rows = md.optimality(fitted, df, tolerance=1e-5).collect()
    assert len(rows) == len(fitted.columns) and all(r.optimal for r in rows)
    worse = md.Fitted(sparsefit.LinearModel(fitted.model.matrix + 0.05, fitted.model.bias), *[getattr(fitted, k) for k in ("columns", "raw_columns", "vocabulary", "scaler", "labels", "c")])
    assert not all(r.optimal for r in md.optimality(worse, df, tolerance=1e-5).collect())
    odd = spark.createDataFrame([("x", 2, True, "nowhere", "a", None), ("y", 2, True, "t00000", "a", None), ("z", None, None, None, None, None)], DDL)
    shown = {r.id: r.confidence for r in md.predict(fitted, odd).collect()}
    assert shown["x"] == shown["y"] and len(shown) == 3  # an unseen value is zero in every column, like the first one


def test_several_classes(spark, always_sparse):
    df = records(spark, classes=("a", "b", "c"))
    e = md.fit_and_evaluate(df, None, ["level", "town"], n_folds=2, grid=(1.0,))
    dense_columns = encoded_columns(["level", "town"], fit_vocabulary(df, ["level", "town"]))
    assert e.fitted.columns == dense_columns and e.fitted.model.matrix.shape == (3, len(dense_columns))
    preds = md.predict(e.fitted, df).join(df.select("id", "label"), "id")
    assert preds.where(F.col("predicted_label") == F.col("label")).count() / 600 > 0.6 and e.mean > 0.5


def test_cells_are_the_matrix(spark):
    df = records(spark, 50)
    vocabulary = fit_vocabulary(df, RAW)
    dense = encode(df, RAW, vocabulary).toPandas().set_index("id")
    expected = {(i, c, float(v)) for c in dense.columns for i, v in dense[c].items() if v is not None and v == v and v != 0}
    assert {tuple(r) for r in sparsefit.cells(df, RAW, vocabulary, ["id"]).collect()} == expected


def test_cells_of_more_values_than_a_fit_may_have(spark, monkeypatch):
    monkeypatch.setattr(sparsefit, "MAX_VALUES", 5)
    df = records(spark, 50).unionByName(spark.createDataFrame([("n", None, None, None, None, None)], DDL))
    expected = sorted(map(str, sparsefit.cells(df, RAW, fit_vocabulary(df, RAW), ["id"]).collect()))
    assert sorted(map(str, sparsefit.cells(df, RAW, sparsefit.value_tables(df, RAW), ["id"]).collect())) == expected
    none = df.withColumn("town", F.lit(None).cast("string"))
    assert sparsefit.cells(none, ["town"], sparsefit.value_tables(none, ["town"]), ["id"]).count() == 0


def test_ten_thousand_values_and_a_plan_of_constant_size(spark):
    sizes = []
    for n in (300, 10_001):
        df = spark.range(3 * n).select(
            F.col("id").cast("string").alias("id"), (F.col("id") % 5).cast("int").alias("level"), F.format_string("t%06d", F.col("id") % n).alias("town"),
            F.when((F.col("id") % n) % 2 == 0, "yes").otherwise("no").alias("label"),
        )
        fitted = md.fit_fixed_c(df, None, ["level", "town"], c=1.0)
        assert len(fitted.columns) == n and np.isfinite(fitted.model.matrix).all()
        scored = md.predict(fitted, df)
        sizes.append(len(scored._jdf.queryExecution().optimizedPlan().toString()))
        hits = scored.join(df.select("id", "label"), "id").where(F.col("predicted_label") == F.col("label")).count()
        assert hits > 0.99 * 3 * n
    assert sizes[1] < 1.1 * sizes[0]
