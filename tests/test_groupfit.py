import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfold.operators import groupfit, sparsefit
from clearfold.operators import model as md

DDL = "id string, level int, tongue string, town string, label string"


def records(spark, n=400, towns=30):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        town = 0 if rng.random() < 0.3 else rng.randrange(towns)
        push = (town % 3) + rng.randrange(1, 6) * 0.6 + rng.random() * 3
        rows.append((str(i), None if rng.random() < 0.1 else rng.randrange(1, 6), rng.choice("abc"), None if rng.random() < 0.1 else f"t{town:03d}", "yes" if push > 4 else "no"))
    return spark.createDataFrame(rows, DDL)


RAW = ["level", "tongue", "town"]


@pytest.fixture
def always_wide(monkeypatch):
    monkeypatch.setattr(md, "MAX_COLUMNS", 2)


def test_more_values_than_the_driver_may_have(spark, always_wide, monkeypatch):
    df = records(spark)
    dense = None
    with monkeypatch.context() as m:
        m.setattr(md, "MAX_COLUMNS", 100)
        dense = md.fit_fixed_c(df, None, RAW)
        expected = {r.id: r.confidence for r in md.predict(dense, df).collect()}
    monkeypatch.setattr(sparsefit, "MAX_VALUES", 5)  # the fit was an error above it
    fitted = md.fit_fixed_c(df, None, RAW)
    got = {r.id: r.confidence for r in md.predict(fitted, df).collect()}
    assert all(abs(got[i] - p) < 1e-6 for i, p in expected.items()) and len(got) == len(expected)
    shown = {r.feature: r.coefficient for r in md.coefficients(fitted, df).collect()}
    assert set(shown) == set(dense.columns)
    assert all(abs(shown[c] - w) < 1e-6 for c, w in zip(dense.columns, dense.model.matrix[0]))
    checked = md.optimality(fitted, df, tolerance=1e-6).collect()
    assert len(checked) == len(dense.columns) and all(r.optimal for r in checked)
    assert md.zeroed_features(fitted) == md.zeroed_features(dense)
    with pytest.raises(ValueError):
        fitted.columns


def test_many_tasks_and_frequent_values(spark, always_wide, monkeypatch):
    df = records(spark)
    expected = md.fit_fixed_c(df, None, RAW)
    monkeypatch.setattr(groupfit, "BLOCK", 15)
    fitted = md.fit_fixed_c(df, None, RAW)
    assert fitted.few.vocabulary["town"][1:] == [] and fitted.columns == expected.columns
    fine = df.withColumn("level", F.col("id").cast("int"))
    monkeypatch.setattr(groupfit, "BLOCK", 5)
    often = md.fit_fixed_c(fine, None, RAW)
    assert len(often.few.vocabulary["town"]) > 1 and often.table.count() + len(often.few.vocabulary["town"]) == 30
    monkeypatch.setattr(groupfit, "BLOCK", 50_000)
    rare = md.fit_fixed_c(fine, None, RAW)
    assert len(rare.few.vocabulary["town"]) == 1
    for a, b in ((fitted, expected), (often, rare)):
        assert a.columns == b.columns and np.allclose(a.model.matrix, b.model.matrix, atol=1e-6)


def test_passes_do_not_grow_with_the_values(spark, monkeypatch):
    passes = []
    real = groupfit._added
    monkeypatch.setattr(groupfit, "_added", lambda *a: passes.append(1) or real(*a))
    for n in (200, 4000):
        df = spark.range(10 * n).select(
            F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("int").alias("level"), F.format_string("t%06d", F.col("id") % n).alias("town"),
            F.when((F.col("id") % 7) + 2 * ((F.col("id") % n) % 3) + (F.hash("id") % 3) > 5, "yes").otherwise("no").alias("label"),
        )
        passes.clear()
        fitted = md.fit_fixed_c(df, None, ["level", "town"])
        assert len(passes) <= 40
        limit = 0.5 / (10 * n)
        assert all(r.optimal for r in md.optimality(fitted, df, tolerance=0.01 * limit).collect())


def test_only_a_wide_category(spark, always_wide):
    df = records(spark)
    fitted = md.fit_fixed_c(df, None, ["town"])
    assert all(r.optimal for r in md.optimality(fitted, df, tolerance=1e-6).collect())


def test_minima_are_least():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 6, 200)
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    z, y, w, std = rng.normal(0, 4, n), rng.integers(0, 2, n).astype(float), rng.random(n) * 3, rng.random(200) * 0.2 + 1e-3
    found = groupfit.minima(z, y, w, starts, sizes, std, 0.5)

    def value(t):
        at = z + np.repeat(t, sizes)
        u = t * std
        return np.add.reduceat(w * (np.logaddexp(0, at) - y * at), starts) + 0.5 * (np.abs(u) + 0.5 * u * u)

    assert (found == 0).any() and (found != 0).any()
    for by in (1e-4, 1e-2, 1.0):
        assert (value(found) <= value(found + by) + 1e-12).all() and (value(found) <= value(found - by) + 1e-12).all()
