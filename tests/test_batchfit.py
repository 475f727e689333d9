"""The batched fits against Spark ML's single ones, over tasks, and by the optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfold.operators import batchfit as bf
from clearfold.operators import model as md


def collapsed(spark, n=400, seed=3, gaps=True):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(1, 6, n), rng.integers(1, 4, n), rng.random(n)
    y = (a - 1.5 * b + 2 * c + rng.normal(0, 1.2, n) > 1).astype(int)
    rows = [(float(a[i]) if not gaps or i % 9 else None, float(b[i]), float(c[i]), 1.0, int(y[i]), i % 6, int(1 + i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, still double, label_idx int, slot int, n bigint").cache()


COLUMNS = ["a", "b", "c", "still"]


@pytest.fixture(scope="module")
def nested(spark):
    fit = md.NestedFit(collapsed(spark), COLUMNS, md.FoldLayout(3, 2))
    yield fit
    fit.unpersist()


def test_all_parts_equal_single_fits(nested):
    jobs = [(f, g, c) for f in (md.FULL, 0, 2) for g in (md.FULL, 1) for c in (0.01, 0.1, 1.0, 10.0)]
    together = nested.train(jobs)
    for (f, g, c), mine in zip(jobs, together):
        if c in (0.1, 10.0):
            single = md.fit_several_classes(nested.rows, nested._part(f, g), c, float(sum(nested.sizes[(f, g)].values())))
            assert np.abs(single.matrix - mine.matrix).max() < 1e-4 * max(1.0, np.abs(mine.matrix).max()) and abs(single.intercept - mine.intercept) < 2e-3
    assert all(m.matrix[0][3] == 0 for m in together)


def test_tasks_do_not_matter(nested):
    jobs = [(md.FULL, md.FULL, 1.0), (1, 0, 0.1)]
    one = nested.train(jobs)
    parts = [nested._part(f, g) for f, g, _ in jobs]
    totals = [float(sum(nested.sizes[(f, g)].values())) for f, g, _ in jobs]
    many = bf.fit_all(nested.rows.repartition(7), 4, parts, [(0, 1.0), (1, 0.1)], totals, tasks=7)
    for a, b in zip(one, many):
        assert np.abs(a.matrix - b.matrix).max() < 1e-8


def test_wide_matrices_go_one_by_one(nested, monkeypatch):
    want = nested.train([(md.FULL, md.FULL, 1.0)])[0]
    monkeypatch.setattr(md, "MAX_COLUMNS", 2)
    assert np.abs(nested.train([(md.FULL, md.FULL, 1.0)])[0].matrix - want.matrix).max() < 1e-3


def test_hits_equal_a_count(nested):
    jobs = [(f, md.FULL, 1.0) for f in range(3)]
    models = nested.train(jobs)
    scores = nested.score(jobs, models)
    rows = nested.rows.collect()
    for (f, g, _), model, score in zip(jobs, models, scores):
        part, slots = nested._part(f, g), set(nested.layout.score_slots(f, g))
        held = [r for r in rows if r["slot"] in slots]
        guess = lambda r: int((np.where([v is None for v in r["x"]], part.fill, [v or 0 for v in r["x"]]) / part.std) @ model.matrix[0] + model.intercept > 0)
        assert score == pytest.approx(sum(r["n"] for r in held if guess(r) == r["label_idx"]) / sum(r["n"] for r in held))


def test_violation_is_zero_at_the_optimum_only(spark):
    df = spark.createDataFrame(
        [(str(i), i % 5, (i * 7) % 3, "p" if (i % 5) - (i * 7) % 3 + i % 2 > 1 else "q") for i in range(200)], "id string, a int, b int, label string"
    )
    fitted = md.fit_fixed_c(df, None, ["a", "b"])
    assert md.optimality(fitted, df).where(~F.col("optimal")).count() == 0
    fitted.model.matrix = fitted.model.matrix + 0.01
    assert md.optimality(fitted, df).where("optimal").count() == 0


def test_separable_classes_settle(spark):
    rows = spark.createDataFrame([([float(i)], int(i > 5), 0, 1.0) for i in range(12)], "x array<double>, label_idx int, slot int, n double")
    part = bf.Part(np.array([True]), np.zeros(1), np.full(1, 5.5), np.full(1, 3.45), np.ones(2))
    for c in (0.01, 10.0, 1000.0):
        assert np.isfinite(bf.fit_all(rows, 1, [part], [(0, c)], [12.0])[0].matrix).all()
