"""Resampling, exact tests, association and correlations against numpy and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfold.operators import association as assoc
from clearfold.operators import resampling as rs


def table(spark, n=600, parts=3):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.random() < 0.7), int(rng.integers(5)), str(rng.integers(3)), rng.choice(["a", "b"])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, hit double, level int, kind string, label string").repartition(parts)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = table(spark)
    got = {p: rs.bootstrap_replicates(df.repartition(p), F.col("hit")).orderBy("replicate").collect() for p in (1, 7)}
    assert got[1] == got[7] and len(got[1]) == rs.REPLICATES
    interval = rs.bootstrap_interval(df, F.col("hit")).first()
    mean = df.agg(F.avg("hit")).first()[0]
    assert interval["low"] < mean < interval["high"] and interval["std"] == pytest.approx(math.sqrt(mean * (1 - mean) / 600), rel=0.2)
    assert np.mean([r["weight"] for r in got[1]]) == pytest.approx(600, rel=0.01)


def test_bootstrap_of_nothing(spark):
    r = rs.bootstrap_interval(table(spark).limit(0), F.col("hit")).first()
    assert r["n_replicates"] == 0 and r["low"] is None


def test_exact_test_equals_binomial_sums(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (5, 5), (3, 12), (12, 3), (40, 71), (700, 400), (10**6, 10**6 + 3000), (50_000, 49_000)]
    got = rs.exact_paired_test(spark.createDataFrame(pairs, "only_before bigint, only_after bigint")).collect()
    for r in got:
        n, k = r["only_before"] + r["only_after"], min(r["only_before"], r["only_after"])
        want = min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(max(0, k - 30_000), k + 1))) if n else 1.0
        assert r["p_value"] == pytest.approx(want, rel=1e-6, abs=1e-300)
        assert r["worse"] == (want < 0.05 and r["only_before"] > r["only_after"])


def test_association_of_dependent_and_independent(spark):
    df = spark.createDataFrame([(i, i % 4, "x" if i % 4 < 2 else "y", (i // 4) % 2 == 0) for i in range(400)], "id int, a int, label string, b boolean")
    got = {r["feature"]: r for r in assoc.label_association(df, ["a", "b"], "label").collect()}
    assert got["a"]["cramers_v"] == pytest.approx(1.0, abs=0.01) and got["a"]["mutual_information"] == pytest.approx(math.log(2))
    assert got["b"]["cramers_v"] == 0.0 and got["b"]["mutual_information"] == pytest.approx(0, abs=1e-9)
    gaps = df.withColumn("a", F.when(F.col("id") > 9, F.col("a")))
    assert {r["feature"]: r["n"] for r in assoc.label_association(gaps, ["a", "b"], "label").collect()} == {"a": 390, "b": 400}


def test_examples_are_the_smallest_hashes_however_often_tasks_pass_on(spark, monkeypatch):
    df = table(spark)
    want = sorted(tuple(r) for r in assoc.value_examples(df, ["level", "kind"], "label").collect())
    monkeypatch.setattr(assoc, "HELD_KEYS", 1)
    assert sorted(tuple(r) for r in assoc.value_examples(df.repartition(5), ["level", "kind"], "label").collect()) == want
    assert all(len(r[4].split(",")) == min(3, r[3]) for r in want) and sum(r[3] for r in want) == 1200


def test_correlations_equal_numpy_on_known_pairs(spark, monkeypatch):
    monkeypatch.setattr(assoc, "BLOCK", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(1e4, 1, (300, 7))
    x[:, 3] = 2 * x[:, 1] + 0.1 * x[:, 3]
    x[:, 6] = 5.0
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(7))).repartition(4)
    got = {(r["feature_a"], r["feature_b"]): r for r in assoc.correlations(df, [f"c{i}" for i in range(7)]).collect()}
    assert len(got) == 21
    for i in range(7):
        for j in range(i + 1, 7):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[(f"c{i}", f"c{j}")]
            assert r["n"] == both.sum()
            assert r["r"] is None if j == 6 else r["r"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)


def test_many_columns_are_one_small_plan(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).alias(f"c{i}") for i in range(300)])
    assert assoc.correlations(df, df.columns).count() == 300 * 299 // 2


def test_rank_correlation_equals_ranks(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (500, 3)).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0)], "a double, b double, t double")

    def ranks(v):
        return np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])

    got = {r["feature"]: r["rank_corr"] for r in assoc.rank_correlation(df, ["a", "b"], "t").collect()}
    for i, c in enumerate("ab"):
        assert got[c] == pytest.approx(np.corrcoef(ranks(x[:, i]), ranks(x[:, 2]))[0, 1])
