"""Chunked ranks and running aggregates equal plain windows, whatever the key sizes and partitions."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clearfold.operators import sampling as sp
from clearfold.operators.ordered import hash_head, hash_rank, hash_sample, running
from clearfold.operators.profile import describe, exact_quantiles, majority_label, safe_fold_counts


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows under one label, some under none."""
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 else rnd.choice(["a", "b", None])) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, label string").repartition(7).cache()


def test_rank_equals_window(skewed):
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id")
    plain = {r.id: r.k for r in skewed.select("id", (F.row_number().over(w) - 1).alias("k")).collect()}
    assert {r.id: r["rank"] for r in hash_rank(skewed, ["label"], "id", 42).collect()} == plain


def test_sample_does_not_depend_on_partitioning(skewed):
    quota = F.lit(20)
    a = {r.id for r in hash_sample(skewed, ["label"], "id", 1, quota).collect()}
    b = {r.id for r in hash_sample(skewed.repartition(3), ["label"], "id", 1, quota).collect()}
    assert a == b and len(a) == 60
    by_hand = sorted((hashlib.md5(f"1:{r.id}".encode()).hexdigest(), r.id) for r in skewed.where("label = 'hot'").collect())[:20]
    assert {i for _, i in by_hand} <= a


def test_running_equals_window_on_hot_key(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rnd.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    for how, fn in (("sum", F.sum), ("max", F.max)):
        plain = {(r.k, r.o): r.x for r in df.select("k", "o", fn("v").over(w).alias("x")).collect()}
        got = running(df, ["k"], F.floor(F.col("o") / 64), ["o"], F.col("v"), "x", how)
        assert {(r.k, r.o): r.x for r in got.collect()} == plain


def test_stratified_sample_quota_and_overshoot(spark):
    rows = [(i, "big") for i in range(90)] + [(100 + i, f"rare{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, label string")
    got = sp.stratified_sample(df, "label", 9).collect()
    assert len(got) == 9  # 8 of the big class and one each of ten rare ones, cut to 9
    assert sp.stratified_sample(df, "label", 1000).count() == 100


def test_trim_keeps_small_inputs_and_null_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, label string")
    assert sp.stratified_trim(df, "label", 5).count() == 3
    assert sp.stratified_trim(df, "label", 0).count() == 3
    assert sp.stratified_trim(df, "label", 2).where("label is null").count() == 0


def test_split_handles_null_ids(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "id int")
    assert [r.id for r in sp.without(df, spark.createDataFrame([(None,), (1,)], "id int")).collect()] == [2]


def test_splits_are_disjoint(skewed):
    s = sp.make_splits(skewed.where("label is not null"), "label", 300, 200, 100, 3).collect()
    by = lambda role: {r.id for r in s if r.role == role}
    assert not by("test") & by("validation") and not by("test") & by("train_pool") and not by("validation") & by("train_pool")
    assert by("train") <= by("train_pool")
    assert {r.fold for r in s if r.role == "train"} == {0, 1, 2}
    folds = [{r.id for r in s if r.role == "train" and r.fold == f} for f in range(3)]
    assert folds[0] != folds[1]


def test_kfold_balance(skewed):
    rows = sp.kfold(skewed, "label", 4).groupBy("label", "fold").count().collect()
    for label in {r.label for r in rows}:
        sizes = [r["count"] for r in rows if r.label == label]
        assert max(sizes) - min(sizes) <= 1


def test_quantiles_by_brackets(spark):
    """Brackets of a small table with a value in half of the rows."""
    rnd = random.Random(3)
    values = [7.0 if i % 2 else rnd.random() * 100 for i in range(20001)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    import numpy as np

    for r in exact_quantiles(df, ["x"], (0.1, 0.25, 0.5, 0.9)).collect():
        assert r.value == pytest.approx(np.quantile(values, r.q), abs=1e-12)


def test_describe_handles_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    got = {r["column"]: r for r in describe(df, ["a", "b"]).collect()}
    assert got["a"]["count"] == 0 and got["a"]["p50"] is None
    assert got["b"]["p50"] == 2.0 and got["b"]["p25"] == 1.5


def test_majority_and_fold_counts(spark):
    df = spark.createDataFrame([("b",)] * 4 + [("a",)] * 4 + [("c",)], "label string")
    assert tuple(majority_label(df, "label").first()) == ("a", 4)
    assert tuple(safe_fold_counts(df, "label").first()) == (1, 9, 2, 2)


def test_head_has_one_rule_for_every_size(spark, monkeypatch):
    """Null keys and chunk sizes change nothing: the first rows of each key in hash order."""
    rows = [(i, None if i % 4 == 0 else "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, k string")
    by_hand = set()
    for key in (None, "a", "b"):
        own = sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i) for i, k in rows if k == key)
        by_hand |= {i for _, i in own[:5]}
    assert {r.id for r in hash_head(df, "id", 7, 5, per=["k"]).collect()} == by_hand
    monkeypatch.setattr("clearfold.operators.ordered.CHUNK_ROWS", 1)
    assert {r.id for r in hash_head(df, "id", 7, 5, per=["k"]).collect()} == by_hand
    assert hash_head(df, "id", 7, 100).count() == 40


def test_sample_does_not_shuffle_the_large_side(spark):
    """With a low broadcast threshold the final plan joins the boundaries by broadcast and orders boundary chunks only."""
    df = spark.range(200_000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("label"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        drawn = hash_sample(df, ["label"], "id", 1, F.lit(50))
        assert drawn.count() == 150
        plan = drawn._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_draws_read_their_input_at_most_twice(spark):
    """Counted in the tasks that make the input's rows."""
    reads = spark.sparkContext.accumulator(0)

    def counted(pdf):
        reads.add(len(pdf))
        return pdf

    n = 2000
    df = spark.range(n).select("id", (F.col("id") % 3).cast("string").alias("label"), F.lit("a long text").alias("body"))
    df = df.mapInPandas(lambda it: (counted(p) for p in it), df.schema)
    draws = {
        "uniform": lambda d: sp.uniform_sample(d, 100), "stratified": lambda d: sp.stratified_sample(d, "label", 100),
        "trim": lambda d: sp.stratified_trim(d, "label", 100), "splits": lambda d: sp.make_splits(d, "label", 100, 100, 50, 3),
        "rank": lambda d: hash_rank(d.select("id", "label"), ["label"], "id", 1), "folds": lambda d: sp.train_folds(d, "label", 50, 3),
    }
    for name, draw in draws.items():
        reads.value = 0
        assert draw(df).collect()
        assert reads.value <= 2 * n, (name, reads.value / n)
