"""Model fits have no SQL counterpart: they are checked by property and against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfold.operators import model as md
from clearfold.operators.matrix import align, align_columns, class_weights, encode, encoded_columns, fit_scaler, fit_vocabulary

NAMES = ["a", "b", "flag", "kind"]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        a, b = rnd.randint(1, 5), rnd.randint(1, 5)
        flag, kind = rnd.random() < 0.3, rnd.choice(["x", "y", "z"])
        label = "pos" if a - b + 2 * flag + rnd.gauss(0, 1.5) > 1.5 else "neg"
        rows.append((str(i), a, b, flag, kind, label))
    df = spark.createDataFrame(rows, "id string, a int, b int, flag boolean, kind string, label string").cache()
    return df, rows


def design(rows):
    x = np.array([[a, b, int(f), int(k == "y"), int(k == "z")] for _, a, b, f, k, _ in rows], float)
    y = np.array([1.0 if r[5] == "pos" else 0.0 for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    return x, y, w


def objective(x, y, w, c, beta, intercept):
    z = x @ beta + intercept
    loss = np.logaddexp(0, z) - y * z
    return c * (w * loss).sum() + 0.5 * np.abs(beta).sum() + 0.25 * (beta**2).sum()


@pytest.mark.parametrize("c", [0.1, 1.0])
def test_fit_minimises_the_balanced_elastic_net_objective(data, c):
    df, rows = data
    fitted = md.fit_fixed_c(df.drop("label"), df.select("id", "label"), NAMES, c=c)
    assert fitted.columns == ["a", "b", "flag", "kind_y", "kind_z"] and fitted.labels == ["neg", "pos"]
    x, y, w = design(rows)
    beta = fitted.model.coefficients.toArray()
    shift = np.array([fitted.scaler.mean[n] / fitted.scaler.std[n] for n in fitted.columns])
    intercept = fitted.model.intercept + float(beta @ shift)
    best = objective(x, y, w, c, beta, intercept)
    rng = np.random.default_rng(0)
    for scale in (0.3, 0.05, 0.01):
        for _ in range(300):
            other = objective(x, y, w, c, beta + rng.normal(0, scale, 5), intercept + rng.normal(0, scale))
            assert other >= best - 1e-4 * abs(best)


def test_small_c_drops_features(data):
    df, _ = data
    small = md.fit_fixed_c(df.drop("label"), df.select("id", "label"), NAMES, c=0.01)
    large = md.fit_fixed_c(df.drop("label"), df.select("id", "label"), NAMES, c=10.0)
    nonzero = lambda f: int((np.abs(f.model.coefficients.toArray()) > 1e-6).sum())
    assert nonzero(small) < nonzero(large)


@pytest.mark.parametrize("outer,inner", [(5, 3), (4, 2), (2, 2), (3, 3)])
def test_slots_give_balanced_disjoint_folds(outer, inner):
    layout = md.FoldLayout(outer, inner)
    for n in (outer * inner * 3 + 1, 37, 50):
        slot = [r % layout.n_slots for r in range(n)]
        for f in range(outer):
            train = [r for r in range(n) if slot[r] in layout.train_slots(f)]
            held = [r for r in range(n) if slot[r] in layout.score_slots(f)]
            assert sorted(train + held) == list(range(n))
            sizes = [sum(slot[r] in layout.score_slots(f, g) for r in range(n)) for g in range(inner)]
            assert sum(sizes) == len(train) and max(sizes) - min(sizes) <= 1
            for g in range(inner):
                assert not set(layout.train_slots(f, g)) & set(layout.score_slots(f, g))
        outer_sizes = [sum(slot[r] in layout.score_slots(f) for r in range(n)) for f in range(outer)]
        assert max(outer_sizes) - min(outer_sizes) <= 1


def test_part_statistics_equal_numpy(data, spark):
    """Scalers of every training part, gaps included, against a direct computation."""
    df, _ = data
    gappy = df.withColumn("a", F.when(F.col("a") != 2, F.col("a")))
    matrix = gappy.select("id", "a", "b", F.when(F.col("label") == "pos", 1).otherwise(0).alias("label_idx"))
    layout = md.FoldLayout(3, 2)
    collapsed = md.collapse(matrix, ["a", "b"], layout).cache()
    scalers, sizes = md.part_statistics(collapsed, ["a", "b"], layout)
    rows = [r.asDict() for r in collapsed.collect()]
    assert sum(r["n"] for r in rows) == 240
    for f, g in layout.parts():
        slots = set(layout.train_slots(f, g))
        flat = [r for r in rows if r["slot"] in slots for _ in range(r["n"])]
        assert sum(sizes[(f, g)].values()) == len(flat)
        for c in ("a", "b"):
            v = np.array([np.nan if r[c] is None else r[c] for r in flat], float)
            median = np.nanmedian(v)
            v = np.where(np.isnan(v), median, v)
            s = scalers[(f, g)]
            assert s.median[c] == median
            assert s.mean[c] == pytest.approx(v.mean()) and s.std[c] == pytest.approx(v.std())


def test_nested_run_and_prediction(data):
    df, _ = data
    e = md.fit_and_evaluate(df.drop("label"), df.select("id", "label"), NAMES, n_folds=2, grid=(0.1, 1.0))
    assert len(e.fold_scores) == 2 and 0.6 < e.mean <= 1 and e.fitted.c in (0.1, 1.0) and e.n_rows == 240
    unseen = df.withColumn("kind", F.lit("never seen")).drop("label")
    preds = md.predict(e.fitted, unseen)
    assert preds.count() == 240
    assert preds.where((F.col("confidence") < 0.5) | (F.col("confidence") > 1)).count() == 0
    labels = df.select("id", "label")
    full = md.detailed_predictions(e.fitted, df.drop("label"), labels, df.select("id", F.lit("t").alias("text")).limit(3))
    assert full.where("text = ''").count() == 237 and "feat_kind" in full.columns


def test_gaps_are_filled_with_the_training_median(data):
    df, _ = data
    gappy = df.withColumn("a", F.when(F.col("a") != 2, F.col("a"))).drop("label")
    fitted = md.fit_fixed_c(gappy, df.select("id", "label"), NAMES)
    a = md.predict(fitted, gappy.where("a is null")).orderBy("id").collect()
    filled = gappy.where("a is null").withColumn("a", F.lit(fitted.scaler.median["a"]))
    assert [r.confidence for r in a] == [r.confidence for r in md.predict(fitted, filled).orderBy("id").collect()]


def test_three_classes(data):
    df, _ = data
    labels = df.select("id", F.concat("label", F.when(F.col("a") > 4, "_high").otherwise("")).alias("label"))
    labels = labels.withColumn("label", F.when(F.col("label") == "neg_high", "neg").otherwise(F.col("label")))
    fitted = md.fit_fixed_c(df.drop("label"), labels, NAMES)
    assert len(fitted.labels) == 3 and fitted.model.coefficientMatrix.numRows == 3
    assert md.coefficients(fitted, df, class_index=2).count() == 5


def test_smallest_c_wins_ties():
    assert md.NestedFit.best_c(None, {10.0: 0.8, 0.1: 0.8, 1.0: 0.7}) == 0.1


def test_one_class_is_an_error(data):
    df, _ = data
    with pytest.raises(ValueError):
        md.fit_fixed_c(df.drop("label"), df.select("id", F.lit("pos").alias("label")), NAMES)


def test_interaction_terms(data):
    df, _ = data
    e = md.fit_and_evaluate(df.drop("label"), df.select("id", "label"), ["a", "b"], n_folds=2, grid=(1.0,), terms=[("a", "b")])
    assert e.fitted.columns == ["a", "b", "a__x__b"]
    assert md.predict(e.fitted, df.drop("label")).count() == 240


def test_encoding_against_pandas(data):
    import pandas as pd

    df, rows = data
    vocab = fit_vocabulary(df, NAMES)
    got = encode(df, NAMES, vocab).toPandas().sort_values("id").reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["id", *NAMES, "label"]).drop(columns="label")
    want = pd.get_dummies(want, columns=["kind"], drop_first=True, dtype=int).sort_values("id").reset_index(drop=True)
    want["flag"] = want["flag"].astype(int)
    assert list(got.columns) == list(want.columns)
    assert (got.values == want.values).all()


def test_column_alignment(spark):
    assert encoded_columns(["k", "n"], {"k": ["a", "b", "c"]}) == ["n", "k_b", "k_c"]
    m = spark.createDataFrame([("1", 3, 1)], "id string, n int, k_z int")
    assert align_columns(m, ["n", "k_b"]).collect()[0].asDict() == {"id": "1", "n": 3, "k_b": 0}


def test_alignment_by_key_and_weights(spark):
    feats = spark.createDataFrame([(2, 5), (1, 4)], "id long, x int")
    labels = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], "id string, label string")
    texts = spark.createDataFrame([("2", "t")], "id string, text string")
    assert [tuple(r) for r in align(feats, labels, texts, check=True).select("id", "x", "label").collect()] == [("2", 5, "b")]
    with pytest.raises(ValueError):
        align(feats, labels, texts.where("id = '9'"), check=True)
    w = {r.label: r.weight for r in class_weights(labels, "label").collect()}
    assert w == {"a": 3 / 4, "b": 3 / 2}


def test_constant_column_scale(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 10)], "c int, v int")
    s = fit_scaler(df, ["c", "v"])
    assert s.std["c"] == 1.0 and s.median["v"] == 2.5 and s.std["v"] == pytest.approx(np.std([1, 2, 3, 10]))


def test_ablation_and_zeroed_features(data):
    df, _ = data
    feats, labels = df.drop("label").withColumn("still", F.lit(1)), df.select("id", "label")
    fitted = md.fit_fixed_c(feats, labels, [*NAMES, "still"], c=1.0)
    assert "still" in md.zeroed_features(fitted) and "a" not in md.zeroed_features(fitted)
    table = md.ablation(feats, labels, ["a", "b", "still"], ["a", "still"], n_folds=2, grid=(1.0,))
    got = {r.left_out: r.cv_accuracy for r in table.collect()}
    assert got["still"] == pytest.approx(got[None]) and got["a"] < got[None]


def test_in_sample_predictions_with_one_class(data):
    df, _ = data
    texts = df.select("id", F.lit("t").alias("text")).limit(20)
    got = md.in_sample_predictions(df.drop("label"), df.select("id", F.lit("pos").alias("label")), texts, NAMES)
    rows = got.collect()
    assert len(rows) == 20 and all(r.correct and r.confidence == 1.0 and r.predicted_label == "pos" for r in rows)
    assert {"feat_a", "feat_kind", "text", "true_label"} <= set(got.columns)
    both = md.in_sample_predictions(df.drop("label"), df.select("id", "label"), df.select("id", F.lit("t").alias("text")), NAMES)
    assert both.count() == 240 and 0.6 < both.agg(F.avg(F.col("correct").cast("int"))).first()[0] <= 1


def test_scaler_of_nothing(spark):
    s = fit_scaler(spark.createDataFrame([], "v int"), ["v"])
    assert (s.median["v"], s.mean["v"], s.std["v"]) == (0.0, 0.0, 1.0)
