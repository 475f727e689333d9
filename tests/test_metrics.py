import pytest

from clearfold.operators import association as assoc
from clearfold.operators import metrics as m


def preds(spark, *pairs):
    return spark.createDataFrame(list(pairs), "true_label string, predicted_label string")


def test_per_class_with_absent_class(spark):
    p = preds(spark, ("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"))
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "class string")
    got = {r["class"]: r for r in m.per_class_metrics(p, classes).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (1.0, 0.5, 2)
    assert got["b"].precision == pytest.approx(2 / 3) and got["b"].f1 == pytest.approx(0.8)
    assert (got["c"].precision, got["c"].recall, got["c"].f1, got["c"].support) == (0.0, 0.0, 0.0, 0)


def test_accuracy_of_nothing(spark):
    r = m.accuracy_summary(preds(spark, ("a", "a")).limit(0)).first()
    assert r.n == 0 and r.accuracy is None
    assert m.wilson_interval(m.accuracy_summary(preds(spark, ("a", "a")).limit(0))).first().low is None


def test_unknown_model_costs_the_default(spark):
    u = spark.createDataFrame([("gpt-4o", 1_000_000, 0), ("nobody", 1_000_000, 1_000_000)], "model string, input_tokens long, output_tokens long")
    got = {r.model: r.total_cost_usd for r in m.cost_by_model(u).collect()}
    assert got == {"gpt-4o": 2.5, "nobody": 2.25}
    per = m.cost_per_sample(m.cost_by_model(u)).first()
    assert per.cost_at_target == pytest.approx(4.75 / 2 * 5000)


def test_running_best_and_summary(spark):
    h = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 0.5), ("s", 3, 0.5), ("s", 4, 0.7), ("s", 5, 0.6)], "k string, iteration int, val_accuracy double")
    best = [r.is_best for r in m.running_best(h, ["k"]).orderBy("iteration").collect()]
    assert best == [False, True, False, True, False]
    s = m.history_summary(h.where("iteration <> 4"), ["k"]).first()
    assert (s.first_score, s.last_score, s.best_iteration, s.n_iterations) == (0.0, 0.6, 5, 4)
    tie = m.history_summary(h.where("iteration < 4"), ["k"]).first()
    assert tie.best_iteration == 2


def test_directions_and_survivors(spark):
    c = spark.createDataFrame([("a", -2.0), ("b", 0.0), ("c", 1.0), ("d", 1e-7)], "feature string, coefficient double")
    assert [(r.feature, r.direction) for r in m.top_coefficients(c, 4).collect()] == [
        ("a", "negative"), ("c", "positive"), ("d", "positive"), ("b", "neutral"),
    ]
    assert m.surviving_features(c).first().n_nonzero == 2


def test_population_spread(spark):
    s = m.fold_summary(spark.createDataFrame([(0.6,), (0.8,)], "score double")).first()
    assert s["std"] == pytest.approx(0.1)


def test_wilson(spark):
    r = m.wilson_interval(spark.createDataFrame([(100, 80)], "n long, n_correct long")).first()
    assert (r.low, r.high) == (pytest.approx(0.7111708), pytest.approx(0.8666331))


def test_redundant_constant_is_not_flagged(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, 4, 5), (3, 6, 5)], "a int, b int, c int")
    got = {(r.feature_a, r.feature_b): r.redundant for r in assoc.redundant_pairs(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}
