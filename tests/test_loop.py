import json
import random

import pytest
from pyspark.sql import functions as F

from clearfold.operators.extraction import Extraction, Signal
from clearfold.plans.feature_run import run, service_extraction, signal_extraction
from clearfold.plans.improvement import Changes, answered_changes, answered_patterns, improve
from clearfold.sources.configs import read_configs
from clearfold.sources.results import read_history

SIGNALS = [
    Signal("bangs", "scale", "!", every=1),
    Signal("length", "scale", None, every=10),
    Signal("digit", "bool", "[0-9]"),
    Signal("mood", "categorical", choices=(("sad", "sad"), ("glad", "glad"))),
]
DEFS = [s.definition() for s in SIGNALS]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(160):
        bangs, mood = rnd.randint(0, 5), rnd.choice(["sad", "glad", "calm"])
        text = f"text {mood} " + "x" * rnd.randint(1, 60) + "!" * bangs + ("7" if rnd.random() < 0.4 else "")
        rows.append((str(i), text, "YTA" if bangs + rnd.gauss(0, 1) > 2.5 else "NTA"))
    return spark.createDataFrame(rows, "id string, body string, verdict string").cache()


def plan(context):
    assert "Columns left" in context.proposal_prompt and "RIGHT:" in context.sample_prompt
    if context.iteration == 1:
        return Changes(remove=["length"], add=[DEFS[2], DEFS[0], DEFS[3]])
    return Changes()


def test_loop_with_splits(spark, corpus, tmp_path):
    out = improve(
        corpus, DEFS[:2], signal_extraction(SIGNALS), plan, 2, sample_size=50, validation_size=30, test_size=30, n_train_folds=2,
        broad=lambda prompt: [" a ", "", "b"], grid=(0.1, 1.0), out_path=str(tmp_path), session_id="s",
    )
    assert out.error is None
    first, second = out.history.orderBy("iteration").collect()
    assert first.features_used == ["bangs", "length"] and second.features_used == ["bangs", "digit", "mood"]
    assert (first.train_fold, second.train_fold) == (0, 1) and first.dimensionality_budget == 12
    assert first.is_best and 0.5 < out.test_accuracy <= 1 and out.test_metrics.count() == 2
    assert read_history(spark, str(tmp_path / "history"), "s").count() == 2
    assert read_configs(spark, str(tmp_path / "configs" / "s" / "iter01")).count() == 3


def test_loop_on_one_sample_and_error(spark, corpus):
    def failing(context):
        if context.iteration == 2:
            raise RuntimeError("service down")
        return Changes()

    out = improve(corpus, DEFS[:1], signal_extraction(SIGNALS), failing, 3, sample_size=80, split=False, grid=(1.0,))
    assert out.error.startswith("iteration 2") and out.history.count() == 1 and out.test_accuracy is None


def test_insights_reach_the_proposal_and_answers_come_as_json(spark, corpus):
    seen = []

    def analyst(prompt):
        assert "WRONG:" in prompt
        return json.dumps({"correct_patterns": "long ones", "incorrect_patterns": "short ones", "missing_signals": ["mood", "haste"], "key_insight": "look at digits"})

    def proposer(context):
        seen.append(context)
        new = {"name": "digit", "feature_type": "bool", "description": "has a digit", "rationale": "r"}
        return json.dumps({"summary": "s", "feature_evaluations": [], "features_to_remove": ["length"], "proposed_features": [new], "expected_improvement": "e"})

    out = improve(
        corpus, DEFS[:2], signal_extraction(SIGNALS), proposer, 2, sample_size=50, validation_size=30, test_size=30, n_train_folds=2,
        grid=(1.0,), analyst=analyst, broad=lambda p: json.dumps({"patterns": [" one ", "", "two"]}), select_by="macro_f1",
    )
    assert out.error is None and out.broad_error is None
    rows = out.history.orderBy("iteration").collect()
    assert rows[1].features_used == ["bangs", "digit"] and all(0 <= r.macro_f1 <= 1 for r in rows) and not any(r.reverted for r in rows)
    prompt = seen[0].proposal_prompt
    for part in ("above all: look at digits", "lacking: mood; haste", "- one\n- two", "Accuracy over folds", "Dearest: bangs 1, length 1", "columns carry weight"):
        assert part in prompt
    assert seen[0].insights["complete"] and "Not to be named again: bangs, digit, length" in seen[1].proposal_prompt


def test_a_significantly_worse_proposal_is_undone(spark, corpus):
    def proposer(context):
        if context.iteration == 1:
            return Changes(remove=["bangs"], add=[DEFS[2]])  # the one feature that tells the classes apart
        assert context.reverted == (context.iteration == 2) and [d["name"] for d in context.defs] == ["bangs", "length"]
        return Changes()

    out = improve(
        corpus, DEFS[:2], signal_extraction(SIGNALS), proposer, 3, sample_size=50, validation_size=60, test_size=30, n_train_folds=1, grid=(1.0,), gate=0.05
    )
    assert out.error is None
    rows = out.history.orderBy("iteration").collect()
    assert rows[0].features_used == ["bangs", "length"] and rows[1].reverted and rows[1].p_value < 0.05
    assert rows[2].features_used == ["bangs", "length"] and out.best_defs[0]["name"] == "bangs"


def test_failing_broad_step_leaves_a_trace(spark, corpus):
    def broken(prompt):
        raise RuntimeError("down")

    out = improve(
        corpus, DEFS[:1], signal_extraction(SIGNALS), lambda c: Changes(), 1, sample_size=40, validation_size=30, test_size=20, n_train_folds=1, grid=(1.0,), broad=broken
    )
    assert out.error is None and out.broad_error == "broad step: down" and out.history.count() == 1


def test_answers_that_are_no_json(spark):
    assert answered_changes(spark, "sorry") == Changes([], [])
    assert answered_patterns(spark, "sorry") == [] and answered_patterns(spark, [" a ", "", None, "b"]) == ["a", "b"]


def test_run_through_a_service(spark, corpus, tmp_path):
    def factory_for(defs):
        def factory():
            def extract(text, ident):
                if text.endswith("x7"):
                    raise RuntimeError("no answer")
                return Extraction({"bangs": min(text.count("!"), 4) + 1, "length": min(len(text) // 10, 4) + 1}, 100, 10)
            return extract
        return factory

    service = service_extraction(factory_for, "gpt-5", str(tmp_path / "cache"), max_concurrent=4, requests_per_minute=None, backoff=lambda a: 0.0)
    report = run(corpus, DEFS[:2], service, n_folds=2, grid=(1.0,), out_path=str(tmp_path / "out"), run_id="r")
    failed = corpus.where(F.col("body").endswith("x7")).count()
    assert report.records.count() == 160 - failed
    cost = report.costs.first()
    distinct = corpus.where(~F.col("body").endswith("x7")).select("body").distinct().count()
    assert cost.n_samples == distinct and cost.input_tokens == 100 * distinct
    assert report.evaluation.mean > 0.6 and report.coefficients.count() == 2
    assert "instead of" in report.residual_request.first().prompt
    again, usage = service(corpus, DEFS[:2])
    assert again.count() == 160 - failed and usage.count() == 0
