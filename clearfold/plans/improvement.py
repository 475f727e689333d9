"""The improvement loop: evaluate, ask for changes, keep to the column budget, repeat."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearfold.operators import featuredefs as fd
from clearfold.operators import metrics as m
from clearfold.operators import model as md
from clearfold.operators import requests as rq
from clearfold.operators.matrix import encoded_columns
from clearfold.operators.ordered import hash_head
from clearfold.operators.profile import class_counts
from clearfold.operators.resampling import exact_paired_test
from clearfold.operators.sampling import SEED, SEED_BROAD, make_splits, stratified_sample
from clearfold.plans.feature_run import Extract
from clearfold.session import cut
from clearfold.sources.configs import write_configs
from clearfold.sources.results import HISTORY_DDL, append_history, write_results

# Defaults of the loop.
MAX_SWAPS = 3
SAMPLES_PER_SIDE = 5
BROAD_SAMPLE = 200


@dataclass
class Changes:
    """What a proposer answers: names out, definitions in."""

    remove: list[str] = field(default_factory=list)
    add: list[dict] = field(default_factory=list)


@dataclass
class Context:
    """What a proposer sees of an iteration."""

    iteration: int
    defs: list[dict]
    val_accuracy: float
    sample_prompt: str
    proposal_prompt: str
    tried: list[str]
    insights: dict | None = None
    reverted: bool = False


Proposer = Callable[[Context], Changes | str]  # changes, or an answer in JSON


TEST_RESULT_DDL = "test_accuracy double, n_test bigint, best_val_accuracy double, best_features array<string>"


@dataclass
class Outcome:
    history: DataFrame
    best_defs: list[dict] | None
    best_accuracy: float
    test_accuracy: float | None
    test_metrics: DataFrame | None
    error: str | None
    broad_error: str | None = None


def answered_changes(spark, answer: str) -> Changes:
    """The changes an iteration answer in JSON asks for; nothing where it cannot be read."""
    parsed = rq.parse_answers(spark.createDataFrame([(0, answer)], "k int, response string"), rq.ITERATION_DDL)
    remove = rq.requested_removals(parsed, ["k"]).orderBy("pos").collect()  # one answer
    add = rq.requested_additions(parsed, ["k"]).orderBy("pos").collect()
    fields = ("name", "feature_type", "description", "min_val", "max_val", "values")
    return Changes([r["name"] for r in remove], [{f: r[f] for f in fields} for r in add])


def answered_patterns(spark, answer: str | Sequence[str]) -> list[str]:
    """Cleaned patterns of a broad answer, in JSON or as a list."""
    if isinstance(answer, str):
        rows = spark.createDataFrame([(0, answer)], "k int, response string")
    else:
        rows = spark.createDataFrame([(0, list(answer))], "k int, patterns array<string>").select("k", F.to_json(F.struct("patterns")).alias("response"))
    return [r["pattern"] for r in rq.broad_patterns(rq.parse_answers(rows, rq.BROAD_DDL), ["k"]).orderBy("pos").collect()]


def proposal_prompt(spark, standing: tuple, coefs: DataFrame, table: DataFrame, costs: DataFrame, insights: DataFrame, tried: list[str], patterns: list[str], max_swaps: int) -> str:
    """The request of one configuration, named ``c`` in all parts."""
    ddl = "config_id string, cv_accuracy double, cv_std double, n_nonzero int, n_columns int, effective_dim int, budget int"
    names = spark.createDataFrame([("c", n) for n in tried], "config_id string, name string")
    named = [df.withColumn("config_id", F.lit("c")) for df in (coefs, table, costs, insights)]
    return rq.proposal_requests(spark.createDataFrame([("c", *standing)], ddl), *named, names, patterns, max_swaps).first()["prompt"]


def _rows(defs: DataFrame) -> list[dict]:
    return [r.asDict() for r in defs.orderBy("pos").collect()]  # a feature configuration: a few dozen rows


def next_config(spark, defs: list[dict], changes: Changes, max_swaps: int, budget: int, name: str) -> tuple[list[dict], list[str]]:
    """(definitions of the next iteration, names the budget took out)."""
    current = fd.defs_table(spark, {"name": "c", "features": defs})
    gone = spark.createDataFrame([("c", i, n) for i, n in enumerate(changes.remove)], "config_id string, pos int, name string")
    proposed = [
        (
            "c", i, p["name"], p.get("feature_type", p.get("type")), p.get("description"),
            p.get("min_val"), p.get("max_val"), p.get("values"),
        )
        for i, p in enumerate(changes.add)
    ]
    ddl = (
        "config_id string, pos int, name string, feature_type string, description string, "
        "min_val int, max_val int, values array<string>"
    )
    additions = fd.definition_from_proposal(spark.createDataFrame(proposed, ddl))
    changed = fd.apply_changes(current, gone, additions, max_swaps)
    marked = fd.mark_pruned(changed, F.lit(budget)).collect()  # one configuration
    order = {"categorical": 2, "scale": 1}
    pruned = sorted((r for r in marked if r["dropped"]), key=lambda r: (-order.get(r["type"], 0), -r["cost"], r["pos"]))
    kept = sorted((r for r in marked if not r["dropped"]), key=lambda r: r["pos"])
    fields = ("name", "type", "min", "max", "values", "description")
    return [{f: r[f] for f in fields} for r in kept], [r["name"] for r in pruned]


def improve(
    corpus: DataFrame,
    defs: list[dict],
    extract: Extract,
    proposer: Proposer,
    n_iterations: int,
    label: str = "verdict",
    sample_size: int = 50,
    validation_size: int = 100,
    test_size: int = 200,
    n_train_folds: int = 5,
    max_swaps: int = MAX_SWAPS,
    split: bool = True,
    broad: Callable[[str], Sequence[str] | str] | None = None,
    analyst: Callable[[str], str] | None = None,
    select_by: str = "accuracy",
    gate: float | None = None,
    grid: Sequence[float] = md.C_GRID,
    out_path: str | None = None,
    session_id: str | None = None,
) -> Outcome:
    """Run the loop on ``corpus(id, body, label)``.

    With ``split`` the scores come from a fixed validation set and a test set touched once
    at the end; without it one sample is cross-validated. Each iteration reads written
    tables only, so plans do not grow with the number of iterations. The first error ends
    the loop; what was reached so far is kept.

    ``analyst`` answers a sample request in JSON before the proposal is asked for, and what it
    found goes into the proposal request. The best configuration is that of the best validation
    accuracy, or macro F1 (``select_by="macro_f1"``). With ``gate`` and ``split``, a configuration
    whose predictions of the validation set are worse than those of the best one, by the exact
    paired test at that level, is undone: the next changes go on from the best configuration.
    """
    if select_by not in ("accuracy", "macro_f1"):
        raise ValueError(f"no measure named {select_by}")
    spark = corpus.sparkSession
    session_id = session_id or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    texts = corpus.withColumn("id", F.col("id").cast("string"))
    if split:
        splits = cut(make_splits(texts.where(F.col(label).isNotNull()), label, test_size, validation_size, sample_size, n_train_folds))
    else:
        keys = texts.select("id", label).where(F.col(label).isNotNull())
        one = stratified_sample(keys, label, sample_size) if sample_size > 0 else keys
        none = F.lit(None).cast("int")
        splits = cut(one.select("id", label, F.lit("train").alias("role"), F.lit(0).alias("fold")).union(
            one.select("id", label, F.lit("train_pool").alias("role"), none.alias("fold")).limit(0)
        ))

    def rows_of(role: str, fold: int | None = None) -> DataFrame:
        ids = splits.where(F.col("role") == role)
        ids = ids.where(F.col("fold") == fold) if fold is not None else ids
        return texts.join(ids.select("id"), "id", "left_semi")

    patterns: list[str] = []
    broad_error = None
    if broad is not None:
        try:
            pool = splits.where(F.col("role") == ("train_pool" if split else "train")).select("id", label)
            drawn = stratified_sample(pool, label, BROAD_SAMPLE, seed=SEED_BROAD)
            sample = texts.join(drawn.select("id"), "id", "left_semi")
            patterns = answered_patterns(spark, broad(rq.broad_request(sample, label, "body").first()["prompt"]))
        except Exception as exc:  # the loop goes on without patterns
            broad_error = f"broad step: {exc}"

    classes = cut(class_counts(splits, label).where(F.col(label).isNotNull()).select(F.col(label).alias("class")))
    tried = [d["name"] for d in defs]
    best: tuple[float, list[dict] | None, md.Fitted | None] = (0.0, None, None)
    best_score, best_preds = 0.0, None
    records_log: list[tuple] = []
    error = None
    for i in range(1, n_iterations + 1):
        try:
            fold = (i - 1) % n_train_folds if split else 0
            train_rows = rows_of("train", fold)
            held_rows = rows_of("validation") if split else train_rows
            in_use = (F.col("role") == "train") & (F.col("fold") == fold)
            in_use = in_use | (F.col("role") == "validation") if split else in_use
            labels = splits.where(in_use).select("id", label).distinct()
            wanted = texts.join(labels.select("id"), "id", "left_semi")
            found, usage = extract(wanted, defs)
            found = cut(found)
            names = [d["name"] for d in defs]
            train = found.join(train_rows.select("id"), "id", "left_semi")
            held = found.join(held_rows.select("id"), "id", "left_semi")
            evaluation = md.fit_and_evaluate(train, labels, names, label, grid=grid)
            fitted = evaluation.fitted
            scored = fitted if split else md.fit_fixed_c(train, labels, names, label)
            held_texts = held_rows.select("id", F.col("body").alias("text"))
            preds = cut(md.detailed_predictions(scored, held, labels, held_texts, label))
            summary = m.accuracy_summary(preds).first()
            score = summary["accuracy"] if split else evaluation.mean
            per_class = [r.asDict() for r in m.per_class_metrics(preds, classes).orderBy("class").collect()]
            macro = sum(c["f1"] for c in per_class) / len(per_class)
            effective = len(encoded_columns(names, fitted.vocabulary))
            budget = spark.range(1).select(fd.column_budget(F.lit(evaluation.n_rows)).alias("b")).first()["b"]
            p_value, reverted = None, False
            if split and gate is not None and best_preds is not None:
                test = exact_paired_test(m.paired_comparison(best_preds, preds), gate).first()
                p_value, reverted = test["p_value"], test["worse"]
            measure = score if select_by == "accuracy" else macro
            is_best = measure > best[0]
            if is_best:
                best, best_score, best_preds = (measure, defs, fitted), score, preds
            base = best[1] if reverted and best[1] is not None else defs

            right = hash_head(m.correctly_classified(preds), "id", SEED, SAMPLES_PER_SIDE)
            wrong = hash_head(m.misclassified(preds), "id", SEED, SAMPLES_PER_SIDE)
            sample_prompt = rq.sample_request(right, wrong, names, patterns).first()["prompt"]
            coefs = m.coefficient_table(md.coefficients(fitted, found))
            surviving = m.surviving_features(coefs).first()["n_nonzero"]
            table = fd.defs_table(spark, {"name": "c", "features": base})
            observed = [(c, v) for c, values in fitted.vocabulary.items() for v in values]
            costs = fd.encoded_costs(table, spark.createDataFrame(observed, "name string, value string"))
            answer = [] if analyst is None else [("c", analyst(sample_prompt))]
            parsed = rq.parse_answers(spark.createDataFrame(answer, "config_id string, response string"), rq.SAMPLE_DDL)
            insights = rq.sample_insights(parsed, ["config_id"])
            lesson = insights.first()
            standing = (float(evaluation.mean), float(evaluation.std), int(surviving), len(fitted.columns), effective, int(budget))
            prompt = proposal_prompt(spark, standing, coefs, table, costs, insights, tried, patterns, max_swaps)
            context = Context(i, base, score, sample_prompt, prompt, list(tried), lesson.asDict() if lesson else None, reverted)
            changes = proposer(context)
            changes = answered_changes(spark, changes) if isinstance(changes, str) else changes
            following, pruned = next_config(spark, base, changes, max_swaps, budget, f"iter{i}")
            kept_names = {d["name"] for d in following} | set(pruned)
            tried += [p["name"] for p in changes.add[:max_swaps] if p["name"] in kept_names and p["name"] not in tried]
            tried += [n for n in pruned if n not in tried]
            cost = m.cost_by_model(usage).agg(F.sum("total_cost_usd").alias("c")).first()["c"] or 0.0
            record = (
                i, datetime.now(timezone.utc).isoformat(), fold, names, evaluation.mean, evaluation.std, float(score),
                evaluation.n_rows, summary["n"], int(surviving), float(fitted.c), effective, int(budget),
                sum(max(len(d.get("values") or []) - 1, 0) if d["type"] == "categorical" else 1 for d in defs),
                pruned,
                [(c["class"], c["precision"], c["recall"], c["f1"], c["support"]) for c in per_class],
                float(cost), changes.remove, [(p["name"], p.get("feature_type", p.get("type"))) for p in changes.add], is_best,
                float(macro), p_value, reverted,
            )
            records_log.append(record)
            if out_path:
                append_history(spark.createDataFrame([record], HISTORY_DDL), out_path + "/history", session_id)
                write_configs(
                    fd.defs_table(spark, {"name": f"iter{i}", "features": following}), f"{out_path}/configs/{session_id}/iter{i:02d}"
                )
            defs = following
        except Exception as exc:
            error = f"iteration {i}: {exc}"
            break

    history = spark.createDataFrame(records_log, HISTORY_DDL)
    test_accuracy, test_metrics = None, None
    if split and best[2] is not None:
        test_rows = rows_of("test")
        found, _ = extract(test_rows, best[1])
        labels = splits.where(F.col("role") == "test").select("id", F.col(label).alias("true_label"))
        preds = cut(md.predict(best[2], found).join(labels, "id"))
        test_accuracy = m.accuracy_summary(preds).first()["accuracy"]
        test_metrics = m.per_class_metrics(preds, classes)
        if out_path:
            row = (float(test_accuracy), preds.count(), float(best_score), [d["name"] for d in best[1]])
            write_results(spark.createDataFrame([row], TEST_RESULT_DDL), f"{out_path}/test_results", session_id)
    if out_path and best[1]:
        write_configs(fd.defs_table(spark, {"name": "best", "features": best[1]}), f"{out_path}/configs/{session_id}/best")
    return Outcome(history, best[1], best_score, test_accuracy, test_metrics, error, broad_error)
