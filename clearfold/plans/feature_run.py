"""One run over a labelled corpus: extract, fit, evaluate, report."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearfold.operators import extraction as ex
from clearfold.operators import metrics as m
from clearfold.operators import model as md
from clearfold.operators import requests as rq
from clearfold.operators.featuredefs import config_fingerprint, defs_table, record_schema
from clearfold.session import cut, shared_dir
from clearfold.sources.results import write_features, write_results

# (texts with id and body, definition rows) -> (records with id and one column per feature, usage rows)
Extract = Callable[[DataFrame, list[dict]], tuple[DataFrame, DataFrame]]
_USAGE = "model string, input_tokens bigint, output_tokens bigint"


def signal_extraction(signals: Sequence[ex.Signal]) -> Extract:
    """Records from text rules; nothing to pay for, so the usage is empty."""
    by_name = {s.name: s for s in signals}

    def extract(texts: DataFrame, defs: list[dict]) -> tuple[DataFrame, DataFrame]:
        chosen = [by_name[d["name"]] for d in defs]
        records = ex.extract_signals(texts.select("id", "body"), chosen).drop("body")
        return records, texts.sparkSession.createDataFrame([], _USAGE)

    return extract


def service_extraction(
    factory_for: Callable[[list[dict]], Callable[[], ex.Extractor]], model: str, cache_path: str | None = None, **options
) -> Extract:
    """Records from a pluggable service, through the cache table of the configuration.

    Every distinct text is sent once, and what a call paid for is on disk before it is used.
    """

    def extract(texts: DataFrame, defs: list[dict]) -> tuple[DataFrame, DataFrame]:
        spark = texts.sparkSession
        config_hash = config_fingerprint(defs_table(spark, {"name": "c", "features": defs})).first()["config_hash"]
        path = f"{cache_path or shared_dir(spark) + '/extractions'}/config={config_hash}"
        keyed = ex.with_cache_key(texts.select("id", "body"), config_hash)
        call = uuid.uuid4().hex
        cache = ex.extract_into_cache(keyed, path, factory_for(defs), record_schema(defs), call_id=call, **options)
        done = cache.where(F.col("status") == "ok")
        records = keyed.select("id", "cache_key").join(done.select("cache_key", "record"), "cache_key").select("id", "record.*")
        paid = done.where(F.col("call_id") == call)
        usage = paid.select(F.lit(model).alias("model"), "input_tokens", "output_tokens")
        return records, usage

    return extract


@dataclass
class RunReport:
    evaluation: md.Evaluation
    records: DataFrame
    coefficients: DataFrame
    predictions: DataFrame
    residual_request: DataFrame
    costs: DataFrame


def run(
    corpus: DataFrame,
    defs: list[dict],
    extract: Extract,
    label: str = "verdict",
    n_folds: int = 5,
    grid: Sequence[float] = md.C_GRID,
    out_path: str | None = None,
    run_id: str | None = None,
) -> RunReport:
    """Extract ``defs`` from ``corpus(id, body, label)``, cross-validate, fit and explain.

    The residual request uses a plain fit at C = 1 on all rows, as its purpose is to show
    what the features cannot tell apart even in sample.
    """
    records, usage = extract(corpus, defs)
    records = cut(records)
    names = [d["name"] for d in defs]
    labels = corpus.select("id", label)
    evaluation = md.fit_and_evaluate(records, labels, names, label, n_folds, grid)
    coefs = m.coefficient_table(md.coefficients(evaluation.fitted, records))
    texts = corpus.select(F.col("id").cast("string").alias("id"), F.col("body").alias("text"))
    predictions = md.in_sample_predictions(records, labels, texts, names, label)
    wrong = m.first_misclassified(predictions, rq.RESIDUAL_EXAMPLES, "id")
    residual = rq.residual_request(wrong, evaluation.fitted.columns)
    costs = m.cost_by_model(usage)
    if out_path and run_id:
        write_features(records, out_path + "/features", run_id)
        write_results(coefs, out_path + "/coefficients", run_id)
        write_results(costs, out_path + "/costs", run_id)
    return RunReport(evaluation, records, coefs, predictions, residual, costs)
