"""Evaluation tables: accuracy, per-class scores, folds, coefficients, cost and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearfold.functions.text import change_summary
from clearfold.operators.ordered import running

# USD per million tokens (input, output), the model unknown names fall back
# to, and the coefficient size below which a feature counts as dropped.
PRICES = {
    "gpt-5-mini": (0.25, 2.00),
    "gpt-5": (1.25, 10.00),
    "gpt-5.2": (1.75, 14.00),
    "gpt-5.2-pro": (21.00, 168.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
}
DEFAULT_MODEL = "gpt-5-mini"
NONZERO = 1e-6


# -- predictions -----------------------------------------------------------------------


def misclassified(preds: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    return preds.where(~F.col(true).eqNullSafe(F.col(pred)))


def correctly_classified(preds: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    return preds.where(F.col(true).eqNullSafe(F.col(pred)))


def first_misclassified(preds: DataFrame, n: int, order: str, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """The first ``n`` wrong rows in input order."""
    return misclassified(preds, true, pred).orderBy(order).limit(n)


def accuracy_summary(preds: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    ok = F.col(true).eqNullSafe(F.col(pred))
    return preds.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_correct")).select(
        "n",
        "n_correct",
        (F.col("n") - F.col("n_correct")).alias("n_wrong"),
        F.when(F.col("n") > 0, F.col("n_correct") / F.col("n")).alias("accuracy"),
        F.when(F.col("n") > 0, (F.col("n") - F.col("n_correct")) / F.col("n") * 100.0).alias("pct_wrong"),
    )


def confusion(preds: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    return preds.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_class_metrics(
    preds: DataFrame, classes: DataFrame, true: str = "true_label", pred: str = "predicted_label"
) -> DataFrame:
    """Precision, recall, F1 and support of every class in ``classes(class)``; 0 where undefined.

    The data is read once, for the confusion counts; the rest works on classes squared rows.
    """
    cells = confusion(preds, true, pred)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("t").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("p").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0).cast("bigint")
    full = classes.join(sums, "class", "left").select(
        "class",
        F.coalesce("support", zero).alias("support"),
        F.coalesce("predicted", zero).alias("predicted"),
        F.coalesce("hit", zero).alias("hit"),
    )
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    either = F.col("predicted") + F.col("support")
    f1 = F.when(either > 0, 2.0 * F.col("hit") / either).otherwise(0.0)
    return full.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def macro_f1(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def wilson_interval(summary: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Score interval of an accuracy from ``n`` and ``n_correct``."""
    n = F.nullif(F.col("n"), F.lit(0))
    p = F.col("n_correct") / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return summary.select("n", "n_correct", p.alias("accuracy"), (centre - half).alias("low"), (centre + half).alias("high"))


def paired_comparison(before: DataFrame, after: DataFrame, id_col: str = "id") -> DataFrame:
    """McNemar counts of two prediction tables ``(id, correct)`` on the ids both have."""
    both = before.select(id_col, F.col("correct").alias("a")).join(
        after.select(id_col, F.col("correct").alias("b")), id_col
    )
    a, b = F.col("a"), F.col("b")
    counts = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a & b).alias("both_right"),
        F.count_if(a & ~b).alias("only_before"),
        F.count_if(~a & b).alias("only_after"),
        F.count_if(~a & ~b).alias("both_wrong"),
    )
    off = F.col("only_before") + F.col("only_after")
    gap = F.greatest(F.abs(F.col("only_before") - F.col("only_after")) - 1, F.lit(0).cast("bigint")).cast("double")
    chi2 = F.when(off > 0, gap * gap / off).otherwise(0.0)
    # Fixed value: 95 % point of chi-square with one degree of freedom.
    worse = (chi2 > 3.841458820694124) & (F.col("only_before") > F.col("only_after"))
    return counts.select("*", chi2.alias("chi2"), worse.alias("significantly_worse"))


def attach_texts(preds: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Texts next to predictions, empty where there is none."""
    joined = preds.join(texts.select(id_col, text_col), id_col, "left")
    return joined.withColumn(text_col, F.coalesce(text_col, F.lit("")))


def attach_features(preds: DataFrame, features: DataFrame, id_col: str = "id", prefix: str = "feat_") -> DataFrame:
    """Raw feature values next to predictions, under prefixed names."""
    renamed = features.withColumnsRenamed({c: prefix + c for c in features.columns if c != id_col})
    return preds.join(renamed, id_col, "left")


# -- folds and coefficients ------------------------------------------------------------


def fold_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean and population std of fold scores."""
    return scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n_folds"))


def coefficient_table(coefs: DataFrame) -> DataFrame:
    """Add size and odds ratio to ``(feature, coefficient)``."""
    return coefs.select(
        "feature", "coefficient", F.abs("coefficient").alias("abs_coef"), F.exp("coefficient").alias("odds_ratio")
    )


def direction() -> Column:
    c = F.col("coefficient")
    return F.when(c > 0, "positive").when(c < 0, "negative").otherwise("neutral")


def top_coefficients(coefs: DataFrame, n: int = 10) -> DataFrame:
    return (
        coefficient_table(coefs).withColumn("direction", direction()).orderBy(F.desc("abs_coef"), "feature").limit(n)
    )


def surviving_features(coefs: DataFrame, threshold: float = NONZERO) -> DataFrame:
    return coefs.agg(
        F.count_if(F.abs("coefficient") > threshold).alias("n_nonzero"), F.count(F.lit(1)).alias("n_features")
    )


# -- cost ------------------------------------------------------------------------------


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(m, i, o) for m, (i, o) in PRICES.items()]
    return spark.createDataFrame(rows, "model string, input_price double, output_price double")


def priced(usage: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """Token prices next to usage rows; unknown models get the default's.

    The price table has one row per priced model, a fixed handful, hence the broadcast.
    """
    prices = F.broadcast(price_table(usage.sparkSession))
    base_in, base_out = PRICES[default]
    return usage.join(prices, "model", "left").select(
        *usage.columns,
        F.coalesce("input_price", F.lit(base_in)).alias("input_price"),
        F.coalesce("output_price", F.lit(base_out)).alias("output_price"),
    )


def cost_by_model(usage: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """Tokens and USD per model; tokens are summed first, so prices join one row per model."""
    sums = usage.groupBy("model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("n_samples")
    )
    cost_in = F.col("input_tokens") * F.col("input_price") / 1_000_000
    cost_out = F.col("output_tokens") * F.col("output_price") / 1_000_000
    return priced(sums, default).select(
        "model",
        "n_samples",
        "input_tokens",
        "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        cost_in.alias("input_cost_usd"),
        cost_out.alias("output_cost_usd"),
        (cost_in + cost_out).alias("total_cost_usd"),
    )


def cost_per_sample(costs: DataFrame, target: int = 5000) -> DataFrame:
    """Cost of one extracted sample and of ``target`` of them, over all models."""
    return costs.agg(F.sum("total_cost_usd").alias("total_cost_usd"), F.sum("n_samples").alias("n_samples")).select(
        "total_cost_usd",
        "n_samples",
        F.when(F.col("n_samples") > 0, F.col("total_cost_usd") / F.col("n_samples")).alias("cost_per_sample"),
        F.when(F.col("n_samples") > 0, F.col("total_cost_usd") / F.col("n_samples") * target).alias("cost_at_target"),
    )


def session_cost(history: DataFrame, keys: list[str], cost: str = "extraction_cost") -> DataFrame:
    """What the iterations of a session cost together; an iteration without a cost adds nothing."""
    return history.groupBy(*keys).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost_usd"), F.count(cost).alias("n_costed"))


# -- history ---------------------------------------------------------------------------


def running_best(history: DataFrame, keys: list[str], score: str = "val_accuracy", order: str = "iteration") -> DataFrame:
    """Add ``is_best``: strictly better than everything earlier, and than 0."""
    chunk = F.floor(F.col(order) / 4096)
    seen = running(history, keys, chunk, [order], F.col(score), "__best", "max")
    return seen.withColumn("is_best", F.col(score) > F.coalesce("__best", F.lit(0.0))).drop("__best")


def history_summary(history: DataFrame, keys: list[str], score: str = "val_accuracy", order: str = "iteration") -> DataFrame:
    """First, last and best score per session; the earliest of equal bests wins."""
    return history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_iterations"),
        F.min_by(score, order).alias("first_score"),
        F.max_by(score, order).alias("last_score"),
        (F.max_by(score, order) - F.min_by(score, order)).alias("net_change"),
        F.max(score).alias("best_score"),
        F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("best_iteration"),
    )


def with_changes(history: DataFrame) -> DataFrame:
    """Add the one-line summary of what each iteration removed and added."""
    added = F.transform("features_added", lambda f: f["name"])
    return history.withColumn("changes", change_summary(F.col("features_removed"), added))


# -- feature diagnostics ---------------------------------------------------------------


def _long(df: DataFrame, columns: list[str], extra: list[str]) -> DataFrame:
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    ).alias("p")
    return df.select(*extra, pairs).select(*extra, "p.*")


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation, null where one side is constant."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(known, F.col(a).cast("double")), F.when(known, F.col(b).cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def feature_quality(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Variance of every feature and its correlation with a numeric target, in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.var_pop(c).alias(f"v{i}"), _correlation(c, target).alias(f"r{i}")]
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance"), F.col(f"r{i}").alias("target_corr"))
                for i, c in enumerate(columns)
            ]
        )
    ).alias("s")
    return df.agg(*aggs).select(rows).select("s.*")


def value_distribution(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Rows per feature value and label."""
    return _long(df, columns, [label]).groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n"))


def coverage(patterns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Patterns ``(pattern_id, pattern)`` with the number of features mapped to each."""
    counts = mapping.groupBy("pattern_id").agg(F.count("feature").alias("n_features"))
    zero = F.lit(0).cast("bigint")
    return patterns.join(counts, "pattern_id", "left").withColumn("n_features", F.coalesce("n_features", zero)).withColumn(
        "covered", F.col("n_features") > 0
    )
