"""Numeric design matrices from typed records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearfold.operators.profile import basics, class_counts, label_index, quantile_rows


def join_labels(features: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Features and labels paired by id; ids are compared as strings on both sides."""
    left = features.withColumn(id_col, F.col(id_col).cast("string"))
    right = labels.withColumn(id_col, F.col(id_col).cast("string"))
    return left.join(right, id_col)


def align(features: DataFrame, labels: DataFrame, texts: DataFrame, id_col: str = "id", check: bool = False) -> DataFrame:
    """Rows present in all three tables; with ``check`` an empty result is an error."""
    out = join_labels(join_labels(features, labels, id_col), texts, id_col)
    if check and out.isEmpty():
        raise ValueError("features, labels and texts share no id")
    return out


def categorical_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    types = dict(df.dtypes)
    return [c for c in columns if types[c] == "string"]


def fit_vocabulary(df: DataFrame, columns: Sequence[str], max_values: int = 10_000) -> dict[str, list[str]]:
    """Observed values of every string column among ``columns``, sorted.

    One distinct pass; more than ``max_values`` values, which would be as many matrix columns,
    are an error, found before anything is brought to the driver.
    """
    cats = categorical_columns(df, columns)
    if not cats:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in cats])).alias("p")
    seen = df.select(pairs).select("p.*").where(F.col("value").isNotNull()).distinct()
    rows = seen.limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"more than {max_values} category values")
    vocab: dict[str, list[str]] = {c: [] for c in cats}
    for r in rows:
        vocab[r["name"]].append(r["value"])
    return {c: sorted(v) for c, v in vocab.items()}


def encoded_columns(columns: Sequence[str], vocabulary: dict[str, list[str]]) -> list[str]:
    """Matrix columns: the plain ones in order, then ``column_value`` without the first value."""
    plain = [c for c in columns if c not in vocabulary]
    return plain + [f"{c}_{v}" for c in columns if c in vocabulary for v in vocabulary[c][1:]]


def encode(
    df: DataFrame, columns: Sequence[str], vocabulary: dict[str, list[str]], keep: Sequence[str] = ("id",)
) -> DataFrame:
    """The matrix of ``columns`` under a fitted vocabulary, next to the ``keep`` columns.

    The vocabulary comes from the training rows, so every split gets the same columns in
    the same order; a value unseen in training is zero in all of them.
    """
    types = dict(df.dtypes)
    plain = [
        F.col(c).cast("int").alias(c) if types[c] == "boolean" else F.col(c) for c in columns if c not in vocabulary
    ]
    dummies = [
        F.when(F.col(c) == v, F.lit(1)).otherwise(F.lit(0)).alias(f"{c}_{v}")
        for c in columns
        if c in vocabulary
        for v in vocabulary[c][1:]
    ]
    return df.select(*keep, *plain, *dummies)


def align_columns(matrix: DataFrame, train_columns: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """A ready-made matrix under the training columns: missing ones 0, extra ones left out."""
    have = set(matrix.columns)
    cols = [F.col(c) if c in have else F.lit(0).alias(c) for c in train_columns]
    return matrix.select(*keep, *cols)


def _by_label(label: str, values: dict) -> Column:
    """Value of the row's label from a small literal map; null where it has none."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(label)) if pairs else F.lit(None)


def class_weights(df: DataFrame, label: str, out: str = "weight", max_classes: int = 10_000) -> DataFrame:
    """Add rows / (classes x rows of the class); rows without a label are left out.

    The class counts, at most ``max_classes`` rows, become a literal, so the table is not
    shuffled by its few labels.
    """
    rows = class_counts(df.where(F.col(label).isNotNull()), label).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    n = sum(r["n"] for r in rows)
    weight = _by_label(label, {r[label]: n / (len(rows) * r["n"]) for r in rows}).cast("double")
    return df.where(F.col(label).isNotNull()).withColumn(out, weight).select(*df.columns, out)


@dataclass(frozen=True)
class Scaler:
    """Median, mean and spread per column, as fitted on training rows."""

    median: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]

    def scaled(self, column: str) -> Column:
        filled = F.coalesce(F.col(column).cast("double"), F.lit(self.median[column]))
        return (filled - F.lit(self.mean[column])) / F.lit(self.std[column])


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: median of what is there, then mean and population std after filling; two passes."""
    known = basics(df, columns, [0.5])
    medians = quantile_rows(df, columns, known, [0.5]).select("column", F.col("value").alias("median"))
    rows = [(c, s["rows"], s["n"], s["mean"], s["var"]) for c, s in zip(columns, known)]
    one = df.sparkSession.createDataFrame(rows, "column string, n bigint, c bigint, m double, v double")
    filled = one.join(medians, "column", "left").withColumn("f", F.col("c") / F.nullif(F.col("n"), F.lit(0)))
    mean = F.coalesce(F.col("m") * F.col("f") + F.col("median") * (1 - F.col("f")), F.lit(0.0))
    gap = F.col("m") - F.col("median")
    var = F.col("v") * F.col("f") + F.col("f") * (1 - F.col("f")) * gap * gap
    spread = F.sqrt(var)
    return filled.select(
        "column",
        F.coalesce("median", F.lit(0.0)).alias("median"),
        mean.alias("mean"),
        F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("std"),
    )


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    rows = scaler_stats(df, columns).collect()  # one row per matrix column
    return Scaler(
        {r["column"]: r["median"] for r in rows},
        {r["column"]: r["mean"] for r in rows},
        {r["column"]: r["std"] for r in rows},
    )


def impute_scale(df: DataFrame, scaler: Scaler, columns: Sequence[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in set(columns)]
    return df.select(*keep, *[scaler.scaled(c).alias(c) for c in columns])


def index_labels(df: DataFrame, label: str, labels: DataFrame, out: str = "label_idx", max_classes: int = 10_000) -> DataFrame:
    """Attach the training label index from a literal; a label unknown to training gets null."""
    rows = labels.limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    return df.withColumn(out, _by_label(label, {r[label]: r["label_idx"] for r in rows}).cast("int"))


def single_class_predictions(df: DataFrame, label: str) -> DataFrame:
    """What is predicted when only one class exists: that class, correct, confidence 1."""
    only = label_index(df, label)
    return df.where(F.lit(only.agg(F.count(F.lit(1))).scalar()) == 1).select(
        "*",
        F.col(label).alias("predicted_label"),
        F.lit(True).alias("correct"),
        F.lit(1.0).alias("confidence"),
    )


def with_interactions(df: DataFrame, terms: Sequence[tuple[str, str]]) -> DataFrame:
    """Product columns ``a__x__b``; a pair of one column twice is its square."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}__x__{b}") for a, b in terms])


