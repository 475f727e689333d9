"""Counts, numeric profiles and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearfold.operators.ordered import running
from clearfold.session import cut

QUARTILES = (0.25, 0.5, 0.75)
_ACCURACY = 100_000
_MARGIN = 1e-4
_MARGINS = (1.1e-4, 1.5e-4, 4e-4, 2e-3, 1e-2, 0.05, 0.3, 1.0)
_CHUNKS = 256  # of the values inside the bracket of one quantile


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def basics(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = ()) -> list[dict]:
    """Count, moments and range of every column, and brackets of ``probs`` for every margin, one row from one pass.

    A bracket's margin covers the sketch's error and the two ranks that a quantile lies between.
    It depends on the count, which the same pass gives, so the sketch is asked for all of ``_MARGINS``.
    """
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        parts = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "var": F.var_pop(v), "min": F.min(v), "max": F.max(v)}
        asked = [x for q in probs for m in _MARGINS for x in (max(0.0, q - m), min(1.0, q + m))]
        if asked:
            parts["near"] = F.percentile_approx(v, asked, _ACCURACY)
        aggs.append(F.struct(*[x.alias(k) for k, x in parts.items()]).alias(f"s{i}"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    return [row[f"s{i}"].asDict() | {"rows": row["rows"]} for i in range(len(columns))]


def _brackets(known: list[dict], probs: Sequence[float]) -> list[tuple[int, int, float, float]]:
    """(column, quantile, low, high) per column with values and quantile."""
    out = []
    for i, s in enumerate(known):
        if s["n"]:
            m = next((k for k, m in enumerate(_MARGINS) if m >= _MARGIN + 1.5 / s["n"]), len(_MARGINS) - 1)
            for j in range(len(probs)):
                at = 2 * (j * len(_MARGINS) + m)
                out.append((i, j, s["near"][at], s["near"][at + 1]))
    return out


def quantile_rows(df: DataFrame, columns: Sequence[str], known: list[dict], probs: Sequence[float]) -> DataFrame:
    """``column, q, value`` from the ``basics`` of the same columns and quantiles, in one more pass.

    The pass counts the rows below each bracket along with the distinct values inside it.
    """
    brackets = _brackets(known, probs)
    if not brackets:
        return df.sparkSession.createDataFrame([], "column string, q double, value double")
    hits = []
    for k, (i, _, lo, hi) in enumerate(brackets):
        v = F.col(columns[i]).cast("double")
        inside = F.struct(F.lit(k).alias("k"), F.when(v >= lo, v).alias("v"))
        hits.append(F.when(v <= hi, inside))
    values = cut(df.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.k", "h.v").agg(F.count(F.lit(1)).alias("n")))
    below = {r["k"]: r["n"] for r in values.where(F.col("v").isNull()).collect()}  # one row per bracket
    of = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("k") + 1)
    low, width = of([float(b[2]) for b in brackets]), of([float(b[3] - b[2]) for b in brackets])
    chunk = F.when(width > 0, F.floor((F.col("v") - low) / width * _CHUNKS)).otherwise(F.lit(0))
    ranked = running(values.where(F.col("v").isNotNull()), ["k"], chunk, ["v"], F.col("n"), "ahead")
    rows = ranked.select(
        of([columns[b[0]] for b in brackets]).alias("column"),
        of([float(probs[b[1]]) for b in brackets]).alias("q"),
        "v",
        (of([int(below.get(k, 0)) for k in range(len(brackets))]) + F.coalesce("ahead", F.lit(0)) + F.col("n")).alias("upto"),
        (of([float(probs[b[1]]) for b in brackets]) * of([known[b[0]]["n"] - 1 for b in brackets])).alias("p"),
    )
    picked = rows.groupBy("column", "q", "p").agg(
        F.min(F.when(F.col("upto") > F.floor("p"), F.col("v"))).alias("x0"),
        F.min(F.when(F.col("upto") > F.ceil("p"), F.col("v"))).alias("x1"),
    )
    value = F.col("x0") + (F.col("p") - F.floor("p")) * (F.col("x1") - F.col("x0"))
    return picked.select("column", "q", value.alias("value"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Linear-interpolated quantiles as rows ``(column, q, value)``, exact, from two passes and without a global sort.

    The built-in exact percentile keeps every distinct value in one buffer. Here the first pass
    brackets each wanted rank by a sketch (its rank error is at most 1/accuracy, a tenth of the
    margin); the second counts the rows below each bracket and takes the values inside, collapsed
    to (value, count) before the shuffle; their running counts go over chunks of each bracket.
    """
    return quantile_rows(df, columns, basics(df, columns, probs), probs)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, sample std, min, quartiles and max, from two passes."""
    known = basics(df, columns, QUARTILES)
    quart = quantile_rows(df, columns, known, QUARTILES).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{int(q * 100)}") for q in QUARTILES]
    )
    rows = [(c, s["n"], s["mean"], s["std"], s["min"], s["max"]) for c, s in zip(columns, known)]
    ddl = "column string, count bigint, mean double, std double, min double, max double"
    table = F.broadcast(df.sparkSession.createDataFrame(rows, ddl))  # one row per profiled column
    return table.join(quart, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels in sorted order with their 0-based index.

    The window runs over the distinct labels only.
    """
    distinct = df.where(F.col(label).isNotNull()).select(label).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(label)
    return distinct.withColumn("label_idx", F.row_number().over(w) - 1)


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label; the alphabetically first among equals."""
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    return counts.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("x")).select(
        F.col("x")["l"].alias("majority_label"), (-F.col("x")["m"]).alias("n")
    )


def safe_fold_counts(df: DataFrame, label: str, n_folds: int = 5) -> DataFrame:
    """Inner and outer fold counts that the rarest class can fill."""
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    return counts.agg(F.min("n").alias("min_class"), F.sum("n").alias("n_rows")).select(
        "min_class",
        "n_rows",
        F.greatest(F.lit(2), F.least(F.lit(3), F.col("min_class"))).alias("inner_folds"),
        F.greatest(
            F.lit(2), F.least(F.lit(n_folds), F.col("min_class"), F.floor(F.col("n_rows") / 2))
        ).alias("outer_folds"),
    )
