"""Bootstrap intervals and exact paired tests without copies of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 200
PER_DIGEST = 8  # weights that one md5 digest gives, two bytes each
POISSON = tuple(round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8))  # 2-byte draws from which a weight exceeds k


def _digests(id_col: str, seed: int, replicates: int) -> Column:
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    parts = [F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(f":{k}")))) for k in range(-(-replicates // PER_DIGEST))]
    return F.concat(*parts)


def bootstrap_replicates(rows: DataFrame, value: Column, id_col: str = "id", replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """``replicate, weight, score``: weighted mean of ``value`` under Poisson weights, one row per replicate.

    The weight of a row in a replicate comes from md5 of seed and id, so it depends on neither
    partitioning nor attempt; tasks add up arrays of sums, and one narrow row per task and
    replicate is shuffled. Rows with a null value are left out; rows of one id share their weights.
    """
    keyed = rows.select(value.cast("double").alias("v"), _digests(id_col, seed, replicates).alias("d")).where(F.col("v").isNotNull())
    steps = np.array(POISSON)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, values = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            draws = np.frombuffer(b"".join(batch.column("d").to_pylist()), ">u2").reshape(batch.num_rows, -1)[:, :replicates]
            w = np.searchsorted(steps, draws, side="right").astype(float)
            weights += w.sum(axis=0)
            values += batch.column("v").to_numpy(zero_copy_only=False) @ w
        yield pa.RecordBatch.from_pydict({"replicate": pa.array(range(replicates), pa.int32()), "weight": weights, "total": values})

    sums = keyed.mapInArrow(add, "replicate int, weight double, total double").groupBy("replicate")
    both = sums.agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    return both.select("replicate", "weight", F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).alias("score"))


def bootstrap_interval(
    rows: DataFrame, value: Column, id_col: str = "id", replicates: int = REPLICATES, level: float = 0.95, seed: int = 42
) -> DataFrame:
    """One row: ``n_replicates, low, median, high, std``, percentiles of the replicates' scores.

    All null where there are no rows.
    """
    scores = bootstrap_replicates(rows, value, id_col, replicates, seed)
    at = F.percentile("score", F.array(*[F.lit(q) for q in ((1 - level) / 2, 0.5, (1 + level) / 2)]))  # one value per replicate
    return scores.agg(F.count("score").alias("n_replicates"), at.alias("q"), F.stddev_samp("score").alias("std")).select(
        "n_replicates", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "std"
    )


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!: summed below 32, by Stirling's series from there on (exact to 1e-13)."""
    x = n.cast("double")
    summed = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(32)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 32, summed).otherwise(series)


def exact_paired_test(counts: DataFrame, level: float = 0.05) -> DataFrame:
    """Add ``p_value`` and ``worse`` to ``only_before, only_after``: the two-sided binomial tail of McNemar's test.

    The tail is summed from its largest term on, from logarithms of factorials. Terms more than 40
    standard deviations away are below the smallest double and left out, so the number of terms
    grows with the square root of the differing rows.
    """
    n, k = F.col("only_before") + F.col("only_after"), F.least("only_before", "only_after")
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.lit(math.log(2))
    lowest = F.greatest(k - F.ceil(20 * F.sqrt(n.cast("double"))), F.lit(1))
    steps = F.when(k >= lowest, F.sequence(k, lowest, F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * i / (F.col("__n") - i + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    summed = counts.withColumns({"__n": n, "__first": first, "__steps": steps}).withColumn("__sum", F.aggregate("__steps", start, add)["sum"])
    p = F.when(F.col("__n") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp("__first") * F.col("__sum")))
    out = summed.withColumn("p_value", p).drop("__n", "__first", "__steps", "__sum")
    return out.withColumn("worse", (F.col("p_value") < level) & (F.col("only_before") > F.col("only_after")))
