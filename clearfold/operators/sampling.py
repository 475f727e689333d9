"""Stratified draws, splits and folds in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearfold.operators.ordered import hash_rank, hash_sample
from clearfold.session import cut

# Seeds of the split steps.
SEED = 42
SEED_VALIDATION = 43
SEED_FOLDS = 100
SEED_BROAD = 2026


def proportional_quota(size: int | Column) -> Column:
    """Rows of one stratum in a sample of ``size``: its rounded-down share, at least one."""
    size_col = size if isinstance(size, Column) else F.lit(size)
    return F.greatest(F.lit(1), F.floor(size_col * F.col("n_stratum") / F.col("n_total")))


def uniform_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """``min(n, rows)`` rows without replacement."""
    return hash_sample(df, [], id_col, seed, F.lit(n))


def stratified_sample(df: DataFrame, label: str, size: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """Proportional draw per label, cut to ``size`` when the at-least-one rule overshoots."""
    return hash_sample(df, [label], id_col, seed, proportional_quota(size), head=size)


def stratified_trim(df: DataFrame, label: str, size: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """The proportional draw where ``df`` has more than ``size`` rows, else ``df`` itself; 0 keeps all.

    The choice is part of the plan: with no more rows than ``size`` every quota is the
    whole stratum, null labels included; else a null label has no quota.
    """
    if size <= 0:
        return df
    share = F.when(F.col(label).isNotNull(), proportional_quota(size)).otherwise(0)
    quota = F.when(F.col("n_total") > size, share).otherwise(F.col("n_stratum"))
    return hash_sample(df, [label], id_col, seed, quota, null_strata=True, head=size)


def without(df: DataFrame, taken: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not in ``taken``; a null id there removes null ids here."""
    gone = taken.select(F.col(id_col).alias("__gone"))
    return df.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")


def stratified_split(
    df: DataFrame, label: str, size: int, id_col: str = "id", seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(rest, split)."""
    split = stratified_sample(df, label, size, id_col, seed)
    return without(df, split, id_col), split


def train_folds(pool: DataFrame, label: str, size: int, n_folds: int, id_col: str = "id") -> DataFrame:
    """``n_folds`` independent draws from ``pool``; a row can be in several folds.

    All folds are drawn in one pass: the pool is expanded by fold when its ids are written.
    """
    expanded = pool.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    seed = F.lit(SEED_FOLDS) + F.col("fold")
    return hash_sample(expanded, ["fold", label], id_col, seed, proportional_quota(size), total_over=["fold"], head=size, head_per=["fold"])


def make_splits(
    df: DataFrame,
    label: str,
    test_size: int,
    validation_size: int,
    fold_size: int,
    n_folds: int,
    id_col: str = "id",
    materialise: bool = True,
) -> DataFrame:
    """One table ``(id, label, role, fold)``: test, validation, train_pool and the train folds.

    The keys are written down once, and so are test and validation, which are small next to the
    pool: that keeps the later draws from repeating the earlier ones.
    """
    keep = cut if materialise else (lambda d: d)
    keys = keep(df.select(id_col, label))
    test = keep(stratified_sample(keys, label, test_size, id_col, SEED))
    rest = without(keys, test, id_col)
    validation = keep(stratified_sample(rest, label, validation_size, id_col, SEED_VALIDATION))
    pool = without(rest, validation, id_col)
    folds = train_folds(pool, label, fold_size, n_folds, id_col)
    none = F.lit(None).cast("int")
    return (
        test.select(id_col, label, F.lit("test").alias("role"), none.alias("fold"))
        .unionByName(validation.select(id_col, label, F.lit("validation").alias("role"), none.alias("fold")))
        .unionByName(pool.select(id_col, label, F.lit("train_pool").alias("role"), none.alias("fold")))
        .unionByName(folds.select(id_col, label, F.lit("train").alias("role"), F.col("fold")))
    )


def kfold(df: DataFrame, label: str, k: int | Column, id_col: str = "id", seed: int = SEED, out: str = "fold") -> DataFrame:
    """Stratified fold number; folds of one label differ by one row at most."""
    k_col = k if isinstance(k, Column) else F.lit(k)
    ranked = hash_rank(df, [label], id_col, seed, "__rank")
    return ranked.withColumn(out, (F.col("__rank") % k_col).cast("int")).drop("__rank")


def rotating_fold(iteration: Column, n_folds: int) -> Column:
    return F.pmod(iteration - 1, F.lit(n_folds))
