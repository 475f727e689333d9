"""Column idioms and joins that the operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"
BROADCAST_ROWS = 1_000_000  # narrow rows that every executor may hold


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    """Sum of an array of longs, 0 when it is empty."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def row_key(id_col: str, text_col: str, id_as: str = "__id", hash_as: str = "__th") -> list[Column]:
    """Two columns that tell rows apart. Rows equal in both are copies, for which every result is the same."""
    return [F.col(id_col).alias(id_as), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(hash_as)]


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; else as it is, for a shuffle join.

    ``df`` should be a written table of narrow rows, since it is counted.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches to Python workers hold few rows, since a row may be a long text; the setting stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where a few keys may hold most of the rows.

    Both inputs must be written tables. Neither then brings a partitioning along, so both sides
    are shuffled for this join and adaptive execution splits the partition of a hot key, whose
    other side is one row; a small ``per_key`` is broadcast by its file size. Null keys match
    nothing.
    """
    return rows.join(per_key, list(keys))


def one_blas_thread() -> bool:
    """Let numpy's matrix products use one thread in this process, as a task has one core; True if that could be set.

    Workers get as many threads as an executor has cores, and for small matrices these mostly wait for each other.
    """
    if not os.path.exists("/proc/self/maps"):
        return False
    with open("/proc/self/maps") as lines:
        paths = {line.split()[-1] for line in lines if "openblas" in line}
    done = False
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                done = True
                break
    return done
