"""Exact ranks, samples and running aggregates that never put one key into one task.

A plain window over a label or a session puts every row of that key into one task.
Here each key is cut into chunks first: the chunk totals form a small table, a window
over that table gives what precedes each chunk, and the row-level window runs inside
one (key, chunk) only. Ranks by hash use the leading hex digits of the hash as the
chunk, which splits any key evenly; the counted rows say how many digits it takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearfold.functions.hashing import hash_order
from clearfold.session import cut

CHUNK_ROWS = 20_000  # rows that one chunk should hold, about

_H, _B, _N, _BEFORE = "__hash", "__chunk", "__n", "__before"



def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str | Column],
    value: Column,
    out: str,
    how: str = "sum",
) -> DataFrame:
    """Add ``out``: the sum or max of ``value`` over all earlier rows of the same key.

    ``chunk`` must not decrease along ``order`` within a key. Null where no row precedes.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    base = df.withColumn(_B, chunk).withColumn("__v", value)
    totals = base.groupBy(*keys, _B).agg(agg("__v").alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(_B).alias("__kb"),
        agg("__t").over(earlier).alias("__carry"),
    )
    inside = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.withColumn("__in", agg("__v").over(inside))
    cond = F.col(_B).eqNullSafe(F.col("__kb"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    both = (
        F.greatest("__carry", "__in")
        if how == "max"
        else F.coalesce(F.col("__carry") + F.col("__in"), "__carry", "__in")
    )
    return ranked.join(carry, cond, "left").withColumn(out, both).select(*df.columns, out)


def hex_digits_for(n_rows: int) -> int:
    """Leading hex digits that cut ``n_rows``, were they all of one key, into chunks of about ``CHUNK_ROWS``."""
    digits = 1
    while 16**digits * CHUNK_ROWS < n_rows:
        digits += 1
    return digits


def _written(df: DataFrame, columns: Sequence[str], id_col: str, seed: int | Column) -> tuple[DataFrame, int]:
    """(written table of ``columns`` with the hash and its chunk, rows); the input is read once."""
    narrow = cut(df.select(*columns, hash_order(seed, id_col).alias(_H)))
    n = narrow.count()
    return narrow.withColumn(_B, F.substring(_H, 1, hex_digits_for(n))), n


def _chunk_counts(keyed: DataFrame, strata: Sequence[str]) -> DataFrame:
    return keyed.groupBy(*strata, _B).agg(F.count(F.lit(1)).alias(_N))


def _on(strata: Sequence[str], null_safe: bool) -> Column:
    cond = F.lit(True)
    for i, s in enumerate(strata):
        cond = cond & (F.col(s).eqNullSafe(F.col(f"__s{i}")) if null_safe else F.col(s) == F.col(f"__s{i}"))
    return cond


def hash_rank(df: DataFrame, strata: Sequence[str], id_col: str, seed: int | Column, out: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the hash order of its stratum.

    ``id_col`` must be unique within a stratum. Null strata form a stratum of their own. ``df`` is
    written once with its hashes, so it should hold narrow columns only.
    """
    keyed, _ = _written(df, df.columns, id_col, seed)
    earlier = Window.partitionBy(*(strata or [F.lit(0)])).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _chunk_counts(keyed, strata).select(
        *[F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)],
        F.col(_B).alias("__sb"),
        F.coalesce(F.sum(_N).over(earlier), F.lit(0)).alias(_BEFORE),
    )
    inside = Window.partitionBy(*strata, _B).orderBy(_H, id_col)
    ranked = keyed.withColumn("__in", F.row_number().over(inside))
    cond = (F.col(_B) == F.col("__sb")) & _on(strata, True)
    return ranked.join(offsets, cond).withColumn(out, F.col(_BEFORE) + F.col("__in") - 1).select(*df.columns, out)


def _last_rows(keyed: DataFrame, strata: Sequence[str], id_col: str, quota: Column, total_over: Sequence[str]) -> DataFrame:
    """Written table of one row per stratum: hash and id of the last row that its quota takes, and how many it takes.

    Chunk counts name the chunk in which a quota ends; only the rows of that chunk are ordered.
    """
    counts = _chunk_counts(keyed, strata)
    part = list(strata) or [F.lit(0)]
    earlier = Window.partitionBy(*part).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    sized = counts.withColumn(_BEFORE, F.coalesce(F.sum(_N).over(earlier), F.lit(0))).withColumn(
        "n_stratum", F.sum(_N).over(Window.partitionBy(*part))
    )
    if total_over:
        totals = counts.groupBy(*total_over).agg(F.sum(_N).alias("n_total"))
        sized = sized.join(totals, list(total_over))
    else:
        sized = sized.withColumn("n_total", counts.agg(F.sum(_N)).scalar())
    reached = sized.withColumn("__quota", quota.cast("bigint")).where(F.col(_BEFORE) < F.col("__quota"))
    last = F.max(F.struct(_B, (F.col("__quota") - F.col(_BEFORE)).alias("rest"))).alias("x")
    taken = F.max(F.least("__quota", "n_stratum")).alias("__taken")
    ends = reached.groupBy(*strata).agg(last, taken).select(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)], "x.*", "__taken")
    ends = ends.withColumnRenamed(_B, "__last")
    inside = Window.partitionBy(*strata, _B).orderBy(_H, id_col)
    edge = keyed.join(ends, (F.col(_B) == F.col("__last")) & _on(strata, True)).withColumn("__in", F.row_number().over(inside))
    top = F.max(F.struct(F.col(_H).alias("h"), F.col(id_col).alias("i"))).alias("__top")
    kept = edge.where(F.col("__in") <= F.col("rest")).groupBy(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)])
    return cut(kept.agg(top, F.max("__taken").alias("__taken")))


def _up_to(hashed: DataFrame, strata: Sequence[str], id_col: str, last: DataFrame, null_strata: bool) -> DataFrame:
    """Rows that do not come after the last row of their stratum: a filter of the scan next to one row per stratum."""
    place = F.struct(F.col(_H).alias("h"), F.col(id_col).alias("i"))
    if strata:
        return hashed.join(last, _on(strata, null_strata)).where(place <= F.col("__top")).select(*hashed.columns)
    end = last.first()
    if end is None:
        return hashed.limit(0)
    kind = hashed.schema[id_col].dataType
    return hashed.where(place <= F.struct(F.lit(end["__top"]["h"]).alias("h"), F.lit(end["__top"]["i"]).cast(kind).alias("i")))


def hash_sample(
    df: DataFrame,
    strata: Sequence[str],
    id_col: str,
    seed: int | Column,
    quota: Column,
    total_over: Sequence[str] = (),
    null_strata: bool = False,
    head: int | None = None,
    head_per: Sequence[str] = (),
) -> DataFrame:
    """The first ``quota`` rows of every stratum in hash order, and of these the first ``head`` per key of ``head_per``.

    ``quota`` is an expression over ``n_stratum`` and ``n_total`` (rows of the stratum, rows
    of all strata that share ``total_over``). Rows of a null stratum count towards
    ``n_total`` but are drawn only with ``null_strata``. A draw is a prefix of the hash
    order, so the last row of every stratum says it all. Those are found in a written table of
    ids, strata and hashes. The input is read once for that table, and once more, as a filter
    of its scan, if it has columns that the table lacks.
    """
    wanted = list(dict.fromkeys([*strata, *total_over, *head_per, id_col]))
    keyed, _ = _written(df, wanted, id_col, seed)
    rounds = [(strata, _last_rows(keyed, strata, id_col, quota, total_over), null_strata)]
    if head is not None:
        drawn = _up_to(keyed, strata, id_col, rounds[0][1], null_strata)
        if head_per or (rounds[0][1].agg(F.sum("__taken")).first()[0] or 0) > head:
            rounds.append((head_per, _last_rows(drawn, head_per, id_col, F.lit(head), ()), True))
    rows = keyed if set(df.columns) <= set(wanted) else df.withColumn(_H, hash_order(seed, id_col))
    for keys, last, nulls in rounds:
        rows = _up_to(rows, keys, id_col, last, nulls)
    return rows.select(*df.columns)


def hash_head(df: DataFrame, id_col: str, seed: int | Column, n: int, per: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in hash order, per key of ``per`` when given; a null key is a key like any other."""
    return hash_sample(df, per, id_col, seed, F.lit(n), null_strata=True)
