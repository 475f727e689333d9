"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in a shuffled order, again and again up to a number of
passes. A document's virtual finish time is the cumulative size of its source up to the
middle of it, divided by the source's target. The mix is the head of the global order by
that time, cut at the total budget. Every cumulative sum runs over chunks whose totals form
a small table, so neither a source nor the global order is ever in one task, and only ids,
sizes and sources are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearfold.llm.common import SPACED_WORD, bounded_broadcast, row_key
from clearfold.operators.ordered import running
from clearfold.session import cut

PASSES = 3
WEIGHTS = (1, 2, 3)
CHUNK_ROWS = 10_000  # rows of one chunk of a cumulative sum, about


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``source``, ``source_size``, ``target`` per source of a table of ``source`` and ``size``.

    Sources in the order of their code points, null last, take the weights in turn and share
    the size of all documents. A target stops at ``passes`` times its source; what exceeds it
    goes to the others by weight until none is above. Sources are capped in the order of
    size per weight, so that is one running sum. Everything but the final division is exact.
    """
    sizes = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.get(F.array(*map(F.lit, weights)), turn.cast("int")).cast("bigint")
    weighted = sizes.withColumn("w", weight).withColumn("cap", passes * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        weighted.withColumn("all", F.sum("source_size").over(every))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("free", F.col("cap") * F.col("w_left") >= F.col("left") * F.col("w"))
        .withColumn("place", F.row_number().over(full))
    )
    shared = level.withColumn("first", F.min_by(F.struct("left", "w_left"), F.when(F.col("free"), F.col("place"))).over(every))
    target = (F.col("w") * F.col("first.left")).cast("double") / F.col("first.w_left").cast("double")
    return shared.select(
        "source", "source_size", F.when(F.col("free"), target).otherwise(F.col("cap").cast("double")).alias("target")
    )


def _chunks(n: int) -> int:
    return max(64, min(1 << 20, 1 << (n // CHUNK_ROWS).bit_length()))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    passes: int = PASSES,
) -> DataFrame:
    """One row per input row: ``__id``, ``__th``, ``source``, ``size``, ``source_size``, ``target``, ``times``, ``taken``.

    ``size`` is the number of words, ``times`` how often the mix takes the document and
    ``taken`` the words that makes. The order is by md5 of id and text, so reruns agree. Null
    texts have size 0 and, like all texts without words, are never taken; a null source is a
    source of its own. Of several equal rows each gets the result of its group: they take
    turns as one document of their joint size. An empty table gives an empty result.
    """
    key = row_key(id_col, text_col)
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACED_WORD)).cast("bigint")
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    sized = cut(docs.select(*key, F.col(source_col).alias("source"), size.alias("size"), digest.alias("__o")))
    targets = cut(source_targets(sized, weights, passes))
    few = bounded_broadcast(targets)
    keys = ["__id", "__th", "source", "__o"]
    groups = cut(sized.groupBy(*keys).agg(F.sum("size").alias("sum"), F.min("size").alias("size"), F.count(F.lit(1)).alias("copies")))
    n = groups.count()
    digits = max(1, (_chunks(n).bit_length() + 2) // 4)
    queued = cut(running(groups, ["source"], F.substring("__o", 1, digits), ["__o", "__id"], F.col("sum"), "before"))
    timed = queued.where(F.col("size") > 0).join(few, queued["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rounds = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("round")
    middle = F.col("round") * F.col("source_size") + F.coalesce("before", F.lit(0)) + F.col("sum") / 2
    slots = timed.select(*keys, "size", "sum", "before", "target", "source_size", rounds).withColumn("finish", middle / F.col("target"))
    scale = _chunks(passes * n)
    late = 2 * scale + F.floor(F.log2("finish") * scale)  # far beyond the cut, where sources are that have much more than they may give
    slots = cut(slots.withColumn("chunk", F.when(F.col("finish") < 2, F.floor(F.col("finish") * scale)).otherwise(late)))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    global_order = running(slots, [], F.col("chunk"), ["finish", F.col("source").asc_nulls_last(), "__o", "__id"], F.col("sum"), "ahead")
    within = global_order.where(F.coalesce("ahead", F.lit(0)) + F.col("sum") / 2 <= F.lit(budget))
    times = within.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    counted = sized.alias("s").join(times.alias("t"), same, "left").select("s.__id", "s.__th", "s.source", "s.size", F.coalesce("t.times", F.lit(0)).alias("times"))
    return counted.join(few, counted["source"].eqNullSafe(targets["source"])).select(
        "__id", "__th", counted["source"], "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")
    )


def report(docs: DataFrame) -> DataFrame:
    """``mix`` of ``documents``, under the names of that table."""
    return mix(docs).select(F.col("__id").alias("doc_id"), "size", "source_size", "target", "taken", "times")


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: every row of ``docs`` as often as it is taken, with its columns as they are."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    chosen = mix(docs, **options).where(F.col("times") > 0).groupBy("__id", "__th", "source").agg(F.max("times").alias("times"))
    chosen = bounded_broadcast(cut(chosen))
    same = docs[id_col].eqNullSafe(chosen["__id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == chosen["__th"])
    same = same & docs[source_col].eqNullSafe(chosen["source"])
    turns = F.explode(F.sequence(F.lit(1), chosen["times"].cast("int"))).alias("__turn of the mix")
    return docs.join(chosen, same).select(*[docs[c] for c in docs.columns], turns).drop("__turn of the mix")
