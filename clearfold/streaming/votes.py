"""Verdicts that follow a stream of votes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clearfold.functions.text import LABELS
from clearfold.operators.corpus import MIN_TOTAL_SCORE, MIN_VOTES, TOP_K, clamped_score, confidence, top_votes, vote_totals, winners

SALTS = 16  # parts that the votes of a post in a batch are dealt to
CUT_ROWS = 100_000  # votes that a task takes in before it cuts them to the best


def running_verdicts(
    votes: DataFrame,
    labels: Sequence[str] = LABELS,
    key: str = "post_id",
    min_votes: int = MIN_VOTES,
    min_score: float = MIN_TOTAL_SCORE,
) -> DataFrame:
    """Winning label per post as one streaming aggregation, for a known set of labels.

    The state of a post is two numbers per label, and the winner is worked out from them
    row by row; write it in update mode. The same function on a table gives the same
    verdicts as ``winners`` without a top-k limit; ``follow_top_votes`` has one.
    """
    score = clamped_score(F.col("score"))
    sums = []
    for i, name in enumerate(labels):
        mine = F.col("label") == name
        sums.append(F.sum(F.when(mine, score)).alias(f"__s{i}"))
        sums.append(F.count_if(mine).alias(f"__v{i}"))
    state = votes.where(F.col("label").isin(*labels)).groupBy(key).agg(*sums)
    options = F.array(
        *[
            F.when(
                F.col(f"__v{i}") > 0,
                F.struct((-F.col(f"__s{i}")).alias("s"), (-F.col(f"__v{i}")).alias("v"), F.lit(n).alias("l")),
            )
            for i, n in enumerate(labels)
        ]
    )
    total_votes = sum((F.col(f"__v{i}") for i in range(len(labels))), F.lit(0).cast("bigint"))
    total_score = sum((F.coalesce(F.col(f"__s{i}"), F.lit(0)) for i in range(len(labels))), F.lit(0).cast("bigint"))
    return (
        state.withColumn("num_votes", total_votes)
        .withColumn("total_score", total_score)
        .where((F.col("num_votes") >= min_votes) & (F.col("total_score") >= min_score))
        .withColumn("__best", F.array_min(F.array_compact(options)))
        .select(
            key,
            F.col("__best")["l"].alias("verdict"),
            (-F.col("__best")["s"]).alias("verdict_score"),
            "total_score",
            "num_votes",
            confidence(-F.col("__best")["s"], F.col("total_score")).alias("confidence"),
        )
    )


# -- verdicts of the best k votes ------------------------------------------------------


def _cut_to_best(rows: pa.Table, k: int, key: str, vote_id: str) -> pa.Table:
    """The best ``k`` different votes of every post among ``rows``."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("score", "descending"), (vote_id, "ascending")], null_placement="at_end"))
    code = lambda name: rows[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
    post, vote = code(key), code(vote_id)
    first = np.sort(np.unique(post * (len(rows) + 1) + vote, return_index=True)[1])  # the best of the copies of an id
    grouped = first[np.argsort(post[first], kind="stable")]
    starts = np.r_[0, np.flatnonzero(np.diff(post[grouped])) + 1]
    place = np.arange(len(grouped)) - np.repeat(starts, np.diff(np.r_[starts, len(grouped)]))
    return rows.take(pa.array(np.sort(grouped[place < k])))


def best_votes(votes: DataFrame, k: int = TOP_K, key: str = "post_id", vote_id: str = "comment_id", salts: int = SALTS) -> DataFrame:
    """The columns of ``votes`` and ``salt``, always 0: the best ``k`` votes of every post that a batch changed.

    The votes of a batch are dealt by post and one of ``salts`` remainders of their id, so one with a third of
    all votes is spread, and cut to the best ``k`` of a post, many posts at a time. What is left, at
    most ``salts * k`` votes of a post, meets its state: the best ``k`` votes so far, by score and then by id.
    A vote that comes again changes nothing, as it is either held or worse than all that
    are; of copies of an id with different scores the best counts. Votes without an
    id are left out. ``score`` and ``label`` may be null, as in ``top_votes``.
    """
    columns = votes.columns
    at_key, at_score, at_id = (columns.index(c) for c in (key, "score", vote_id))
    arrow = to_arrow_schema(votes.schema)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, n = [], [], 0
        for batch in batches:
            more.append(batch)
            n += len(batch)
            if n > CUT_ROWS + sum(map(len, held)):
                held, more, n = _cut_to_best(pa.Table.from_batches([*held, *more]), k, key, vote_id).to_batches(), [], 0
        if not held and not more:
            return
        of_post: dict = {}
        for batch in _cut_to_best(pa.Table.from_batches([*held, *more]), k, key, vote_id).to_batches():
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                of_post.setdefault(row[at_key], []).append(row)
        posts = pa.array(list(of_post), more[0].schema.field(key).type if more else held[0].schema.field(key).type)
        for part in pa.table({key: posts, "best": pa.array([pickle.dumps(r) for r in of_post.values()], pa.binary())}).to_batches(10_000):
            yield part

    def update(post: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pickle.loads(state.get[0]) if state.exists else []
        every = list(before)
        for pdf in batches:
            for packed in pdf["best"].tolist():
                every += pickle.loads(packed)
        every.sort(key=lambda r: r[at_id])
        every.sort(key=lambda r: (r[at_score] is not None, r[at_score]), reverse=True)
        first: dict = {}
        for r in every:
            first.setdefault(r[at_id], r)
        held = list(first.values())[:k]
        if held != before:
            packed = pickle.dumps(held)
            state.update((packed,))
            yield pd.DataFrame({"best": [packed]})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for packed in batch.column("best").to_pylist() for r in pickle.loads(packed)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    salt = F.pmod(F.xxhash64(vote_id), F.lit(salts))
    dealt = votes.where(F.col(vote_id).isNotNull()).repartition(F.col(key), salt)
    packed = T.StructType([votes.schema[key], T.StructField("best", T.BinaryType())])
    grouped = dealt.mapInArrow(of_task, packed).groupBy(key)
    changed = grouped.applyInPandasWithState(update, "best binary", "votes binary", "update", GroupStateTimeout.NoTimeout)
    return changed.mapInArrow(unpacked, votes.schema).withColumn("salt", F.lit(0))


def follow_top_votes(
    votes: DataFrame, path: str, checkpoint: str, k: int = TOP_K, key: str = "post_id", vote_id: str = "comment_id", salts: int = SALTS, **trigger
) -> StreamingQuery:
    """Start writing what ``best_votes`` changes to ``path``, a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so nothing counts twice.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    changed = best_votes(votes, k, key, vote_id, salts)
    votes.sparkSession.createDataFrame([], changed.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")  # so that there is a table to read
    return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(**(trigger or {"availableNow": True})).start()


def current_top_votes(spark: SparkSession, path: str, schema: T.StructType, k: int = TOP_K, key: str = "post_id", vote_id: str = "comment_id") -> DataFrame:
    """The best ``k`` votes of every post after the batches that are written: exactly those of ``top_votes`` over all votes."""
    more = [T.StructField("salt", T.IntegerType()), T.StructField("batch", T.LongType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *more])).parquet(path)
    last = rows.groupBy(F.col(key).alias("__key"), F.col("salt").alias("__salt")).agg(F.max("batch").alias("__batch"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("salt") == F.col("__salt")) & (F.col("batch") == F.col("__batch"))
    latest = rows.join(last, same, "left_semi").select(*schema.fieldNames())
    return top_votes(latest, k, key, [F.desc("score"), F.asc(vote_id)])


def followed_verdicts(
    spark: SparkSession, path: str, schema: T.StructType, k: int = TOP_K, key: str = "post_id", min_votes: int = MIN_VOTES, min_score: float = MIN_TOTAL_SCORE
) -> DataFrame:
    """Winning label per post after the batches that are written."""
    return winners(vote_totals(current_top_votes(spark, path, schema, k, key), key), key, min_votes=min_votes, min_score=min_score)
