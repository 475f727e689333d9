"""Labelled corpora from score-weighted votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearfold.functions.text import LABELS, META_TITLE_PATTERNS, MIN_BODY_CHARS, is_valid_post, label_from_text

# Defaults of the corpus build.
TOP_K = 50
MIN_VOTES = 3
MIN_TOTAL_SCORE = 5
OVERSAMPLE = 1.5

# Recode of the four labels to two; None drops the row.
BINARY_RECODE: dict[str, str | None] = {"NAH": "NTA", "ESH": None}


def valid_posts(
    posts: DataFrame,
    title: str = "title",
    body: str = "body",
    patterns: Sequence[str] = META_TITLE_PATTERNS,
    min_chars: int = MIN_BODY_CHARS,
) -> DataFrame:
    return posts.where(is_valid_post(F.col(title), F.col(body), patterns, min_chars))


def comments_of(comments: DataFrame, posts: DataFrame, key: str = "post_id") -> DataFrame:
    """Comments that belong to one of ``posts``.

    Comes before any window or aggregation on purpose. Hand in ``posts`` as a written table:
    its size is then known when the join is planned, and a small one filters the comment scan
    without a shuffle.
    """
    return comments.join(posts.select(key), key, "left_semi")


def top_votes(comments: DataFrame, k: int = TOP_K, key: str = "post_id", order: Sequence[Column] = ()) -> DataFrame:
    """The ``k`` best-scored comments of every post, over all its comments; ``k=0`` keeps all.

    ``order`` must end in a unique key. The rank limit is applied inside each task before
    the shuffle, so a post with a third of all comments sends at most ``k`` rows per task.
    """
    if k <= 0:
        return comments
    w = Window.partitionBy(key).orderBy(*(order or [F.desc("score"), F.asc("comment_id")]))
    return comments.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def labelled_votes(
    comments: DataFrame, message: str = "message", labels: Sequence[str] = LABELS, out: str = "label"
) -> DataFrame:
    """Replace the message by the label it names; null where it names none.

    Done before the top-k shuffle, so that message texts are never shuffled.
    """
    return comments.withColumn(out, label_from_text(F.col(message), labels)).drop(message)


def clamped_score(score: Column) -> Column:
    return F.greatest(score, F.lit(0).cast("int"))


def vote_totals(votes: DataFrame, key: str = "post_id", label: str = "label", score: str = "score") -> DataFrame:
    """Summed non-negative score and number of votes per post and label; unlabelled votes are left out."""
    return (
        votes.where(F.col(label).isNotNull())
        .groupBy(key, label)
        .agg(F.sum(clamped_score(F.col(score))).alias("label_score"), F.count(F.lit(1)).alias("label_votes"))
    )


def winners(
    totals: DataFrame,
    key: str = "post_id",
    label: str = "label",
    min_votes: int = MIN_VOTES,
    min_score: float = MIN_TOTAL_SCORE,
) -> DataFrame:
    """Winning label and its share, for posts with enough votes and score.

    Ties on score go to the label with more votes, then to the alphabetically first: the
    smallest of (-score, -votes, label), which merges partial results on the map side.
    """
    ordered = F.struct(
        (-F.col("label_score")).alias("s"), (-F.col("label_votes")).alias("v"), F.col(label).alias("l")
    )
    per_post = totals.groupBy(key).agg(
        F.sum("label_votes").alias("num_votes"),
        F.sum("label_score").alias("total_score"),
        F.min(ordered).alias("__best"),
    )
    return (
        per_post.where((F.col("num_votes") >= min_votes) & (F.col("total_score") >= min_score))
        .withColumn("verdict", F.col("__best")["l"])
        .withColumn("verdict_score", -F.col("__best")["s"])
        .withColumn("confidence", confidence(F.col("verdict_score"), F.col("total_score")))
        .select(key, "verdict", "verdict_score", "total_score", "num_votes", "confidence")
    )


def confidence(winning: Column, total: Column) -> Column:
    return F.when(total > 0, winning.cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def with_verdicts(posts: DataFrame, verdicts: DataFrame, key: str = "post_id") -> DataFrame:
    """Posts with their winning label; posts without a gated verdict are left out."""
    return posts.join(verdicts, key)


def recode_labels(df: DataFrame, label: str, mapping: dict[str, str | None] = BINARY_RECODE) -> DataFrame:
    """Rename labels by ``mapping`` and drop those mapped to None; null labels are kept."""
    recoded = F.col(label)
    for old, new in mapping.items():
        if new is not None:
            recoded = F.when(F.col(label) == old, F.lit(new)).otherwise(recoded)
    dropped = [old for old, new in mapping.items() if new is None]
    kept = df.where(F.coalesce(~F.col(label).isin(*dropped), F.lit(True))) if dropped else df
    return kept.withColumn(label, recoded)


def recode_report(df: DataFrame, label: str, mapping: dict[str, str | None] = BINARY_RECODE) -> DataFrame:
    """One row: how many rows a recode drops, and their share in percent."""
    dropped = [old for old, new in mapping.items() if new is None]
    gone = F.count_if(F.coalesce(F.col(label).isin(*dropped), F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), gone.alias("n_dropped")).withColumn(
        "pct_dropped", F.when(F.col("n_rows") > 0, F.col("n_dropped") / F.col("n_rows") * 100.0).otherwise(0.0)
    )
