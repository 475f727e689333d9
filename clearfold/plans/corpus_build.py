"""From posts and comments to a labelled corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearfold.functions.text import LABELS, META_TITLE_PATTERNS, MIN_BODY_CHARS
from clearfold.operators import corpus as ops
from clearfold.operators.profile import class_counts, describe
from clearfold.operators.sampling import SEED, stratified_trim, uniform_sample
from clearfold.session import cut


def vote_consensus(
    votes: DataFrame,
    k: int = ops.TOP_K,
    min_votes: int = ops.MIN_VOTES,
    min_score: float = ops.MIN_TOTAL_SCORE,
    key: str = "post_id",
    label: str = "label",
    order: Sequence[Column] = (),
) -> DataFrame:
    """Winning label per post from labelled, scored votes.

    The top-k window, the per-label sums and the winner all group by post, so the votes
    are shuffled once.
    """
    top = ops.top_votes(votes, k, key, order)
    return ops.winners(ops.vote_totals(top, key, label), key, label, min_votes, min_score)


def build_corpus(
    posts: DataFrame,
    comments: DataFrame,
    sample_size: int = 5000,
    k: int = ops.TOP_K,
    min_votes: int = ops.MIN_VOTES,
    min_score: float = ops.MIN_TOTAL_SCORE,
    labels: Sequence[str] = LABELS,
    patterns: Sequence[str] = META_TITLE_PATTERNS,
    min_chars: int = MIN_BODY_CHARS,
    seed: int = SEED,
    order: Sequence[Column] = (),
    materialise: bool = True,
) -> DataFrame:
    """Corpus rows ``id, body, verdict`` with the vote totals behind them.

    ``posts(post_id, title, body, score)``, ``comments(post_id, comment_id, message, score)``.
    Bodies join last, onto the posts that got a verdict, so they take part in one shuffle
    only. The wanted ids are written before the comments are joined with them, so that their
    size is known and the comments need not be shuffled for a small table. The trim reads the verdicts more than once; they are a narrow table of at most
    1.5 x ``sample_size`` rows, so writing them down spares further scans of the comments.
    """
    valid = ops.valid_posts(posts, "title", "body", patterns, min_chars)
    wanted = uniform_sample(valid.select("post_id"), int(sample_size * ops.OVERSAMPLE), "post_id", seed)
    if materialise:
        wanted = cut(wanted)
    votes = ops.comments_of(ops.labelled_votes(comments, "message", labels), wanted)
    verdicts = vote_consensus(votes, k, min_votes, min_score, order=order)
    if materialise:
        verdicts = cut(verdicts)
    trimmed = stratified_trim(verdicts, "verdict", sample_size, "post_id", seed)
    return ops.with_verdicts(posts.select("post_id", "body", "score"), trimmed).select(
        F.col("post_id").alias("id"),
        "body",
        "verdict",
        F.col("score").alias("submission_score"),
        "verdict_score",
        F.col("total_score").alias("total_verdict_score"),
        "confidence",
        F.col("num_votes").alias("num_verdict_comments"),
    )


def corpus_statistics(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows per label, profile of confidence and body length)."""
    sized = corpus.withColumn("body_length", F.length("body"))
    return class_counts(corpus, "verdict"), describe(sized, ["confidence", "body_length"])
