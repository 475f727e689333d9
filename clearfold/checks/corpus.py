"""Corpus queries: scans, predicates, joins, votes and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearfold.checks import base as b
from clearfold.checks.base import Check
from clearfold.functions.text import is_meta_title, iso_stamp, label_from_text, run_stamp, truncate
from clearfold.operators import corpus as c
from clearfold.operators import profile as pf
from clearfold.plans.corpus_build import build_corpus, vote_consensus
from clearfold.session import cut
from clearfold.sources.corpora import read_comments, read_corpus, read_posts, write_corpus
from clearfold.streaming.votes import follow_top_votes, followed_verdicts


def _line_order():
    return [F.desc("score"), F.desc("l_extendedprice"), *[F.asc(x) for x in b.LINE_ORDER[1:]]]


LINE_ORDER_SQL = "score DESC, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey"


def _votes_out(df):
    return df.select(
        "post_id",
        "verdict",
        F.col("verdict_score").cast("double").alias("verdict_score"),
        F.col("total_score").cast("double").alias("total_score"),
        "num_votes",
        "confidence",
    )


def consensus_sql(votes: str, k: int, min_votes: int, min_score: int, order: str) -> str:
    top = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {order}) AS rn FROM votes)"
    if k:
        top += f" WHERE rn <= {k}"
    return f"""WITH {votes}, top AS ({top}),
t AS (SELECT post_id, label, sum(greatest(score, 0)) AS s, count(*) AS n FROM top WHERE label IS NOT NULL GROUP BY post_id, label),
g AS (SELECT post_id, sum(n) AS num, sum(s) AS tot FROM t GROUP BY post_id),
w AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY s DESC, n DESC, label) AS r FROM t)
SELECT w.post_id, label AS verdict, CAST(s AS DOUBLE) AS verdict_score, CAST(tot AS DOUBLE) AS total_score,
  CAST(num AS BIGINT) AS num_votes, CASE WHEN tot > 0 THEN CAST(s AS DOUBLE) / CAST(tot AS DOUBLE) ELSE 0.0::DOUBLE END AS confidence
FROM w JOIN g ON w.post_id = g.post_id WHERE r = 1 AND num >= {min_votes} AND tot >= {min_score}"""


VALID = f"""valid AS (SELECT * FROM posts WHERE length(title) > 0 AND length(body) >= 100
  AND body NOT IN ('[deleted]', '[removed]') AND NOT regexp_matches(title, '{b.TITLE_SQL}', 'i'))"""
LABELLED = f"""labelled AS (SELECT post_id, comment_id, score,
  nullif(upper(regexp_extract(substring(message, 1, 200), '{b.WORDS_SQL}', 1, 'i')), '') AS label FROM comments)"""


def corpus_sql() -> str:
    return f"""WITH {b.POSTS}, {b.COMMENTS}, {VALID}, {LABELLED},
size AS (SELECT (SELECT count(*) FROM documents) // 2 AS n),
wanted AS (SELECT post_id FROM (SELECT post_id, row_number() OVER (ORDER BY md5('42:' || CAST(post_id AS VARCHAR)), post_id) AS rn FROM valid)
  WHERE rn <= (SELECT CAST(floor(n * 1.5) AS BIGINT) FROM size)),
top AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l.post_id ORDER BY score DESC, comment_id) AS rn
  FROM labelled l WHERE l.post_id IN (SELECT post_id FROM wanted)) WHERE rn <= 3),
t AS (SELECT post_id, label, sum(greatest(score, 0)) AS s, count(*) AS n FROM top WHERE label IS NOT NULL GROUP BY post_id, label),
g AS (SELECT post_id, sum(n) AS num, sum(s) AS tot FROM t GROUP BY post_id),
w AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY s DESC, n DESC, label) AS r FROM t),
win AS (SELECT w.post_id, label AS verdict, s, tot, num FROM w JOIN g ON w.post_id = g.post_id WHERE r = 1 AND num >= 1 AND tot >= 1),
ranked AS (SELECT *, md5('42:' || CAST(post_id AS VARCHAR)) AS h, count(*) OVER () AS n_all, count(*) OVER (PARTITION BY verdict) AS n_v,
  row_number() OVER (PARTITION BY verdict ORDER BY md5('42:' || CAST(post_id AS VARCHAR)), post_id) AS rv FROM win),
drawn AS (SELECT * FROM ranked WHERE n_all <= (SELECT n FROM size) OR rv <= greatest(1, floor((SELECT n FROM size) * n_v / n_all))),
kept AS (SELECT *, row_number() OVER (ORDER BY h, post_id) AS ra FROM drawn)
SELECT k.post_id AS id, p.body, verdict, p.score AS submission_score, CAST(s AS BIGINT) AS verdict_score,
  CAST(tot AS BIGINT) AS total_verdict_score, CASE WHEN tot > 0 THEN CAST(s AS DOUBLE) / CAST(tot AS DOUBLE) ELSE 0.0::DOUBLE END AS confidence,
  CAST(num AS BIGINT) AS num_verdict_comments
FROM kept k JOIN posts p ON k.post_id = p.post_id WHERE ra <= (SELECT n FROM size)"""


def corpus_build(spark, d):
    size = b.table(spark, d, "documents").count() // 2
    return build_corpus(b.posts(spark, d), b.comments(spark, d), size, 3, 1, 1, labels=b.WORDS, patterns=b.TITLE_PATTERNS)


def _corpus_of_orders(spark, d):
    """The whole build with its default size and gates: orders as posts, their lines as comments."""
    posts = b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.repeat("o_orderpriority", F.lit(20)).alias("body"), (F.col("o_custkey") % 100).alias("score"),
    )
    lines = b.line_votes(spark, d).withColumn("message", F.concat(F.lit("I say "), F.col("label"), F.lit("."))).drop("label")
    return build_corpus(posts, lines, labels=("A", "N", "R"), order=_line_order())


CORPUS_OF_ORDERS = f"""WITH {b.LINE_VOTES},
wanted AS (SELECT o_orderkey AS post_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders
  WHERE length(o_orderpriority) * 20 >= 100) WHERE rn <= 7500),
top AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY post_id ORDER BY {LINE_ORDER_SQL}) AS rn FROM votes v WHERE post_id IN (SELECT post_id FROM wanted)) WHERE rn <= 50),
t AS (SELECT post_id, label, sum(greatest(score, 0)) AS s, count(*) AS n FROM top GROUP BY post_id, label),
g AS (SELECT post_id, sum(n) AS num, sum(s) AS tot FROM t GROUP BY post_id),
w AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY s DESC, n DESC, label) AS r FROM t),
win AS (SELECT w.post_id, label AS verdict, s, tot, num FROM w JOIN g ON w.post_id = g.post_id WHERE r = 1 AND num >= 3 AND tot >= 5),
ranked AS (SELECT *, md5('42:' || CAST(post_id AS VARCHAR)) AS h, count(*) OVER () AS n_all, count(*) OVER (PARTITION BY verdict) AS n_v,
  row_number() OVER (PARTITION BY verdict ORDER BY md5('42:' || CAST(post_id AS VARCHAR)), post_id) AS rv FROM win),
drawn AS (SELECT * FROM ranked WHERE n_all <= 5000 OR rv <= greatest(1, floor(5000 * n_v / n_all))),
kept AS (SELECT *, row_number() OVER (ORDER BY h, post_id) AS ra FROM drawn)
SELECT k.post_id AS id, repeat(o_orderpriority, 20) AS body, verdict, o_custkey % 100 AS submission_score, CAST(s AS BIGINT) AS verdict_score,
  CAST(tot AS BIGINT) AS total_verdict_score, CAST(s AS DOUBLE) / CAST(tot AS DOUBLE) AS confidence, CAST(num AS BIGINT) AS num_verdict_comments
FROM kept k JOIN orders ON k.post_id = o_orderkey WHERE ra <= 5000"""


def _read_posts(spark, d):
    """Posts written in the layout of the source and read back by its reader."""
    path = b.scratch(spark, "posts")
    own = b.posts(spark, d).select(F.col("post_id").alias("id"), F.concat(F.lit("s"), F.col("post_id").cast("string")).alias("submission_id"), "title", F.col("body").alias("selftext"), "score")
    own.withColumn("unused", F.lit(1)).write.parquet(path)
    return read_posts(spark, path)


def _read_comments(spark, d):
    """Comments read by the reader, of valid posts, the two best of each."""
    path = b.scratch(spark, "comments")
    own = b.comments(spark, d).select("comment_id", F.col("post_id").alias("submission_id"), "message", "score")
    own.withColumn("unused", F.lit(1)).write.parquet(path)
    valid = cut(c.valid_posts(b.posts(spark, d), patterns=b.TITLE_PATTERNS).select(F.col("post_id").alias("submission_id")))
    return c.top_votes(c.comments_of(read_comments(spark, path), valid, "submission_id"), 2, "submission_id")


def _corpus_csv(spark, d):
    """Labelled documents written as CSV and loaded back through the reader."""
    path = b.scratch(spark, "corpus")
    docs = b.table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    four = b.four_labels(spark, d).where(F.col("verdict").isNotNull())
    out = docs.join(four, "doc_id").select(F.col("doc_id").cast("string").alias("id"), "body", "verdict")
    write_corpus(out, path, "csv")
    return read_corpus(spark, path, schema="id string, body string, verdict string").select("id", "body", "verdict")


def _corpus_parquet(spark, d):
    path = b.scratch(spark, "corpus")
    write_corpus(corpus_build(spark, d), path)
    minimal, full = spark.read.parquet(path), spark.read.parquet(path + "_full")
    return minimal.join(full.select("id", "num_verdict_comments"), "id")


def _labelled_in_top(spark, d):
    votes = c.labelled_votes(b.comments(spark, d), "message", b.WORDS)
    return c.top_votes(votes, 2)


def _valid_comments(spark, d):
    valid = c.valid_posts(b.posts(spark, d), patterns=b.TITLE_PATTERNS)
    return c.comments_of(b.comments(spark, d), valid).select("post_id", "comment_id", "score")


def _posts_with_votes(spark, d):
    totals = c.vote_totals(b.line_votes(spark, d)).groupBy("post_id").agg(
        F.sum("label_votes").alias("num_votes"), F.sum("label_score").alias("total_score")
    )
    orders = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), "o_orderstatus")
    return c.with_verdicts(orders, totals)


def _gate(spark, d):
    w = c.winners(c.vote_totals(b.line_votes(spark, d)), min_votes=3, min_score=60)
    return w.select("post_id", "num_votes", "total_score")


def _rounded(df, digits=6):
    cols = [F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema.fields]
    return df.select(*cols)


def describe_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg(CAST({column} AS DOUBLE)), 6) AS mean,
  round(stddev_samp(CAST({column} AS DOUBLE)), 6) AS std, round(min(CAST({column} AS DOUBLE)), 6) AS min,
  round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 6) AS p50,
  round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 6) AS p75, round(max(CAST({column} AS DOUBLE)), 6) AS max FROM {source}"""


def _followed(spark, d):
    """Verdicts of the best five votes, after a stream over files of all events."""
    votes, folder = b.event_votes(spark, d), b.scratch(spark, "stream")
    votes.repartition(6).write.parquet(f"{folder}/votes")
    stream = spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/votes")
    follow_top_votes(stream, f"{folder}/best", f"{folder}/checkpoint", 5).awaitTermination()
    return _votes_out(followed_verdicts(spark, f"{folder}/best", votes.schema, 5))


CHECKS = [
    Check("stream_top_vote_verdicts", _followed, consensus_sql(b.EVENT_VOTES, 5, 3, 5, "score DESC, comment_id")),
    Check(
        "vote_consensus_events",
        lambda s, d: _votes_out(vote_consensus(b.event_votes(s, d))),
        consensus_sql(b.EVENT_VOTES, 50, 3, 5, "score DESC, comment_id"),
    ),
    Check(
        "vote_consensus_lineitem_gated",
        lambda s, d: _votes_out(vote_consensus(b.line_votes(s, d), 5, 3, 60, order=_line_order())),
        consensus_sql(b.LINE_VOTES, 5, 3, 60, LINE_ORDER_SQL),
    ),
    Check(
        "vote_consensus_all_votes",
        lambda s, d: _votes_out(vote_consensus(b.line_votes(s, d), 0, 1, 0)),
        consensus_sql(b.LINE_VOTES, 0, 1, 0, LINE_ORDER_SQL),
    ),
    Check("corpus_build", corpus_build, corpus_sql()),
    Check("corpus_build_orders", _corpus_of_orders, CORPUS_OF_ORDERS),
    Check(
        "a1_submission_scan",
        _read_posts,
        f"WITH {b.POSTS} SELECT post_id AS id, 's' || CAST(post_id AS VARCHAR) AS submission_id, title, body AS selftext, score FROM posts",
    ),
    Check(
        "a2_comment_scan",
        _read_comments,
        f"""WITH {b.POSTS}, {b.COMMENTS}, {VALID}
SELECT comment_id, post_id AS submission_id, message, score FROM (SELECT c.*, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, comment_id) AS rn
  FROM comments c WHERE post_id IN (SELECT post_id FROM valid)) WHERE rn <= 2""",
    ),
    Check(
        "a3_load_corpus_csv",
        _corpus_csv,
        f"""WITH {b.FOUR_LABELS} SELECT CAST(f.doc_id AS VARCHAR) AS id, text AS body, CASE WHEN verdict = 'NAH' THEN 'NTA' ELSE verdict END AS verdict
FROM four f JOIN documents d ON f.doc_id = d.doc_id WHERE verdict IS NOT NULL AND verdict <> 'ESH'""",
    ),
    Check(
        "a5_a6_corpus_round_trip",
        _corpus_parquet,
        f"WITH corpus AS ({corpus_sql()}) SELECT id, body, verdict, num_verdict_comments FROM corpus",
    ),
    Check(
        "b1_valid_posts",
        lambda s, d: c.valid_posts(b.posts(s, d), patterns=b.TITLE_PATTERNS).select("post_id", "title", "score"),
        f"WITH {b.POSTS}, {VALID} SELECT post_id, title, score FROM valid",
    ),
    Check(
        "b2_meta_titles",
        lambda s, d: b.posts(s, d).select("post_id", is_meta_title(F.col("title"), b.TITLE_PATTERNS).alias("is_meta")),
        f"WITH {b.POSTS} SELECT post_id, regexp_matches(title, '{b.TITLE_SQL}', 'i') AS is_meta FROM posts",
    ),
    Check(
        "b3_label_from_text",
        lambda s, d: b.table(s, d, "documents").select("doc_id", label_from_text(F.col("text"), b.WORDS).alias("label")),
        f"""SELECT doc_id, nullif(upper(regexp_extract(substring(text, 1, 200), '{b.WORDS_SQL}', 1, 'i')), '') AS label FROM documents""",
    ),
    Check(
        "b4_label_recode",
        lambda s, d: c.recode_labels(b.four_labels(s, d), "verdict"),
        f"""WITH {b.FOUR_LABELS} SELECT doc_id, CASE WHEN verdict = 'NAH' THEN 'NTA' ELSE verdict END AS verdict
FROM four WHERE verdict IS DISTINCT FROM 'ESH'""",
    ),
    Check(
        "b4_recode_report",
        lambda s, d: c.recode_report(b.four_labels(s, d), "verdict"),
        f"""WITH {b.FOUR_LABELS} SELECT count(*) AS n_rows, count(*) FILTER (verdict = 'ESH') AS n_dropped,
  count(*) FILTER (verdict = 'ESH') / count(*) * 100.0::DOUBLE AS pct_dropped FROM four""",
    ),
    Check(
        "b5_clamped_scores",
        lambda s, d: b.line_votes(s, d).groupBy("label").agg(
            F.sum(c.clamped_score(F.col("score"))).alias("clamped"), F.sum("score").alias("raw")
        ),
        f"WITH {b.LINE_VOTES} SELECT label, CAST(sum(greatest(score, 0)) AS BIGINT) AS clamped, CAST(sum(score) AS BIGINT) AS raw FROM votes GROUP BY label",
    ),
    Check(
        "b6_truncated_texts",
        lambda s, d: b.table(s, d, "documents").select(
            "doc_id",
            truncate(F.col("text"), 400).alias("sample_text"),
            truncate(F.col("text"), 500).alias("broad_text"),
            truncate(F.col("text"), 500, ellipsis=False).alias("residual_text"),
        ),
        """SELECT doc_id, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END AS sample_text,
  CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS broad_text,
  substring(text, 1, 500) AS residual_text FROM documents""",
    ),
    Check(
        "b7_body_length",
        lambda s, d: b.table(s, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("body_length")),
        "SELECT doc_id, length(text) AS body_length FROM documents",
    ),
    Check(
        "c1_comments_of_posts",
        _valid_comments,
        f"WITH {b.POSTS}, {b.COMMENTS}, {VALID} SELECT post_id, comment_id, score FROM comments WHERE post_id IN (SELECT post_id FROM valid)",
    ),
    Check(
        "c2_posts_with_votes",
        _posts_with_votes,
        f"""WITH {b.LINE_VOTES}, g AS (SELECT post_id, count(*) AS num_votes, CAST(sum(greatest(score, 0)) AS BIGINT) AS total_score FROM votes GROUP BY post_id)
SELECT g.post_id, o_orderstatus, num_votes, total_score FROM orders JOIN g ON o_orderkey = g.post_id""",
    ),
    Check(
        "d1_vote_totals",
        lambda s, d: c.vote_totals(b.event_votes(s, d)).withColumn("label_score", F.col("label_score").cast("double")),
        f"""WITH {b.EVENT_VOTES} SELECT post_id, label, CAST(sum(greatest(score, 0)) AS DOUBLE) AS label_score, count(*) AS label_votes
FROM votes GROUP BY post_id, label""",
    ),
    Check(
        "d2_engagement_gate",
        _gate,
        f"""WITH {b.LINE_VOTES} SELECT post_id, count(*) AS num_votes, CAST(sum(greatest(score, 0)) AS BIGINT) AS total_score FROM votes
GROUP BY post_id HAVING count(*) >= 3 AND sum(greatest(score, 0)) >= 60""",
    ),
    Check(
        "d3_winning_label",
        lambda s, d: c.winners(c.vote_totals(b.line_votes(s, d)), min_votes=1, min_score=0).select("post_id", "verdict"),
        f"""WITH {b.LINE_VOTES}, t AS (SELECT post_id, label, sum(greatest(score, 0)) AS s, count(*) AS n FROM votes GROUP BY post_id, label)
SELECT post_id, label AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY s DESC, n DESC, label) AS r FROM t) WHERE r = 1""",
    ),
    Check(
        "d4_confidence",
        lambda s, d: c.winners(c.vote_totals(b.line_votes(s, d)), min_votes=1, min_score=0).select("post_id", "confidence"),
        f"""WITH {b.LINE_VOTES}, t AS (SELECT post_id, label, sum(greatest(score, 0)) AS s FROM votes GROUP BY post_id, label)
SELECT post_id, CASE WHEN sum(s) > 0 THEN CAST(max(s) AS DOUBLE) / CAST(sum(s) AS DOUBLE) ELSE 0.0::DOUBLE END AS confidence FROM t GROUP BY post_id""",
    ),
    Check(
        "d5_class_counts",
        lambda s, d: pf.class_counts(b.four_labels(s, d), "verdict"),
        f"WITH {b.FOUR_LABELS} SELECT verdict, count(*) AS n FROM four GROUP BY verdict",
    ),
    Check(
        "d6_numeric_profile",
        lambda s, d: _rounded(
            pf.describe(b.table(s, d, "lineitem"), ["l_extendedprice", "l_quantity"]).unionByName(
                pf.describe(b.table(s, d, "documents"), ["n_chars"])
            )
        ),
        describe_sql("lineitem", "l_extendedprice") + " UNION ALL " + describe_sql("lineitem", "l_quantity")
        + " UNION ALL " + describe_sql("documents", "n_chars"),
    ),
    Check(
        "d7_label_index",
        lambda s, d: pf.label_index(b.event_votes(s, d), "label").withColumn("label_idx", F.col("label_idx").cast("bigint")),
        "SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS label_idx FROM (SELECT DISTINCT event_type FROM events)",
    ),
    Check(
        "d8_fold_counts",
        lambda s, d: pf.safe_fold_counts(b.four_labels(s, d), "verdict"),
        f"""WITH {b.FOUR_LABELS}, n AS (SELECT verdict, count(*) AS n FROM four WHERE verdict IS NOT NULL GROUP BY verdict)
SELECT min(n) AS min_class, CAST(sum(n) AS BIGINT) AS n_rows, greatest(2, least(3, min(n))) AS inner_folds,
  greatest(2, least(5, min(n), CAST(sum(n) AS BIGINT) // 2)) AS outer_folds FROM n""",
    ),
    Check(
        "d15_majority_label",
        lambda s, d: pf.majority_label(b.line_votes(s, d), "label"),
        f"WITH {b.LINE_VOTES} SELECT label AS majority_label, count(*) AS n FROM votes GROUP BY label ORDER BY n DESC, label LIMIT 1",
    ),
    Check(
        "e1_topk_per_post",
        lambda s, d: c.top_votes(b.line_votes(s, d), 2, order=_line_order()),
        f"""WITH {b.LINE_VOTES} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {LINE_ORDER_SQL}) AS rn FROM votes)
WHERE rn <= 2""",
    ),
    Check(
        "e1_labels_in_topk",
        _labelled_in_top,
        f"""WITH {b.COMMENTS}, {LABELLED} SELECT post_id, comment_id, score, label FROM (SELECT *, row_number() OVER
  (PARTITION BY post_id ORDER BY score DESC, comment_id) AS rn FROM labelled) WHERE rn <= 2""",
    ),
    Check(
        "i9_stamps",
        lambda s, d: b.table(s, d, "orders").select(
            "o_orderkey", run_stamp(F.col("o_orderdate")).alias("run_id"), iso_stamp(F.col("o_orderdate")).alias("stamp")
        ),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS stamp FROM orders",
    ),
]
