from pyspark.sql import functions as F

from clearfold.functions.text import clean_phrases, first_names, is_meta_title, label_from_text, truncate
from clearfold.operators import corpus as c
from clearfold.plans.corpus_build import build_corpus, corpus_statistics, vote_consensus
from clearfold.streaming.votes import running_verdicts

VOTES = "post_id string, comment_id int, label string, score int"


def one(spark, values, ddl, expr):
    return [r[0] for r in spark.createDataFrame(values, ddl).select(expr).collect()]


def test_label_position_and_case(spark):
    texts = [("NTA because",), ("clearly yta.",), ("x" * 197 + " NTA",), ("x" * 199 + " NTA",), ("xNTA",), ("NTA_",), ("éNTA",),
             ("ESH, not NTA",), ("",), (None,), ("maybe-nah-maybe",)]
    got = one(spark, texts, "m string", label_from_text(F.col("m")))
    assert got == ["NTA", "YTA", None, None, None, None, None, "ESH", None, None, "NAH"]
    assert one(spark, [("x" * 196 + " NTA",)], "m string", label_from_text(F.col("m"))) == ["NTA"]


def test_meta_titles(spark):
    titles = [("META: rules",), ("Advice on metal music",), ("Rule 5 reminder",), ("Rule five",), ("welcome to the sub",), ("My story",)]
    assert one(spark, titles, "t string", is_meta_title(F.col("t"))) == [True, True, True, False, True, False]


def test_valid_posts(spark):
    rows = [
        (1, "ok", "b" * 100), (2, "ok", "b" * 99), (3, "", "b" * 100), (4, None, "b" * 100), (5, "ok", None),
        (6, "ok", "[deleted]"), (7, "META", "b" * 100),
    ]
    df = spark.createDataFrame(rows, "id int, title string, body string")
    assert [r.id for r in c.valid_posts(df).collect()] == [1]
    assert sorted(r.id for r in c.valid_posts(df, min_chars=1).collect()) == [1, 2]


def test_top_k_tie_is_broken_by_comment(spark):
    votes = spark.createDataFrame([("p", 3, "NTA", 5), ("p", 1, "YTA", 5), ("p", 2, "ESH", 5)], VOTES)
    assert sorted(r.comment_id for r in c.top_votes(votes, 2).collect()) == [1, 2]
    assert c.top_votes(votes, 0).count() == 3


def test_winner_ties_and_gates(spark):
    rows = [
        ("tie", 1, "YTA", 4), ("tie", 2, "NTA", 4), ("tie", 3, None, 9),
        ("votes", 1, "YTA", 2), ("votes", 2, "YTA", 2), ("votes", 3, "NTA", 4),
        ("neg", 1, "NTA", -5), ("neg", 2, "YTA", None),
        ("few", 1, "NTA", 100),
    ]
    votes = spark.createDataFrame(rows, VOTES)
    got = {r.post_id: r for r in vote_consensus(votes, 50, 1, 0).collect()}
    assert got["tie"].verdict == "NTA" and got["tie"].num_votes == 2 and got["tie"].confidence == 0.5
    assert got["votes"].verdict == "YTA"
    assert got["neg"].confidence == 0.0 and got["neg"].total_score == 0
    gated = {r.post_id for r in vote_consensus(votes, 50, 3, 5).collect()}
    assert gated == {"votes"}
    assert vote_consensus(votes.limit(0)).count() == 0


def test_recode_keeps_nulls(spark):
    df = spark.createDataFrame([("NTA",), ("YTA",), ("NAH",), ("ESH",), (None,)], "verdict string")
    assert [r[0] for r in c.recode_labels(df, "verdict").collect()] == ["NTA", "YTA", "NTA", None]
    r = c.recode_report(df, "verdict").first()
    assert (r.n_rows, r.n_dropped, r.pct_dropped) == (5, 1, 20.0)


def test_truncation_edges(spark):
    got = one(spark, [("a" * 400,), ("a" * 401,)], "t string", truncate(F.col("t"), 400))
    assert got == ["a" * 400, "a" * 400 + "..."]


def test_phrases_and_names(spark):
    df = spark.createDataFrame([([" a ", "", "  ", "b"], ["x", "y", "z"])], "p array<string>, n array<string>")
    r = df.select(clean_phrases(F.col("p")), first_names(F.col("n"))).first()
    assert r[0] == ["a", "b"] and r[1] == "x, y +1"


def test_corpus_build_end_to_end(spark):
    posts = spark.createDataFrame(
        [(f"p{i}", "title" if i else "META", "b" * 120, i) for i in range(30)], "post_id string, title string, body string, score int"
    )
    comments = spark.createDataFrame(
        [(f"p{i}", j, ("NTA" if (i + j) % 3 else "YTA") + " because", 5 + j) for i in range(30) for j in range(4)],
        "post_id string, comment_id int, message string, score int",
    )
    corpus = build_corpus(posts, comments, sample_size=10, k=50)
    rows = corpus.collect()
    assert 0 < len(rows) <= 10 and "p0" not in {r.id for r in rows}
    assert all(r.num_verdict_comments == 4 and r.confidence >= 0.5 for r in rows)
    whole = build_corpus(posts, comments, sample_size=100)
    assert whole.count() == 29
    counts, profile = corpus_statistics(whole)
    assert sum(r.n for r in counts.collect()) == 29
    assert {r.column: r["mean"] for r in profile.collect()}["body_length"] == 120.0


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(f"p{i % 7}", i, ["NTA", "YTA", "ESH", "zzz"][i * i % 4], i % 11 - 3) for i in range(200)]
    votes = spark.createDataFrame(rows, VOTES)
    votes.repartition(5).write.parquet(str(tmp_path / "votes"))
    stream = spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "votes"))
    q = (
        running_verdicts(stream).writeStream.outputMode("complete").format("memory").queryName("verdicts")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.processAllAvailable()
    q.stop()
    known = votes.where(F.col("label") != "zzz")
    batch = vote_consensus(known, 0)
    cols = ["post_id", "verdict", "verdict_score", "total_score", "num_votes", "confidence"]
    assert sorted(map(tuple, spark.table("verdicts").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
